"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates.

A text becomes tokens (runs of word characters, runs of other visible
characters); each token and each pair of neighbours is hashed to one of 2**bits
weights and counts 1 / sqrt(number of n-grams); pairs of a token with itself also
share one weight. The model is fitted on at most
`max_rows` labelled rows (a documented bound), the first by an md5 of doc_id. Scan, join and
hashing are spread; then one task takes the hashed rows one by one, `epochs` times in orders of
md5(epoch:doc_id) that Spark sorts, so it holds the weights, of a fixed size, and an Arrow batch.
All texts are scored whole, as sparse dot products, in Arrow batches.

Nulls and edge cases: a null or empty text has the score of the bias alone; rows
of labels without a label or a doc_id teach nothing; with nothing to learn from
all scores are 0.5; a doc_id that repeats in either table is taken row by row; equal
scores are equal predictions, and rows that tie in an order are sorted by all they have;
very long texts are hashed and scored whole; an empty table gives an empty table;
other columns are never inputs.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHE_ENTRIES = 500_000


class Hasher(dict):
    """Hash of a token, kept for the next time."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[token] = h = zlib.crc32(token.encode("utf-8", "replace"))
        return h


def ngrams(text: str | None, hashes: Hasher, bits: int) -> np.ndarray:
    """Indices of the 1- and 2-grams of a text, once for each time they occur."""
    tokens = TOKEN.findall(text or "")
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    # a pair or skip pair of one token with itself also counts as "the same again", whatever the token
    again = [np.full(np.count_nonzero(h[k:] == h[:-k]), k, np.uint64) * np.uint64(0xA24BAED4963EE407) for k in (1, 2)]
    both = np.concatenate([h * np.uint64(0xC2B2AE3D27D4EB4F), pairs, *again])
    return (both >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """Logistic regression by FTRL-proximal; the last weight is the bias."""

    def __init__(self, bits: int, alpha: float = 3.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(len(z), self.l1)
        if not isinstance(at, slice) or at == slice(None):
            l1[-1] = 0.0
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        """One example; `at` ends with the index of the bias."""
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, bits: int = 18, max_rows: int = 6000, epochs: int = 3) -> bytes | None:
    """Weights as float32, or None with nothing to learn from. labels: (doc_id, label)."""
    known = labels.filter("label IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id", "label").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def featurize(batches):
        hashes = Hasher()
        for b in batches:
            ids, ys, texts = (c.to_pylist() for c in b.columns)
            counted = [np.concatenate(np.unique(ngrams(t, hashes, bits), return_counts=True)).astype(np.int32).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(ys, pa.int32()), pa.array(counted, pa.binary())], names=["doc_id", "label", "grams"])

    def train(batches):
        model, seen = Ftrl(bits), 0
        for b in batches:
            for y, g in zip(b.column("label").to_pylist(), b.column("grams"), strict=True):
                at, counts = np.frombuffer(g.as_py(), np.int32).reshape(2, -1)
                model.learn(np.append(at, 2**bits), np.append(counts / np.sqrt(max(1, counts.sum())), 1.0), y)
                seen += 1
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], names=["n", "weights"])

    grams = cut(rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("label").cast("int").alias("label"), "text").mapInArrow(featurize, "doc_id string, label int, grams binary"))
    passes = grams.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("place", F.md5(F.concat_ws(":", "epoch", "doc_id").cast("binary")))
    ordered = passes.repartition(1).sortWithinPartitions("epoch", "place", "doc_id", "label", "grams").select("label", "grams")
    fitted = ordered.mapInArrow(train, "n long, weights binary").filter("n > 0").first()
    return fitted["weights"] if fitted else None


def score(docs: DataFrame, weights: bytes | None, bits: int = 18) -> DataFrame:
    """docs' (doc_id, score)."""

    def run(batches):
        hashes = Hasher()
        w = np.frombuffer(weights, np.float32).astype(np.float64) if weights else np.zeros(2**bits + 1)
        for b in batches:
            sums = []
            for t in b.column(1).to_pylist():
                at = ngrams(t, hashes, bits)
                sums.append(w[-1] + (w[at].sum() / np.sqrt(len(at)) if len(at) else 0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))), pa.float64())], names=["doc_id", "score"])

    pair = docs.select("doc_id", "text")
    return pair.mapInArrow(run, pair.select("doc_id", F.lit(0.0).alias("score")).schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fitting) -> DataFrame:
    """(doc_id, held_out, score, predicted). labels: (doc_id, label)."""
    weights = fit(docs, labels, **fitting)
    found = score(docs, weights, **({"bits": fitting["bits"]} if "bits" in fitting else {}))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
