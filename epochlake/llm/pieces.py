"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding is the score-ordered agenda: the symbols of a text start as its
characters; every pair of neighbours that is a piece of the vocabulary is put on
an agenda ordered by score, then by position; the best pair is merged, stale
entries are passed over, and the two new neighbour pairs are put on it. Symbols
that remain and are no pieces become bytes. No piece has a space mark (U+2581)
after another character, so merges never cross from a word to the next mark: the
agenda runs once for each distinct run "marks + characters" and its ids are kept
in a cache of bounded size. `Pieces` checks that property of its vocabulary and
runs the agenda over whole texts where it doesn't hold.

Every slice of an Arrow batch is checked against the sentencepiece library: each run that was
coded anew, of any length, is encoded by the library too if it begins with a space mark (all runs
of a text but those after other marks do), and every 50th text, chosen by its content, is encoded
and decoded whole; a difference raises an error.

Edge cases: a null text is an empty one, whose ids are begin and end alone; texts
of any length are encoded whole; repeated rows get equal results; an empty table
gives an empty table; other columns are kept by `encode`.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Rows that a task holds in all their forms at a time.
SLICE_ROWS = 250
#: A run of marks with the characters up to the next mark.
RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """A merge-type vocabulary read through the sentencepiece library."""

    def __init__(self, path: str, cache_entries: int = 500_000):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.controls = {i for i in range(n) if sp.is_control(i)}
        # bytes under 128 are characters whatever stands beside them; the others have to be joined first
        self.wide_bytes = {i for i, b in self.byte_of.items() if b > 127}
        self.texts = ["" if i in self.controls else chr(self.byte_of[i]) if i in self.byte_of else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.by_run = all(MARK not in p.lstrip(MARK) for p in self.ids)
        self.cache_entries = cache_entries
        self.cache: dict[str, bytes] = {}
        self.fresh: list[tuple[str, bytes]] = []

    def prepared(self, text: str) -> str:
        """The text as symbols are cut from it: a mark before it and for each space."""
        return MARK + text.replace(" ", MARK) if text else ""

    def agenda(self, symbols: str) -> list[int]:
        """Ids of a prepared text."""
        ids, scores = self.ids, self.scores
        whole = ids.get(symbols)
        parts: list[str | None] = list(symbols)
        n = len(parts)
        if n > 1:
            left, right = list(range(-1, n - 1)), list(range(1, n + 1))
            heap = []
            for i in range(n - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None:
                    heap.append((-s, i, parts[i] + parts[i + 1]))
            heapq.heapify(heap)
            while heap:
                _, i, piece = heapq.heappop(heap)
                j = right[i]
                if parts[i] is None or j >= n or parts[i] + parts[j] != piece:
                    continue  # stale: one of the two has been merged meanwhile
                parts[i], parts[j] = piece, None
                right[i] = k = right[j]
                if k < n:
                    left[k] = i
                    s = scores.get(piece + parts[k])
                    if s is not None:
                        heapq.heappush(heap, (-s, i, piece + parts[k]))
                h = left[i]
                if h >= 0:
                    s = scores.get(parts[h] + piece)
                    if s is not None:
                        heapq.heappush(heap, (-s, h, parts[h] + piece))
        elif whole is not None:
            return [whole]
        out: list[int] = []
        for p in parts:
            if p is not None:
                out += self.ids_of(p)
        return out

    def ids_of(self, symbol: str) -> list[int]:
        found = self.ids.get(symbol)
        if found is not None:
            return [found]
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[b] for b in symbol.encode("utf-8", "surrogatepass")]

    def packed(self, run: str) -> bytes:
        """Ids of a run as little-endian unsigned 32-bit integers."""
        ids = array("I", self.agenda(run)).tobytes()
        if len(run) <= 64:
            if len(self.cache) >= self.cache_entries:
                self.cache.clear()
            self.cache[run] = ids
        self.fresh.append((run, ids))
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        ready = self.prepared(text or "")
        runs = RUN.findall(ready) if self.by_run else [ready] * bool(ready)
        get, packed = self.cache.get, self.packed
        inner = b"".join([get(r) or packed(r) for r in runs])
        return array("I", [self.begin]).tobytes() + inner + array("I", [self.end]).tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8, marks as spaces, the first mark dropped."""
        words = memoryview(ids).cast("I")
        if self.wide_bytes.isdisjoint(words):
            start = next((k for k, i in enumerate(words) if i not in self.controls), len(words))
            text = "".join(map(self.texts.__getitem__, words))
            return text[1:] if text and self.pieces[words[start]].startswith(MARK) else text
        out, held, first = [], bytearray(), True
        pieces, byte_of, controls = self.pieces, self.byte_of, self.controls
        for i in words:
            if i in controls:
                continue
            b = byte_of.get(i)
            if b is None:
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held.clear()
                p = pieces[i]
                out.append((p[1:] if first and p.startswith(MARK) else p).replace(MARK, " "))
            else:
                held.append(b)
            first = False
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def check(self, texts: list[str], packed: list[bytes], share: int) -> None:
        """Holds what a batch made against the library."""
        fresh, self.fresh = self.fresh, []
        # a text's own first mark stands for the one that the library adds
        runs = [(r, ours) for r, ours in fresh if r[0] == MARK]
        for (r, ours), ids in zip(runs, self.library.encode([r[1:].replace(MARK, " ") for r, _ in runs]), strict=True):
            if len(r) > 1 and array("I", ids).tobytes() != ours:
                raise ValueError(f"the library encodes {r!r} as {ids}")
        for text, ids in zip(texts, packed, strict=True):
            if zlib.crc32(text[:4096].encode("utf-8", "replace")) % share == 0:
                if (theirs := self.library.encode(text, add_bos=True, add_eos=True)) != list(memoryview(ids).cast("I")):
                    raise ValueError(f"the library gives {len(theirs)} other ids for a text of {len(text)} characters")
                if self.library.decode(theirs) != self.decode(ids):
                    raise ValueError(f"the library decodes a text of {len(text)} characters otherwise")


@functools.cache
def pieces(path: str) -> Pieces:
    """One for each Python worker."""
    return Pieces(path)


def encode(docs: DataFrame, model: str, column: str = "text", check_share: int = 50) -> DataFrame:
    """docs with `ids` (binary: little-endian unsigned 32-bit integers, begin and end included) and `decoded`.

    Of every batch the library checks each run that was coded anew, long ones too, if it
    begins with a space mark, and every check_share-th text whole, by a hash of the text.
    """
    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("ids", "decoded")] + [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches):
        coder = pieces(model)
        for whole in batches:
            # texts, ids and decoded texts of a few rows at a time: a batch of long texts is many times its size meanwhile
            for start in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(start, SLICE_ROWS)
                texts = [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
                packed = [coder.encode(t) for t in texts]
                coder.check(texts, packed, check_share)
                decoded = [coder.decode(p) for p in packed]
                kept = [n for n in batch.schema.names if n not in ("ids", "decoded")]
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in kept], pa.array(packed, pa.binary()), pa.array(decoded, pa.string())], names=[*kept, "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Ids and decoded text in short: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    done = encode(docs.select("doc_id", "text"), model)
    return done.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
