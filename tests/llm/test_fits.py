"""The FTRL fit against a plain one, top-k past the range of a long and with boxes that prune, joins that pass texts by."""

import hashlib
import math
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from epochlake.llm import common, near_dup, quality_model, topk


def plain_grams(text, bits):
    tokens = quality_model.TOKEN.findall(text or "")
    h = [zlib.crc32(t.encode()) for t in tokens]
    keys = [x * 0xC2B2AE3D27D4EB4F for x in h]
    keys += [(a * 0x9E3779B97F4A7C15 + b) * 0xC2B2AE3D27D4EB4F for a, b in zip(h, h[1:])]
    keys += [k * 0xA24BAED4963EE407 for k in (1, 2) for a, b in zip(h, h[k:]) if a == b]
    return Counter((k % 2**64) >> (64 - bits) for k in keys)


def plain_ftrl(rows, bits, epochs, alpha=3.0, beta=1.0, l1=0.02, l2=0.1):
    z, n, bias = Counter(), Counter(), 2**bits

    def weight(i):
        free = 0.0 if i == bias else l1
        return 0.0 if abs(z[i]) <= free else -(z[i] - math.copysign(free, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    def vector(text):
        grams = plain_grams(text, bits)
        x = {i: c / math.sqrt(max(1, sum(grams.values()))) for i, c in grams.items()}
        return x | {bias: 1.0}

    for epoch in range(1, epochs + 1):
        for i, y, text in sorted(rows, key=lambda r: (hashlib.md5(f"{epoch}:{r[0]}".encode()).hexdigest(), r[0])):
            x = vector(text)
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
    return lambda text: 1 / (1 + math.exp(-sum(weight(k) * v for k, v in vector(text).items())))


def test_quality_scores_against_plain_ftrl(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choices(words[: 30 if i % 2 else 60], k=r.randint(1, 40)))) for i in range(90)] + [(200, None), (201, ""), (202, "w1 w1 w1 w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, label int")
    got = {x["doc_id"]: x["score"] for x in quality_model.classify(docs, labels, bits=12, epochs=3).collect()}
    learned = [(str(i), i % 2, t) for i, t in rows if i < 90 and zlib.crc32(str(i).encode()) % 5]
    score = plain_ftrl(learned, 12, 3)
    assert len(got) == len(rows) and all(abs(got[i] - score(t)) < 1e-4 for i, t in rows)


def test_top_k_prunes_and_saturates(spark):
    r = random.Random(8)
    groups = [(i, [(4.0 if i % 8 == d else 0.0) + r.uniform(-0.2, 0.2) for d in range(8)]) for i in range(800)]
    huge = [(2000 + i, [1e12 * (i + 1)] * 8) for i in range(4)] + [(2100, [1e308] * 8), (2120, [-1e308] * 8)]
    df = spark.createDataFrame(groups + huge, "vec_id long, embedding array<double>")
    got = topk.top_k(df, k=5, shard_rows=20, block_rows=8).collect()
    whole = {i: [math.floor(64 * x) if abs(64 * x) < 2**52 else int(max(-8e307, min(8e307, 64 * x))) for x in v] for i, v in groups + huge}
    want = set()
    for q in (i for i in whole if i % 20 == 0):
        scores = [(-max(-topk.LONG, min(topk.LONG, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:5])}
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_boxes_keep_queries_from_shards(spark):
    rows = [(i, [(1.0 if i % 4 == d else 0.0) for d in range(4)]) for i in range(400)]
    points = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 64)
    forest = topk.trees(topk.dealt(points, 400, 40))
    space = topk.boxes(forest)
    asked = points.filter("vec_id < 8").select(F.col("vec_id").alias("query_id"), "v", "dim", F.lit(0).alias("block"), F.lit(4096.0).alias("kth"))
    # only cells that hold the query's own direction can reach its own square
    sent = topk.due(asked, space, 0, 100).groupBy("query_id").count().collect()
    assert len(sent) == 8 and all(0 < x["count"] < forest.count() for x in sent)


def test_sifted_parts(spark):
    df = spark.createDataFrame([(i if i % 7 else None, i) for i in range(1000)], "key long, _bucket int")
    keys = df.filter("_bucket < 100").select("key").filter("key IS NOT NULL")
    maybe, clear = common.sifted(df, "key", common.bitmap(keys))
    held = {x["_bucket"] for x in maybe.collect()}
    assert {i for i in range(100) if i % 7} <= held and len(held) < 110
    assert maybe.columns == df.columns and maybe.count() + clear.count() == 1000
    assert clear.filter("key IS NULL").count() == 143
    nothing = common.sifted(df, "key", common.bitmap(keys.limit(0)))
    assert nothing[0].count() == 0 and nothing[1].count() == 1000


def test_deduplicate_with_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, 5, "x", 1), (2, text, 6, "y", 2), (None, text, 7, "z", 3), (4, "other words here to be kept", 8, "u", 4), (4, "a second text of the same id", 9, "v", 5), (6, None, 1, "w", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id long, dropped_id string, component_id long")
    kept = near_dup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(x["component_id"] for x in kept.collect()) == [1, 3, 4, 5, 6]


def test_ids_that_are_null_or_repeat(spark):
    text = " ".join(f"w{i}" for i in range(40))
    near = text.replace("w39", "x39")
    rows = [(None, text)] * 5 + [(None, near), (3, "nothing like it at all or so"), (3, text), (9, near)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((x["doc_id"] or 0, x["component_id"]) for x in got) == [(0, 3)] * 6 + [(3, 3), (3, 3), (9, 3)]
