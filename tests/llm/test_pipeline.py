"""The pipeline against a version of each stage that is written another way: SQL, all pairs, the tokenizer library."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from epochlake.llm import pii, queries, sql
from epochlake.llm.queries import tokenizer_model

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
COMMON = "the of and to in a is that it with was".split()


def fixture_documents():
    rows = []
    for i in range(80):
        r = random.Random(i)
        text = ". ".join(" ".join(r.choice(COMMON) if r.random() < 0.4 else r.choice("river stone lamp paper cloud field road tower light grain".split()) + str(r.randrange(30)) for _ in range(12)) for _ in range(12))
        rows.append([i, text, "en", f"s{i % 4}", len(text)])
    for i in range(80, 100):
        w = rows[i - 80][1].split()
        w[3 * (i - 80)] = f"edit{i}"
        rows.append([i, " ".join(w) + (" mail a.b@mail.example.org" if i % 2 else ""), "en", "s0", 1])
    rows.append([100, rows[1][1], "en", None, 1])
    rows += [[101 + k, "# ".join(rows[k + 5][1].split()), "en", "s1", 1] for k in range(4)]
    rows += [[110, None, "en", "s1", None], [111, "", None, None, 0], [112, rows[9][1] + " call +1 (555) 123-4567 now", "en", "s2", 1], [113, "word " * 300, "en", "s2", 1]]
    return rows


def as_table(con, rows):
    t = pa.table({n: pa.array([r[k] for r in rows], pa.string() if n in ("text", "lang", "source") else pa.int64()) for k, n in enumerate(NAMES)})
    con.register("documents", t)


def components(rows):
    sets = []
    for r in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", r[1])]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    first = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = first[i], first[j]
                first = [min(a, b) if f in (a, b) else f for f in first]
    return first


def test_pipeline_against_other_versions(spark, tmp_path):
    import sentencepiece

    rows = fixture_documents()
    con = duckdb.connect()
    as_table(con, rows)
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op4_quality_rules']}) WHERE kept").fetchall()}
    assert 113 not in kept and 110 not in kept and not kept & {101, 102, 103, 104} and {0, 1, 50} <= kept
    rows = sorted([r for r in rows if r[0] in kept])
    first = components(rows)
    rows = [r for k, r in enumerate(rows) if first[k] == k]
    assert 100 not in {r[0] for r in rows}
    rows = [[r[0], t := pii.redacted(r[1]), r[2], r[3], len(t)] for r in rows]
    as_table(con, rows)
    taken = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, taken // size FROM ({sql.MIX})").fetchall()}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_model())
    want = Counter()
    for r in rows:
        ids = library.encode(r[1], add_bos=True, add_eos=True)
        want[(r[0], r[3], len(ids), b"".join(i.to_bytes(4, "little") for i in ids), hashlib.sha256(library.decode(ids).encode()).hexdigest())] += taken[r[0]]
    got = Counter((r["doc_id"], r["source"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    con = duckdb.connect()
    as_table(con, fixture_documents()[:30])
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == NAMES
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    import os

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in want.description)
    got = queries.QUERIES[name](spark, data).select(*names)
    order = [[d[0] for d in want.description].index(n) for n in names]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(repr([plain(v) for v in r]) for r in got.collect()) == sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall())


def test_stages_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    text = " ".join(f"word{i % 23} of the and {i}" for i in range(60))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text + " once more than before", "en", "a", 6), (None, text, None, None, None), (3, None, "en", "a", 0), (4, "", "xx", None, 0), (5, f"mail jane@example.org {text[::-1]}", None, "b", 7), (6, "x " * 30_000, "en", "b", 1)]
    extra = ["row", "q", "r_lang", "node", "kept", "dropped_id", "_bucket", "_bits", "ids", "decoded", "place", "n", "source_size"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(c).alias(c) for c in extra])
    for empty in (False, True):
        found = docs.limit(0) if empty else docs
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            columns = found.columns
            found = stage(spark, found, None)
            assert name == "pieces" or found.columns == columns
            found.write.parquet(f"{tmp_path}/{empty}-{k}")
            found = spark.read.parquet(f"{tmp_path}/{empty}-{k}")
        assert found.columns[:3] == ["doc_id", "source", "n_tokens"]
        ids = {r["doc_id"] for r in found.collect()}
        assert ids <= ({None, 1, 5} if not empty else set()) and (empty or {1, 5} & ids)
