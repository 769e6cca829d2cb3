"""Removal of long repeats against a plain version; nulls, copies, repeated ids, runs of one character, hot prefixes, level merges."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.llm import suffix_family

SCHEMA = "doc_id long, text string"
END = 2**63 - 1


def plain(rows):
    """By a table of all strings of 50 bytes."""
    first: dict[bytes, int] = {}
    raw = [(END if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            first[s] = min(first.get(s, END), i)
    out = []
    for (doc_id, _), (i, b) in zip(rows, raw, strict=True):
        lost = [False] * len(b)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                lost[p : p + 50] = [True] * 50
        runs = sum(x and not (k and lost[k - 1]) for k, x in enumerate(lost))
        out.append((doc_id, len(b), sum(lost), runs, hashlib.sha256(bytes(c for c, x in zip(b, lost, strict=True) if not x)).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, parts=3, **kw):
    df = suffix_family.digests(spark.createDataFrame(rows, SCHEMA).repartition(parts), **kw)
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmno") for _ in range(r.randrange(2, 8))) for _ in range(n))


def odd_rows():
    passage, other = prose(1, 30), prose(2, 14)
    r = random.Random(3)
    rows = [(i, f"{prose(100 + i, r.randrange(3, 60))} {passage if i % 3 else other} {prose(200 + i, 20)}") for i in range(40)]
    rows += [(50 + i, rows[4][1]) for i in range(6)] + [(60, None), (61, ""), (62, "short"), (63, passage[:49]), (64, passage[:50]), (65, passage[1:52] + "é中😀" * 30), (66, "é中😀" * 40)]
    rows += [(70, "x" * 400), (71, "x" * 90 + "y" + "x" * 49), (72, " " * 3000), (73, " " * 51), (74, f"{other} {other} {other}"), (75, prose(5, 4000) + passage)]
    # one id for several texts, and the same row twice; null ids
    rows += [(80, prose(6, 40)), (80, prose(6, 40)), (80, f"{prose(6, 40)} {prose(7, 20)}"), (81, f"{prose(7, 20)} {prose(6, 40)}")]
    rows += [(None, passage + " once"), (None, prose(8, 40)), (None, prose(8, 40)), (None, prose(8, 40) + " and more"), (None, rows[4][1]), (-5, prose(9, 30)), (82, prose(9, 30))]
    return rows


@pytest.mark.parametrize("batches", [1, 5])
def test_against_a_plain_version(spark, batches):
    rows = odd_rows()
    assert found(spark, rows, batches=batches) == plain(rows)


def test_hot_prefixes_are_dealt_by_strings(spark, monkeypatch):
    rows = odd_rows()
    monkeypatch.setattr(suffix_family, "HOT", 3)
    assert found(spark, rows, 2, batches=3) == plain(rows)


def test_an_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == []
    rows = [(1, prose(1, 30)), (2, "a " + prose(1, 30))]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("rank", "sub", "digest", "whole", "spans", "bucket", "blob", "n", "starts", "kept")})
    assert sorted(map(tuple, suffix_family.digests(df).collect()), key=repr) == plain(rows)


def test_every_window_is_sampled_once_and_by_its_bytes(monkeypatch):
    monkeypatch.setattr(suffix_family, "PIECE", 300)
    texts = [prose(1, 200).encode(), b"z" * 500, prose(1, 200).encode(), b"q" * 49, prose(2, 9).encode()]
    x, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    start, n, key = suffix_family.sampled_suffixes(x, ends)
    windows = np.concatenate([np.arange(s, s + m) for s, m in zip(start, n, strict=True)])
    inside = [e - len(t) + p for e, t in zip(ends.tolist(), texts, strict=True) for p in range(len(t) - 49)]
    assert sorted(windows.tolist()) == inside
    by = {}
    for s, m, k in zip(start.tolist(), n.tolist(), key.tolist(), strict=True):
        for p in range(s, s + m):
            by.setdefault(x[p : p + 50].tobytes(), set()).add(k)
    assert all(len(k) == 1 for k in by.values())


def test_equal_hashes_of_other_bytes_are_told_apart(monkeypatch):
    monkeypatch.setattr(suffix_family, "windows", lambda rows, n: (np.repeat(np.arange(len(rows)), n), np.zeros(len(rows), int), np.full(len(rows), 7, np.uint64)))
    rows = np.zeros((4, suffix_family.LONGEST), np.uint8)
    rows[:, :50] = np.frombuffer(b"".join(c * 50 for c in (b"a", b"b", b"a", b"b")), np.uint8).reshape(4, 50)
    entries = [np.zeros(4, "u8"), np.array([3, 5, 4, 2], "i8"), np.zeros(4, "i8"), np.zeros(4, "u4"), np.ones(4, "u1")]
    assert suffix_family.first_holders(entries, rows).tolist() == [1, 0, 0, 1]


def test_levels_merge_geometrically(spark):
    family = suffix_family.Family(spark, 4)
    sizes = []
    for k in range(6):
        rows = [(10 * k + i, 0, prose(10 * k + i, 40)) for i in range(5)]
        family.add(spark.createDataFrame(rows, "rank long, sub long, text string"))
        sizes.append([s for s, _ in family.levels])
        held = [family.rows(p, family.LEVEL) for _, p in family.levels]
        for rows_of in held:
            for r in rows_of.collect():
                keys = suffix_family.unpack(r["blob"], suffix_family.ENTRY)[0]
                assert (keys[1:] >= keys[:-1]).all()
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2]]
    assert family.found().count() == 0
