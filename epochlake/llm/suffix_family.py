"""Long repeats across documents, by a logarithmic family of suffix arrays.

A byte is removed if a string of `window` (50) bytes that covers it also starts in a document with a
smaller id. Documents are added to the index in batches, in the order of their ids.

1. Sampled suffixes. Of every string of 50 bytes the suffix is kept that starts at the least hash of
   24 bytes in it, so equal strings keep the same suffix, wherever they are, and about one suffix in 14
   bytes is enough. An entry says which document, from which byte, how many strings share the suffix.
2. The family. A batch's entries form a suffix array for each bucket of hashed prefixes: sorted by a 64-bit
   hash of the suffix's first 24 bytes (which stands for byte order, so that buckets are even).
   In one pass by bucket a new batch's array is merge-scanned against the arrays of all levels, and is merged
   with the lowest levels as long as they hold as many batches as it does by then. So n batches leave at most
   log2(n) + 1 levels, and an entry is rewritten log2(n) times. What the scan finds are the
   entries, of the batch and of the levels, whose prefix is also another document's.
3. Comparing bytes. Entries found meet their text, and their strings (76 bytes at most) meet by prefix. Equal
   strings of 50 bytes are found by sorting and compared byte by byte; each stays in its document of the smallest id.
   What comes back are the strings that stay: a row for the first document of each, never one for
   every copy. Prefixes with many entries are dealt out by whole strings instead.
4. Exact copies of a text are one text, so a group of copies costs a narrow row each.

Entries travel as packed blocks, so Spark moves a row for a block of a bucket, and buckets and blocks of
documents are as many as the bytes ask for (`BUCKET_BYTES`).

Nulls and edge cases: a null text is empty and loses nothing; texts under 50 bytes lose nothing; a null id counts as the largest
id (2**63 - 1), so such rows lose what others have and nothing to each other; rows that repeat an id are equally small:
neither takes from the other; texts of any length are taken whole, and a run of one character is a repeat like others; an
empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, cut, looked_up, release, remove, scratch, sifted, sorted_groups

WINDOW, PREFIX = 50, 24
#: Prefixes in a window, and bytes of the longest string that one suffix stands for.
SHARE = WINDOW - PREFIX + 1
LONGEST = WINDOW + SHARE - 1
#: Bytes of text for each bucket, of those whose entries a task packs together, and of those that it cuts at once.
BUCKET_BYTES, SLICE_BYTES, PIECE = 2**23, 2**23, 2**20
#: Entries of a prefix from which its strings are dealt out one by one; of such prefixes there are at most HOT_KEYS.
HOT, HOT_KEYS = 20_000, 100_000
LAST = 2**63 - 1
PLACE = np.uint64((1 << 21) - 1)
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Columns of packed blocks: entries (key, rank, sub, at, n), strings that stay (rank, sub, at, mask).
ENTRY = ("u8", "i8", "i8", "u4", "u1")
STAY = ("i8", "i8", "u4", "u4")


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as one compressed block, byte by byte of the same weight together."""
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(block: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    n, sizes = int.from_bytes(block[:8], "little"), [np.dtype(k).itemsize for k in kinds]
    if not n:
        return [np.zeros(0, k) for k in kinds]
    raw = np.frombuffer(pa.decompress(block[8:], decompressed_size=n * sum(sizes), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def joined(blocks: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The columns of several blocks, one after another."""
    parts = [unpack(b, kinds) for b in blocks]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, k) for k in kinds]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefixes(x: np.ndarray) -> np.ndarray:
    """A hash of the PREFIX bytes from each place on."""
    n = len(x) - PREFIX + 1
    words = np.ndarray(len(x) - 7, "<u8", x, strides=(1,))
    h = words[:n] * BASE
    for k in range(8, PREFIX, 8):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[k : k + n]
    return mixed(h)


def sampled_suffixes(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, n, key) for texts that lie one after another in x, up to each of ends.

    From each start on n windows have the same suffix, of which key is the hash of the first bytes; every window
    inside a text is in exactly one row.
    """
    out = []
    for a in range(0, len(x) - WINDOW + 1, PIECE):
        y = x[a : a + PIECE + WINDOW - 1]
        h = prefixes(y)
        least = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while 2 * step <= SHARE:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < SHARE:
            least = np.minimum(least[: step - SHARE], least[SHARE - step :])
        inside = np.ones(len(least), bool)
        for e in (ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, a + len(y))] - a).tolist():
            inside[max(0, e - WINDOW + 1) : e] = False
        p = np.flatnonzero(inside)
        if not len(p):
            continue
        m = least[p]
        first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
        out.append((p[first] + a, np.diff(np.r_[first, len(p)]), h[(m[first] & PLACE).astype(np.int64)]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, edges) of an array of strings without nulls."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.cast(pa.large_binary())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    return data, edges - edges[0]


def by_bucket(bucket: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, edges): rows in the order of bucket and key, and where each bucket begins."""
    order = np.lexsort((key, bucket))
    b = bucket[order]
    return order, np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else np.zeros(1, np.int64)


def sampled(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, blob): packed entries of texts (rank, sub, text), sorted by key."""

    def slices(b):
        _, edges = bytes_of(b.column(2))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + SLICE_BYTES, "right")) - 1)
            yield b.slice(at, to - at)
            at = to

    def run(batches):
        for b in (part for whole in batches for part in slices(whole)):
            x, edges = bytes_of(b.column(2))
            start, n, key = sampled_suffixes(x, edges[1:])
            doc = np.searchsorted(edges, start, "right") - 1
            rank, sub = b.column(0).to_numpy()[doc], b.column(1).to_numpy()[doc]
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order, cuts = by_bucket(bucket, key)
            names, blobs = [], []
            columns = (key, rank, sub, (start - edges[doc]).astype("u4"), n.astype("u1"))
            for s, e in zip(cuts, cuts[1:], strict=False):
                names.append(int(bucket[order[s]]))
                blobs.append(pack(*(c[order[s:e]] for c in columns)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return texts.select("rank", "sub", "text").mapInArrow(run, "bucket int, blob binary")


class Family:
    """Levels of suffix arrays in the shared folder, the lowest last; `add` takes batches in the order of their documents' ranks.

    What `add` finds is kept beside the levels: `found` has the entries that share a prefix with another document, as
    blocks (block, blob) by document, `hot` the prefixes (key, n) with more than `HOT` of them.
    """

    SCHEMA = "bucket int, key long, n long, blob binary"
    LEVEL, FOUND, HOT = 0, 1, 2

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.blocks = spark, buckets, buckets | 1
        self.levels: list[tuple[int, str]] = []
        self.made: list[str] = []

    def rows(self, path: str, kind: int) -> DataFrame:
        return self.spark.read.schema(f"{self.SCHEMA}, kind int").parquet(path).filter(F.col("kind") == kind).drop("kind")

    def add(self, texts: DataFrame, keep: bool = True) -> None:
        """Scans a batch (rank, sub, text) against all levels and takes it in. Ranks aren't below those of earlier batches.

        Without `keep` the batch is only scanned and the levels stay as they are: for a last batch.
        """
        size, carried = 1, []
        kept = list(self.levels)
        while keep and kept and kept[-1][0] == size:
            carried.append(kept.pop())
            size *= 2
        rows = sampled(texts, self.buckets).select("bucket", F.lit(-1).alias("level"), "blob")
        for k, (_, path) in enumerate([*carried, *kept]):
            rows = rows.unionByName(self.rows(path, self.LEVEL).select("bucket", F.lit(k).alias("level"), "blob"))
        n_carried, blocks = len(carried), self.blocks

        def merged(batches):
            for (bucket,), t in sorted_groups(batches, 1):
                level, blob = t.column("level").to_numpy(), t.column("blob")
                take = lambda at: joined([blob[int(i)].as_py() for i in np.flatnonzero(at)], ENTRY)  # noqa: E731, B023
                new, low, high = take(level == -1), take((level >= 0) & (level < n_carried)), take(level >= n_carried)
                old = [np.concatenate(c) for c in zip(low, high, strict=True)]
                # sorted runs one after another, which a stable sort merges
                new, old = ([c[order] for c in side] for side in (new, old) for order in [np.argsort(side[0], kind="stable")])
                first = np.flatnonzero(np.r_[True, new[0][1:] != new[0][:-1]][: len(new[0])])
                count = np.diff(np.r_[first, len(new[0])])
                key = new[0][first]
                at, to = np.searchsorted(old[0], key, "left"), np.searchsorted(old[0], key, "right")
                several = np.minimum.reduceat(new[1], first) != np.maximum.reduceat(new[1], first) if len(first) else np.zeros(0, bool)
                met = several | (to > at)
                mine, theirs = np.repeat(met, count), np.zeros(len(old[0]) + 1, np.int64)
                np.add.at(theirs, at[met], 1)
                np.add.at(theirs, to[met], -1)
                theirs = np.cumsum(theirs)[:-1] > 0
                found = [np.concatenate([a[mine], b[theirs]]) for a, b in zip(new, old, strict=True)]
                block = (found[1] ^ found[2]) % blocks
                order, cuts = by_bucket(block, found[3])
                for s, e in zip(cuts, cuts[1:], strict=False):
                    yield Family.FOUND, int(block[order[s]]), None, None, pack(*(c[order[s:e]] for c in found))
                for k in np.flatnonzero(met & (count + to - at > HOT)):
                    yield Family.HOT, 0, int(key[k].astype(np.int64)), int(count[k] + to[k] - at[k]), None
                if keep:
                    taken = [np.concatenate(c) for c in zip(new, low, strict=True)]
                    order = np.argsort(taken[0], kind="stable")
                    yield Family.LEVEL, int(bucket), None, None, pack(*(c[order] for c in taken))

        def run(batches):
            for row in merged(batches):
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["kind", "bucket", "key", "n", "blob"])

        where = scratch(self.spark, "suffixes")
        dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "level")
        dealt.mapInArrow(run, f"kind int, {self.SCHEMA}").write.partitionBy("kind").parquet(where)
        self.made.append(where)
        if keep:
            self.levels = [*kept, (size, where)]
        for _, path in carried:
            remove(self.spark, f"{path}/kind={self.LEVEL}")

    def found(self) -> DataFrame:
        parts = [self.rows(p, self.FOUND) for p in self.made]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.select(F.col("bucket").alias("block"), "blob")

    def hot(self) -> DataFrame:
        """(key, n) of prefixes with more than HOT entries; at most HOT_KEYS of them, those with the most."""
        every = [self.rows(p, self.HOT) for p in self.made]
        rows = every[0]
        for p in every[1:]:
            rows = rows.unionByName(p)
        return rows.groupBy("key").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "key").limit(HOT_KEYS)

    def drop_levels(self) -> None:
        for _, path in self.levels:
            remove(self.spark, f"{path}/kind={self.LEVEL}")
        self.levels = []


def strings(x: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows of LONGEST bytes: of x from each start on WINDOW - 1 + n bytes, then zeros."""
    padded = np.concatenate([x, np.zeros(LONGEST, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, LONGEST)[start]
    rows[np.arange(LONGEST) >= (n.astype(np.int64) + WINDOW - 1)[:, None]] = 0
    return rows


def rolled(rows: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... bytes of each row; a row for each length."""
    h = np.zeros((LONGEST + 1, len(rows)), np.uint64)
    for k, column in enumerate(np.ascontiguousarray(rows.T)):
        h[k + 1] = h[k] * BASE + column + np.uint64(1)
    return h


def windows(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash) of each of the n windows of every row."""
    h, n = rolled(rows), n.astype(np.int64)
    power = np.uint64(pow(int(BASE), WINDOW, 2**64))
    row = np.repeat(np.arange(len(rows)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, place, mixed(h[place + WINDOW, row] - h[place, row] * power)


#: Entries whose strings a task has in all their forms at once.
ROWS = 2**16


def texts_and_entries(texts: DataFrame, found: DataFrame, blocks: int) -> DataFrame:
    """(block, kind, rank, sub, text, blob): entries (kind 0) before the texts (kind 1) of their block, in one partition."""
    block = F.pmod(F.col("rank").bitwiseXOR(F.col("sub")), F.lit(blocks)).cast("int")
    a = texts.select(block.alias("block"), F.lit(1).alias("kind"), "rank", "sub", "text", F.lit(None).cast("binary").alias("blob"))
    b = found.select("block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("rank"), F.lit(None).cast("long").alias("sub"), F.lit(None).cast("string").alias("text"), "blob")
    return b.unionByName(a).repartition("block").sortWithinPartitions("block", "kind")


def unique_entries(blobs: list[bytes]) -> list[np.ndarray]:
    """Entries in the order of (rank, sub, at), each once: a scan of a later batch may find one again."""
    e = joined(blobs, ENTRY)
    order = np.lexsort((e[3], e[2], e[1]))
    e = [c[order] for c in e]
    again = np.r_[False, (e[1][1:] == e[1][:-1]) & (e[2][1:] == e[2][:-1]) & (e[3][1:] == e[3][:-1])][: len(e[0])]
    return [c[~again] for c in e]


def cut_strings(texts: DataFrame, family: Family) -> DataFrame:
    """(bucket, blob, bytes): strings of the entries found, each only for the smallest rank that a block knows."""
    hot = np.sort(np.array([r[0] for r in family.hot().select("key").collect()], np.int64).view(np.uint64))
    buckets = family.buckets

    def thinned(e: list[np.ndarray], rows: np.ndarray):
        """Of equal strings under one key those of the smallest rank; and the strings of hot keys one by one."""
        burning = np.isin(e[0], hot)
        if burning.any():
            at = np.flatnonzero(burning)
            row, place, h = windows(rows[at], e[4][at])
            single = np.zeros((len(row), LONGEST), np.uint8)
            single[:, :WINDOW] = np.lib.stride_tricks.sliding_window_view(rows[at], WINDOW, axis=1)[row, place]
            row = at[row]
            parts = [h, e[1][row], e[2][row], (e[3][row] + place).astype("u4"), np.ones(len(row), "u1")]
            e, rows = [np.concatenate([c[~burning], p]) for c, p in zip(e, parts, strict=True)], np.concatenate([rows[~burning], single])
        same = rolled(rows)[LONGEST] ^ mixed(e[0] + e[4])
        order = np.lexsort((e[1], same))
        e, rows, same = [c[order] for c in e], rows[order], same[order]
        # a row that equals the one before it, and has another rank than the first of these, isn't the smallest
        equal = np.r_[False, (same[1:] == same[:-1]) & (e[0][1:] == e[0][:-1]) & (e[4][1:] == e[4][:-1]) & (rows[1:] == rows[:-1]).all(1)][: len(rows)]
        head = np.maximum.accumulate(np.where(equal, 0, np.arange(len(rows)))) if len(rows) else np.zeros(0, np.int64)
        keep = e[1] == e[1][head]
        return [c[keep] for c in e], rows[keep]

    def packed(e, rows):
        bucket = (e[0] % np.uint64(buckets)).astype(np.int64)
        order, cuts = by_bucket(bucket, e[0])
        out = [], [], []
        for s, t in zip(cuts, cuts[1:], strict=False):
            o = order[s:t]
            out[0].append(int(bucket[o[0]]))
            out[1].append(pack(*(c[o] for c in e)))
            out[2].append(pa.compress(rows[o].tobytes(), codec="zstd", asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["bucket", "blob", "bytes"])

    def run(batches):
        block, blobs, entries, first = None, [], None, {}
        for b in batches:
            kinds, names = b.column("kind").to_numpy(), b.column("block").to_numpy()
            x, edges = bytes_of(b.column("text").fill_null(""))
            held, start, n_held = [], [], 0
            for i in range(b.num_rows):
                if names[i] != block:
                    block, blobs, entries = names[i], [], None
                if kinds[i] == 0:
                    blobs.append(b.column("blob")[i].as_py())
                    continue
                if entries is None:
                    entries, blobs = unique_entries(blobs), []
                    new = np.flatnonzero(np.r_[True, (entries[1][1:] != entries[1][:-1]) | (entries[2][1:] != entries[2][:-1])][: len(entries[1])])
                    ends = np.r_[new[1:], len(entries[1])]
                    first = {(r, s): (p, q) for r, s, p, q in zip(entries[1][new].tolist(), entries[2][new].tolist(), new.tolist(), ends.tolist(), strict=True)}
                p, q = first.get((b.column("rank")[i].as_py(), b.column("sub")[i].as_py()), (0, 0))
                for s in range(p, q, ROWS):
                    held.append([c[s : min(q, s + ROWS)] for c in entries])
                    start.append(edges[i] + held[-1][3].astype(np.int64))
                    n_held += len(start[-1])
                    if n_held >= ROWS:
                        e, at = [np.concatenate(c) for c in zip(*held, strict=True)], np.concatenate(start)
                        yield packed(*thinned(e, strings(x, at, e[4])))
                        held, start, n_held = [], [], 0
            if held:
                e, at = [np.concatenate(c) for c in zip(*held, strict=True)], np.concatenate(start)
                yield packed(*thinned(e, strings(x, at, e[4])))

    return texts_and_entries(texts, family.found(), family.blocks).mapInArrow(run, "bucket int, blob binary, bytes binary")


def refined(group: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Groups (numbers in order) of windows w with equal hashes, split where bytes differ."""
    names: dict[tuple[int, bytes], int] = {}
    return np.array([names.setdefault((g, r.tobytes()), len(names)) for g, r in zip(group.tolist(), w, strict=True)], np.int64)


def first_holders(e: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """For each entry a mask of those of its windows whose smallest rank is its own."""
    row, place, h = windows(rows, e[4])
    order = np.argsort(h, kind="stable")
    row, place, h = row[order], place[order], h[order]
    new = np.r_[True, h[1:] != h[:-1]][: len(h)]
    group = np.cumsum(new) - 1
    view = np.lib.stride_tricks.sliding_window_view(rows, WINDOW, axis=1)
    differs = np.zeros(len(h), bool)
    at = np.flatnonzero(~new)
    for s in range(0, len(at), ROWS):
        k = at[s : s + ROWS]
        differs[k] = (view[row[k], place[k]] != view[row[k - 1], place[k - 1]]).any(1)
    if differs.any():
        # one hash for different bytes
        again = np.flatnonzero(np.isin(group, np.unique(group[differs])))
        group[again] = group[-1] + 1 + refined(group[again], view[row[again], place[again]])
        order = np.argsort(group, kind="stable")
        row, place, group = row[order], place[order], group[order]
        new = np.r_[True, group[1:] != group[:-1]]
    starts = np.flatnonzero(new)
    rank = e[1][row]
    least = np.minimum.reduceat(rank, starts) if len(starts) else rank
    stays = rank == np.repeat(least, np.diff(np.r_[starts, len(rank)]))
    return np.bincount(row[stays], 2.0 ** place[stays], len(rows)).astype(np.uint32)


def staying(cut_up: DataFrame, blocks: int) -> DataFrame:
    """(block, blob): for each entry that holds a string first, a mask of these strings."""

    def run(batches):
        for _, t in sorted_groups(batches, 1):
            e = joined(t.column("blob").to_pylist(), ENTRY)
            sizes = [int.from_bytes(b[:8], "little") for b in t.column("blob").to_pylist()]
            raw = [np.frombuffer(pa.decompress(b, decompressed_size=n * LONGEST, codec="zstd", asbytes=True), np.uint8).reshape(n, LONGEST) for b, n in zip(t.column("bytes").to_pylist(), sizes, strict=True)]
            rows = np.concatenate(raw)
            order = np.argsort(e[0], kind="stable")
            e, rows = [c[order] for c in e], rows[order]
            # whole keys at a time
            edges = np.flatnonzero(np.r_[True, e[0][1:] != e[0][:-1], True])
            steps = edges[np.unique(np.searchsorted(edges, np.r_[np.arange(0, len(rows), ROWS), len(rows)]))]
            mask = np.concatenate([first_holders([c[s:f] for c in e], rows[s:f]) for s, f in zip(steps, steps[1:], strict=False)])
            block = (e[1] ^ e[2]) % blocks
            at = np.flatnonzero(mask)
            order, cuts = by_bucket(block[at], e[3][at])
            names, blobs = [], []
            for s, f in zip(cuts, cuts[1:], strict=False):
                o = at[order[s:f]]
                names.append(int(block[o[0]]))
                blobs.append(pack(e[1][o], e[2][o], e[3][o], mask[o]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "blob"])

    return cut_up.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "block int, blob binary")


def spans_of(found: DataFrame, stay: DataFrame) -> DataFrame:
    """(rank, sub, starts, stops): the removed runs of bytes of each text that loses any."""

    def expanded(doc, at, n):
        return np.repeat(doc << 32 | at.astype(np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def run(batches):
        for _, t in sorted_groups(batches, 1):
            kind, blob = t.column("kind").to_numpy(), t.column("blob")
            e = unique_entries([blob[int(i)].as_py() for i in np.flatnonzero(kind == 0)])
            k = joined([blob[int(i)].as_py() for i in np.flatnonzero(kind == 1)], STAY)
            # a number for each text, of those that have entries
            names = np.unique(np.stack([e[1], e[2]], 1), axis=0)
            place = {(r, s): i for i, (r, s) in enumerate(names.tolist())}
            number = lambda r, s: np.array([place[p] for p in zip(r.tolist(), s.tolist(), strict=True)], np.int64)  # noqa: E731, B023
            every = expanded(number(e[1], e[2]), e[3], e[4].astype(np.int64))
            bits = (k[3][:, None] >> np.arange(SHARE, dtype=np.uint32)) & 1
            row, bit = np.nonzero(bits)
            kept = (number(k[0], k[1]) << 32 | k[2].astype(np.int64))[row] + bit
            lost = np.setdiff1d(every, kept)
            if not len(lost):
                continue
            # a run goes on while windows touch; the next text is further away than any window
            new = np.flatnonzero(np.r_[True, np.diff(lost) > WINDOW])
            start, stop = lost[new], lost[np.r_[new[1:], len(lost)] - 1] + WINDOW
            doc = start >> 32
            edges = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
            offsets = pa.array(edges, pa.int32())
            at = names[doc[edges[:-1]]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[:, 0]), pa.array(at[:, 1]), *(pa.ListArray.from_arrays(offsets, pa.array(x & (2**32 - 1), pa.int64())) for x in (start, stop))], names=["rank", "sub", "starts", "stops"],
            )

    rows = found.select("block", F.lit(0).alias("kind"), "blob").unionByName(stay.select("block", F.lit(1).alias("kind"), "blob"))
    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, "rank long, sub long, starts array<long>, stops array<long>")


def based(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank"))


def digest():
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def specials(narrow: DataFrame) -> DataFrame:
    """(rank, digest, whole, sub) of rows whose text or id is another row's too: is it a copy of a smaller id's text; a number for its text, if the id has several."""
    total = narrow.count()
    copies = narrow.groupBy("digest").agg(F.count("*").alias("n"), F.min("rank").alias("least")).filter("n > 1")
    several = narrow.groupBy("rank").agg(F.count("*").alias("n"), (F.min("digest") != F.max("digest")).alias("several")).filter("n > 1")
    met = looked_up(looked_up(narrow.select("rank", "digest"), cut(copies), "digest", "n", total), cut(several), "rank", "n", total)
    sub = F.when(F.coalesce("several", F.lit(False)), F.xxhash64("digest")).otherwise(0)
    return met.filter("least IS NOT NULL OR several IS NOT NULL").select("rank", "digest", F.coalesce(F.col("least") < F.col("rank"), F.lit(False)).alias("whole"), sub.alias("sub")).distinct()


def placed(base: DataFrame, special: DataFrame) -> DataFrame:
    """base with `whole` and `sub`; only rows whose id may be special are shuffled."""
    maybe, clear = sifted(base, "rank", bitmap(special.select("rank")))
    met = maybe.withColumn("digest", digest()).join(special, ["rank", "digest"], "left")
    done = met.select(*base.columns, F.coalesce("whole", F.lit(False)).alias("whole"), F.coalesce("sub", F.lit(0).cast("long")).alias("sub"))
    return clear.select("*", F.lit(False).alias("whole"), F.lit(0).cast("long").alias("sub")).unionByName(done)


def distinct_texts(base: DataFrame, special: DataFrame) -> DataFrame:
    """(rank, sub, text) of texts that are long enough and no copies of a smaller id's."""
    rows = placed(base.filter(F.octet_length("text") >= WINDOW), special).filter("NOT whole")
    # several texts of one id, as of all rows without one, once each
    one = rows.filter("sub <> 0").groupBy("rank", "sub").agg(F.first("text").alias("text"))
    return rows.filter("sub = 0").select("rank", "sub", "text").unionByName(one.select("rank", "sub", "text"))


def repeats(docs: DataFrame, batches: int = 4) -> DataFrame:
    """(doc_id, text, spans) of every row of docs: spans are the runs [start, stop) of bytes that a smaller id's document has in strings of WINDOW bytes."""
    spark = docs.sparkSession
    base = based(docs)
    narrow = cut(base.select("rank", F.octet_length("text").alias("n_bytes"), digest().alias("digest")).filter(F.col("n_bytes") >= WINDOW))
    special = cut(specials(narrow))
    shares = [k / batches for k in range(1, batches)]
    size, at = narrow.agg(F.sum("n_bytes"), F.percentile_approx("rank", shares, 10_000) if shares else F.array()).first()
    release(spark)
    family = Family(spark, max(8, -(-(size or 0) // BUCKET_BYTES)))
    edges = sorted(set(at or []))
    # batches by id: up to each edge, and the rest; a batch without texts is none
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = base
        if low is not None:
            part = part.filter(F.col("rank") > low)
        if high is not None:
            part = part.filter(F.col("rank") <= high)
        # no batch comes after the last
        family.add(distinct_texts(part, special), keep=high is not None)
        release(spark)
    family.drop_levels()
    stay = cut(staying(cut_strings(distinct_texts(base, special), family), family.blocks))
    release(spark)
    spans = cut(spans_of(family.found(), stay))
    release(spark)
    here = placed(base, special)
    maybe, clear = sifted(here, "rank", bitmap(spans.select("rank")))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    found = maybe.join(spans, ["rank", "sub"], "left").withColumn("spans", F.coalesce(F.arrays_zip(F.col("starts").alias("start"), F.col("stops").alias("stop")).cast("array<struct<start:bigint,stop:bigint>>"), none))
    every = found.select("doc_id", "text", "whole", "spans").unionByName(clear.select("doc_id", "text", "whole", none.alias("spans")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("stop")))
    return every.select("doc_id", "text", F.when(F.col("whole"), whole).otherwise(F.col("spans")).alias("spans"))


def kept(found: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): what is left of rows (doc_id, text, spans), as bytes."""

    def run(batches):
        for b in batches:
            texts, spans = b.column(1).cast(pa.binary()), b.column(2)
            edges = spans.offsets.to_numpy()
            flat = spans.flatten()
            starts, stops = (flat.field(k).to_numpy() for k in (0, 1))
            low = edges[0]
            out = [], [], []
            for i in range(b.num_rows):
                t = texts[i].as_py() or b""
                s, e = starts[edges[i] - low : edges[i + 1] - low].tolist(), stops[edges[i] - low : edges[i + 1] - low].tolist()
                out[0].append(len(t))
                out[1].append(len(s))
                out[2].append(b"".join([t[p:q] for p, q in zip([0, *e], [*s, len(t)], strict=True)]) if s else t)
            removed = [n - len(k) for n, k in zip(out[0], out[2], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(removed, pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return found.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame, batches: int = 4) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    return kept(repeats(docs, batches)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
