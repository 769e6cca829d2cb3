"""Near-duplicate documents by MinHash, found with an inverted join of signature coordinates.

1. Sets. A text, A-Z lower-cased, becomes the set of the 64-bit hashes of its
   5-word shingles. Documents with equal sets are one node (a digest of the set),
   so exact copies cost a row each and no pairs.
2. Signatures. K coordinates, each the least value of the set under its own hash;
   a coordinate and its value are a token, and a node is posted under each of its
   K tokens.
3. Prefix and skip. Two nodes with T or more equal coordinates share a token among
   the K - T + 1 rarest of each, so the T - 1 most frequent tokens of a node are
   skipped: they are where long posting lists of common passages are. Tokens of one
   node alone need no list at all.
4. Collisions are counted inside each posting list on short signatures, in blocks
   where a list is long; what comes out are the links from each member of a group
   to the group's first node, never its pairs.
5. Groups of linked nodes are then confirmed on full sets: nodes are linked where
   100 * intersection >= 75 * union. A group is searched from node to node among
   those not reached yet, so a dense group of m costs about m comparisons.
   Groups larger than a task's share are dealt to blocks and all pairs of blocks.
6. Connected components by label propagation with pointer jumping.

At a similarity of 0.75 a pair has 48 of 64 equal coordinates on average with a
standard deviation of 3.5; T = 29 misses it with a probability below 1e-7.

Nulls and edge cases: a null or blank text has no set, is linked with nothing and
is its own component; documents that repeat an id are one by their text; a null
doc_id is linked like others but never names a component (component_id is null
only if no linked document has an id) and isn't kept; very long texts are taken
whole, as one set each, and ties go to the smallest id; an empty table gives an empty table; other columns pass through `deduplicate`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, cut, fresh, looked_up, sifted, sorted_groups

K, T = 64, 29
WIDTH = 5
#: Nodes of one block of a posting list, and shingles of one block of a group.
LIST_BLOCK, GROUP_BLOCK = 4096, 2_000_000
CACHE_ENTRIES = 500_000
_rng = np.random.default_rng(20_240_101)
FACTORS = _rng.integers(0, 2**63, K, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 2**63, K, np.uint64)
PLACES = _rng.integers(0, 2**63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)
COORDINATE = np.arange(K, dtype=np.uint64) << np.uint64(58)


class WordHashes(dict):
    """64-bit hash of a word, kept for the next time."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, words: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; empty without words."""
    # as bytes, lower() and split() know ASCII letters and ASCII white space only
    found = (text or "").encode("utf-8", "replace").lower().split()
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    if len(h) < WIDTH:
        return mixed(np.array([(h * PLACES[: len(h)]).sum() + np.uint64(len(h))], np.uint64)) if len(h) else h
    n = len(h) - WIDTH + 1
    total = np.zeros(n, np.uint64)
    for j in range(WIDTH):
        total += h[j : j + n] * PLACES[j]
    return np.unique(mixed(total + np.uint64(WIDTH)))


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signature(s: np.ndarray) -> np.ndarray:
    least = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        np.minimum(least, ((s[at : at + 4096, None] ^ OFFSETS) * FACTORS).min(0), out=least)
    return ((least >> np.uint64(6)) | COORDINATE).view(np.int64)


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, tokens); node and tokens are null where there is no set."""
    pair = docs.select("doc_id", "text")

    def run(batches):
        words = WordHashes()
        for b in batches:
            every = [shingles(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in every], pa.int64()), pa.array([digest(s) if len(s) else None for s in every], pa.binary()),
                 pa.array([signature(s) if len(s) else None for s in every], pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "node", "tokens"],
            )

    schema = pair.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("binary").alias("node"), F.lit(None).cast("array<bigint>").alias("tokens")).schema
    return pair.mapInArrow(run, schema)


def first_reached(n: int, near) -> np.ndarray:
    """For each of n items the first item of its component; near(i, others) says which of others are linked with i."""
    first, left = np.arange(n), np.arange(n)
    while len(left):
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            hit = near(todo.pop(), left)
            reached, left = left[hit], left[~hit]
            first[reached] = root
            todo.extend(reached)
    return first


def links_of(groups):
    """Batches of links (a, b) from (nodes, first), from each node that isn't its component's first to that one."""
    a, b = [], []
    give = lambda: pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
    for nodes, first in groups:
        at = np.flatnonzero(first != np.arange(len(first)))
        a += [nodes[i] for i in at]
        b += [nodes[first[i]] for i in at]
        if len(a) > 10_000:
            yield give()
            a, b = [], []
    yield give()


def in_blocks(df: DataFrame, size, key: list[str]) -> DataFrame:
    """Deals the rows of each key to ceil(size) blocks and gives each row to all pairs of blocks with its own: columns i, j."""
    n = F.greatest(F.lit(1), F.ceil(size)).cast("long")
    own = df.withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    paired = other.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("n", "own", "other")
    return paired.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j", "node")


def collisions(nodes: DataFrame) -> DataFrame:
    """Links (a, b) from each node to the first node of its group, over all groups of nodes that T equal coordinates link."""
    posted = nodes.select("node", F.explode("tokens").alias("token"))
    lists = posted.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    by_node = posted.join(lists, "token").groupBy("node").agg(F.collect_list(F.struct("df", "token")).alias("shared"))
    # of its K tokens a node skips the T - 1 most frequent
    prefix = by_node.filter(F.size("shared") >= T).select("node", F.explode(F.slice(F.sort_array("shared"), F.lit(1), F.size("shared") - (T - 1))).alias("p"))
    short = nodes.select("node", F.transform("tokens", lambda t: (F.shiftright(t, 8).bitwiseAND(F.lit(65535).cast("long")) - 32768).cast("short")).alias("short"))
    rows = prefix.select("node", "p.token", "p.df").join(short, "node")

    def groups(batches):
        for _, t in sorted_groups(batches, 3):
            if t.num_rows > 1:
                s = t.column("short").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, K)
                yield t.column("node").to_pylist(), first_reached(len(s), lambda i, left: (s[left] == s[i]).sum(1) >= T)  # noqa: B023

    def run(batches):
        yield from links_of(groups(batches))

    dealt = in_blocks(rows, F.col("df") / LIST_BLOCK, ["token"])
    return dealt.select("token", "i", "j", "node", "short").mapInArrow(run, "a binary, b binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, group): for each node of links (a, b) the least node it is connected with."""
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("group")))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "group"), "b").groupBy(F.col("a").alias("node")).agg(F.min("group").alias("least"))
        lower = labels.join(around, "node").select("node", F.col("group").alias("was"), F.least("group", "least").alias("group"))
        jump = labels.select(F.col("node").alias("group"), F.col("group").alias("further"))
        moved = cut(lower.join(jump, "group", "left").select("node", "was", F.least("group", F.coalesce("further", "group")).alias("group")))
        labels = moved.select("node", "group")
        if moved.filter("was <> group").isEmpty():
            return labels


def confirmed(docs: DataFrame, nodes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside groups (node, group) that hold on full sets, from each node to the first of its component."""
    members = cut(groups.join(nodes.select("node", "first_id", "n_shingles"), "node"))
    # texts of the members: most others stay where they are, by a bitmap of the members' ids, and those that it
    # lets through by chance go at the join; an id may repeat, so the node is looked up again. Texts without an id are taken all
    pair = docs.select("doc_id", "text")
    ids = members.select(F.col("first_id").alias("id")).filter("id IS NOT NULL")
    held = sifted(pair, "doc_id", bitmap(ids))[0].unionByName(pair.filter("doc_id IS NULL"))

    def hashes(batches):
        words = WordHashes()
        for b in batches:
            every = [s for s in (shingles(t, words) for t in b.column(1).to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in every], pa.binary()), pa.array([s.tobytes() for s in every], pa.binary())], names=["node", "hashes"])

    full = held.mapInArrow(hashes, "node binary, hashes binary")
    full = full.groupBy("node").agg(F.first("hashes").alias("hashes"))
    shares = members.groupBy("group").agg((F.sum("n_shingles") / GROUP_BLOCK).alias("share"))
    rows = members.join(shares, "group").join(full, "node").select("group", "node", "share", "hashes")

    def searched(batches):
        for _, t in sorted_groups(batches, 3):
            names, at = np.unique(np.array(t.column("node").to_pylist(), "S16"), return_index=True)
            if len(at) < 2:
                continue
            every = [np.frombuffer(t.column("hashes")[int(k)].as_py(), np.uint64) for k in at]
            sizes = np.array([len(s) for s in every])
            _, flat = np.unique(np.concatenate(every), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            mark = np.zeros(int(flat.max()) + 1, bool)
            live = {"of": np.arange(len(at)), "flat": flat, "starts": starts[:-1]}

            def near(i, left):
                mark[:] = False
                mark[flat[starts[i] : starts[i + 1]]] = True
                if 2 * len(left) < len(live["of"]):
                    keep = [flat[starts[k] : starts[k + 1]] for k in left]
                    live.update(of=left, flat=np.concatenate(keep), starts=np.concatenate([[0], np.cumsum(sizes[left])])[:-1])
                common = np.add.reduceat(mark[live["flat"]].astype(np.int64), live["starts"])[np.searchsorted(live["of"], left)]
                return 100 * common >= percent * (sizes[i] + sizes[left] - common)

            yield [t.column("node")[int(k)].as_py() for k in at], first_reached(len(at), near)

    def run(batches):
        yield from links_of(searched(batches))

    dealt = in_blocks(rows, F.col("share"), ["group"])
    return dealt.select("group", "i", "j", "node", "hashes").mapInArrow(run, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked at a Jaccard similarity of percent / 100 or more."""
    every = cut(sets(docs))
    nodes = cut(every.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens")))
    groups = components(collisions(nodes))
    linked = components(confirmed(docs, nodes, groups, percent))
    least = linked.join(nodes.select("node", "first_id"), "node").groupBy("group").agg(F.min("first_id").alias("component_id"))
    named = linked.join(least, "group").select("node", "component_id")
    # a node of one row that is linked with nothing is its own component, and its row needs no join
    of_node = nodes.join(named, "node", "left").filter("n > 1 OR component_id IS NOT NULL").select("node", "n", F.struct(F.coalesce("component_id", "first_id").alias("id")).alias("named"))
    met = looked_up(every.select("doc_id", "n_shingles", "node"), of_node, "node", "n", every.count())
    found = met.select("doc_id", "n_shingles", F.when(F.col("named").isNull(), F.col("doc_id")).otherwise(F.col("named.id")).alias("component_id"))
    return found.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs of which each component keeps one, the smallest doc_id.

    Rows that repeat that id stay together; a row without an id can't be named by a component and stays.
    """
    # of the rows only those whose id may be a dropped one are shuffled
    out = cut(near_duplicates(docs, percent).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept").select("doc_id"))
    maybe, clear = sifted(docs, "doc_id", bitmap(out))
    name = fresh("dropped_id", docs)
    return clear.unionByName(maybe.join(out.withColumnRenamed("doc_id", name), F.col("doc_id") == F.col(name), "left_anti"))
