"""Alignment of two tokenizers: minimal groups of tokens with equal bytes, and counts of linked id pairs.

A is a byte-level BPE vocabulary, B a merge-type vocabulary of pieces; both encode a space and the text,
and each token covers a range of its bytes. A token of A and one of B are linked where their ranges
overlap. The tokens and links are a bipartite graph, and its connected components, found by union-find
over the links, are exactly the minimal groups: runs of A and B tokens that cover the same bytes.

1. Encoding and components. Neither vocabulary joins a character with a space after it, so texts are cut before
   each space that has a character other than white space before it. Such a chunk is encoded, united and expanded to links once, however often
   it comes, and kept in a book of bounded size; a text is a list of chunks. Texts that hold the space mark
   of B as a character, and those where a chunk's bytes differ, are taken whole, and every check_share-th text is encoded
   whole by both libraries and compared with what its chunks gave.
2. Pair counting. Of each text its distinct linked pairs with their occurrences are written to the
   shared folder beside its digest. How many texts hold a pair is summed by pair, in part before the shuffle.
3. Looking up. The most frequent pairs, at most HEAD of them by a limit on the count, are broadcast; texts'
   pairs that are rarer meet the rest of the table by a shuffle. So no key of the shuffle is
   hot, and the broadcast doesn't grow with the data.

Nulls and edge cases: a text that is null, empty, or whose A or B bytes differ from space and text (one with U+2581 for
B) has no tokens: zeros, and '' as its digest. Texts of any length are taken whole; repeated rows count as documents each,
also with the same id or none; ties between a token's best pairs all count; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored

MARK = "▁"
#: Where a text is cut: before a space after any other character than white space.
BORDER = re.compile(r"(?<=\S)(?= )")
#: Two kinds of white space side by side, where cutting at each space would cut too much.
DOUBLE = re.compile(r"\s ")
#: Chunks that a worker keeps, characters of the longest of them, and texts taken together.
BOOK, LONGEST, SLICE_ROWS = 300_000, 64, 250
#: Pairs in the broadcast part of the table of counts.
HEAD = 1_000_000
#: Places of B's id in the number of a pair.
SHIFT = 2**24
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each of n nodes' component under edges (a, b): union by the smaller root, paths halved."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        # of several edges that hook one root any may win; the others stay for the next round
        root[np.maximum(ra, rb)] = np.minimum(ra, rb)
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above
    return root


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of counts[0] numbers, then the next."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Aligner:
    """Two vocabularies and a book of the chunks that were seen."""

    def __init__(self, ranks: str, full: str, pattern: str, pieces: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.full = full
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        a_bytes, self.b_bytes = [b""] * (max(table.values()) + 1), [self.bytes_of(p) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        for piece, i in table.items():
            a_bytes[i] = piece
        self.a_bytes = a_bytes
        self.a_size, self.b_size = np.array([len(x) for x in a_bytes]), np.array([len(x) for x in self.b_bytes])
        self.mark = sp.piece_to_id(MARK)
        # no piece has a mark after another character, so chunks are encoded as they are in a text
        self.by_chunk = all(MARK not in p.lstrip(MARK) for p in names)
        # texts of ids with what stands before them: for A's, then B's, first and later ones of a group
        self.written = [f"{sign}{i}".encode() for sign, n in ((";", len(a_bytes)), (",", len(a_bytes)), ("|", len(names)), (",", len(names))) for i in range(n)]
        self.clear()

    @staticmethod
    def bytes_of(piece: str) -> bytes:
        return bytes([int(BYTE_PIECE.fullmatch(piece)[1], 16)])

    @functools.cached_property
    def patient(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.full)
        found.encode_special_tokens = True
        return found

    def clear(self) -> None:
        self.book: dict[str, int] = {}
        self.passing: list[str] = []
        #: Of each chunk its groups as text (None: its bytes differ), and a row of counts: ids of A, of B, groups, links.
        self.texts: list[bytes | None] = []
        #: Chunks whose bytes differ.
        self.bad: set[int] = set()
        self.counts, self.links = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)

    def a_ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except ValueError:
            # its pattern gives up on very long runs of spaces; the other library has the same vocabulary
            return np.array(self.patient.encode(text, add_special_tokens=False).ids, np.int64)

    def b_ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks that begin with a space, which stands for the mark that the library adds."""
        return [ids if len(c) > 1 else [self.mark] for c, ids in zip(chunks, self.library.encode([c[1:] for c in chunks], num_threads=1), strict=True)]

    def a_of(self, chunks: list[str], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, how many of each): chunks that end without white space have the same ids one after another, in one call."""
        own: list[np.ndarray | None] = [self.a_ids(c) if c[-1].isspace() else None for c in chunks]
        joined = [i for i, x in enumerate(own) if x is None]
        ids = self.a_ids("".join([chunks[i] for i in joined])) if joined else np.zeros(0, np.int64)
        ends, edges = np.cumsum(self.a_size[ids]), np.cumsum(length[joined])
        last = np.searchsorted(ends, edges)
        if len(joined) and last[-1] < len(ends) and (ends[last] == edges).all():
            n = np.diff(np.r_[-1, last])
            if len(joined) == len(chunks):
                return ids, n
            parts = np.split(ids, last[:-1] + 1)
        else:
            parts = [self.a_ids(chunks[i]) for i in joined]
        for i, x in zip(joined, parts, strict=True):
            own[i] = x
        return np.concatenate(own), np.array([len(x) for x in own])

    def add(self, chunks: list[str]) -> None:
        """Encodes, unites and expands new chunks, all at once."""
        raw = [c.encode() for c in chunks]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        fa, n_a = self.a_of(chunks, length)
        lists = self.b_ids(chunks)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        fb = np.fromiter(itertools.chain.from_iterable(lists), np.int64, n_b.sum())
        spelled = [b"".join(map(names.__getitem__, ids.tolist())) for names, ids in ((self.a_bytes, fa), (self.b_bytes, fb))]
        good = np.ones(len(chunks), bool)
        for size, ids, n, text in ((self.a_size, fa, n_a, spelled[0]), (self.b_size, fb, n_b, spelled[1])):
            total = np.r_[0, np.cumsum(size[ids])][np.r_[0, np.cumsum(n)]]
            if not (np.diff(total) == length).all() or text != b"".join(raw):
                good &= np.array([text[s:e] == r for s, e, r in zip(total, total[1:], raw, strict=False)], bool)
        if not good.all():
            fa, fb = fa[np.repeat(good, n_a)], fb[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        # ends of tokens in all chunks, one after another; good chunks have equal lengths in both
        end_a, end_b = np.cumsum(self.a_size[fa]), np.cumsum(self.b_size[fb])
        # a token of A overlaps those of B from the one that holds its first byte to the one that holds its last
        first = np.searchsorted(end_b, end_a - self.a_size[fa], "right")
        last = np.searchsorted(end_b, end_a, "left")
        at_a = np.repeat(np.arange(len(fa)), last - first + 1)
        at_b = ranges(first, last - first + 1)
        root = united(len(fa) + len(fb), at_a, at_b + len(fa))
        of_a, of_b = root[: len(fa)], root[len(fa) :]
        new_a, new_b = np.r_[True, of_a[1:] != of_a[:-1]][: len(fa)], np.r_[True, of_b[1:] != of_b[:-1]][: len(fb)]
        group_a, group_b = np.cumsum(new_a) - 1, np.cumsum(new_b) - 1
        # tokens in the order of the text of the groups: those of A before those of B
        before_b, before_a = np.searchsorted(group_b, group_a, "left"), np.searchsorted(group_a, group_b, "right")
        order = np.empty(len(fa) + len(fb), np.int64)
        order[np.arange(len(fa)) + before_b] = fa + np.where(new_a, 0, len(self.a_bytes))
        order[np.arange(len(fb)) + before_a] = fb + 2 * len(self.a_bytes) + np.where(new_b, 0, len(self.b_bytes))
        names = list(map(self.written.__getitem__, order.tolist()))
        edges = np.cumsum(np.r_[0, n_a + n_b]).tolist()
        self.bad.update((len(self.texts) + np.flatnonzero(~good)).tolist())
        self.texts += [b"".join(names[s:e]) if g else None for s, e, g in zip(edges, edges[1:], good.tolist(), strict=False)]
        chunk_of = np.repeat(np.arange(len(chunks)), n_a)
        counts = [n_a, n_b, np.bincount(chunk_of, new_a, len(chunks)).astype(np.int64), np.bincount(chunk_of[at_a], minlength=len(chunks))]
        self.counts = np.concatenate([self.counts, np.stack(counts, 1)])
        self.links = np.concatenate([self.links, fa[at_a] * SHIFT + fb[at_b]])

    def codes(self, texts: list[list[str]]) -> list[list[int]]:
        """Numbers of the chunks of texts."""
        book = self.book
        new = list(dict.fromkeys(c for chunks in texts for c in chunks if c not in book))
        if new:
            for k, c in enumerate(new, len(self.texts)):
                book[c] = k
            self.add(new)
            # long chunks are kept for these texts only
            self.passing += [c for c in new if len(c) > LONGEST]
        return [list(map(book.__getitem__, chunks)) for chunks in texts]

    def forget(self) -> None:
        """Lets long chunks go, and all where the book is full."""
        for c in self.passing:
            self.book.pop(c, None)
        self.passing = []
        if len(self.texts) > BOOK or len(self.links) > 8 * BOOK:
            self.clear()

    def chunks(self, text: str) -> list[str]:
        whole = " " + text
        if not self.by_chunk or MARK in text:
            return [whole]
        if DOUBLE.search(whole):
            return BORDER.split(whole)
        return [" " + c for c in text.split(" ")]

    def aligned(self, texts: list[str | None], share: int) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, digest, pairs, times) of each text; pairs are numbers in order."""
        codes = self.codes([self.chunks(t) if t else [] for t in texts])
        spoilt = [k for k, c in enumerate(codes) if self.bad and not self.bad.isdisjoint(c)]
        for k in spoilt:
            # once more as a whole: what chunk by chunk differs might not as a whole, and the reverse
            (codes[k],) = self.codes([[" " + texts[k]]])
            if not self.bad.isdisjoint(codes[k]):
                codes[k] = []
        # of all texts their distinct chunks, and of those the distinct links
        n_links = self.counts[:, 3]
        start = np.cumsum(n_links) - n_links
        flat, of = np.concatenate([np.array(c, np.int64) for c in codes]), np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        key, times = np.unique(of * len(n_links) + flat, return_counts=True)
        doc, chunk = key // max(1, len(n_links)), key % max(1, len(n_links))
        pair = self.links[ranges(start[chunk], n_links[chunk])]
        doc, times = np.repeat(doc, n_links[chunk]), np.repeat(times, n_links[chunk])
        order = np.lexsort((pair, doc))
        doc, pair, times = doc[order], pair[order], times[order]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])][: len(doc)])
        times = np.add.reduceat(times, new) if len(new) else times
        doc, pair = doc[new], pair[new]
        edges = np.searchsorted(doc, np.arange(len(codes) + 1))
        out = []
        for k, c in enumerate(codes):
            sums = self.counts[c].sum(0).tolist() if c else [0] * 4
            text = b"".join(map(self.texts.__getitem__, c))[1:]
            mine = slice(edges[k], edges[k + 1])
            out.append((*sums, hashlib.sha256(text).hexdigest() if c else "", pair[mine], times[mine]))
            if c and zlib.crc32(texts[k][:4096].encode()) % share == 0:
                self.check(texts[k], c, text)
        self.forget()
        return out

    def check(self, text: str, codes: list[int], groups: bytes) -> None:
        """Holds the chunks of a text against both libraries over the whole text."""
        ours = [[ids.split(b",") for ids in g.split(b"|")] for g in groups.split(b";")]
        a, b = ([int(i) for g in ours for i in g[side]] for side in (0, 1))
        if a != self.patient.encode(" " + text, add_special_tokens=False).ids or b != self.library.encode(text):
            raise ValueError(f"the libraries give other ids for a text of {len(text)} characters")
        end_a, end_b = ({*np.cumsum(size[ids]).tolist()} for size, ids in ((self.a_size, a), (self.b_size, b)))
        if len(ours) != len(end_a & end_b):
            raise ValueError(f"groups that aren't minimal in a text of {len(text)} characters")


@functools.cache
def aligner(*paths: str) -> Aligner:
    """One for each Python worker."""
    return Aligner(*paths)


def aligned(docs: DataFrame, ranks: str, full: str, pattern: str, pieces: str, check_share: int = 100) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each row of docs; pairs are A's id * 2**24 + B's."""

    def run(batches):
        both = aligner(ranks, full, pattern, pieces)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                found = both.aligned(b.column(1).to_pylist(), check_share)
                counts = [pa.array([f[k] for f in found], pa.int64()) for k in range(4)]
                lists = []
                for k, kind in ((5, pa.int64()), (6, pa.int32())):
                    edges = np.cumsum([0, *(len(f[k]) for f in found)])
                    lists.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate([f[k] for f in found]), kind)))
                yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([f[4] for f in found], pa.string()), *lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows of `texts` a pair is linked, and whether no pair of its A id is in more."""
    counts = texts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    # an A id has at most as many pairs as B has ids
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 24)))
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def looked_up(texts: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """(row, n_best, count_sum) over the linked pairs of rows of texts: sums by rows of (row, pairs, times)."""
    # the least count, as a power of two, from which at most `head` pairs are left; there are at most 64 powers
    powers = counts.groupBy((F.length(F.bin("n")) - 1).alias("power")).agg(F.count("*").alias("n")).orderBy(F.desc("power")).collect()
    left, least = head, 64
    for r in powers:
        left -= r["n"]
        if left < 0:
            break
        least = r["power"]
    held = F.col("n") >= F.lit(2.0) ** least if least < 64 else F.lit(False)
    frequent, rare = F.broadcast(counts.filter(held)), counts.filter(~held)
    every = texts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    met = every.join(frequent, "pair", "left")
    done = met.filter("n IS NOT NULL")
    if left < 0:
        done = done.unionByName(met.filter("n IS NULL").select("row", "pair", "times").join(rare, "pair"))
    return done.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))


def align(docs: DataFrame, ranks: str, full: str, pattern: str, pieces: str, head: int = HEAD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document."""
    # a number for each row, fixed once it is written: ids may repeat
    texts = stored(aligned(docs, ranks, full, pattern, pieces).withColumn("row", F.monotonically_increasing_id()))
    counts = cut(pair_counts(texts))
    sums = looked_up(texts.select("row", "pairs", "times"), counts, head)
    met = texts.drop("pairs", "times").join(sums, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return met.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
