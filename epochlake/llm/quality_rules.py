"""Quality rules: base counts, and divergence of a document's histograms from its language's.

The method compares two histograms of each document with those of all documents
of its language that pass the base rules: character classes, and common words
(function words of the language, and one bin for all other words). The distance
is Jensen-Shannon's, the square root of the divergence in bits. References are
made twice: of all documents, then of those that the first ones don't reject. A document too
short for a histogram to say anything is not judged by it. Everything is
DataFrame functions; what crosses the shuffle is a few numbers for each document.

Nulls and edge cases: a null text counts as empty (no words: the base rules
reject it); a null language is a language of its own; a language without common
words listed here has the words of all listed languages; a language none of
whose documents pass the base rules is compared with nothing. Rows that repeat
are judged one by one; very long texts are counted whole, in one task each; documents
of equal counts have equal verdicts; an empty table gives an empty table; other columns pass
through `filter_documents` and are ignored by `judge`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded, cut, stored

# Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to a in for is it that with was on by as this".split(),
    "fr": "de la le et les des en un du que une est pour qui dans par".split(),
    "de": "der die und in den von das zu sich mit des auf für nicht ist ein".split(),
    "es": "de la que el en y los se las del con un por no su una".split(),
}
#: Characters of each class; what no class holds is the last bin.
CLASSES = [r"\p{Lu}", r"[\p{L}&&[^\p{Lu}]]", r"[\x20\x09-\x0D]", r"[.,;:?'\"()-]", r"[#*$%&|<>]"]
#: Digits are in no class and in no bin: numbers and codes say little about prose.
DIGITS = r"\p{Nd}"
WINDOW = 5


def let(value, body):
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words):
    """Number of words inside windows of WINDOW words that the text has twice or more."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(at):
        # at: sorted starts; each covers up to the next one
        nxt = lambda k: F.coalesce(F.get(at, k + 1), F.get(at, k) + WINDOW)
        widths = F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda k: F.least(F.lit(WINDOW), nxt(k) - F.get(at, k)))
        return F.aggregate(widths, F.lit(0), lambda a, w: a + w)

    def starts(pairs):
        same = lambda k, j: F.coalesce(F.get(pairs, k)["h"] == F.get(pairs, j)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        return F.sort_array(F.transform(twice, lambda k: F.get(pairs, k)["i"]))

    def count(hs):
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(let(pairs, starts), covered))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """docs with a struct column `q` of its counts and histograms."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    in_class = [(F.length(text) - left(f"({c})+")).cast("long") for c in CLASSES]
    every_word = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    known = F.coalesce(F.col("lang"), F.lit("")).isin(list(COMMON_WORDS))
    by_lang = lambda of: F.element_at(F.create_map(*[x for k, ws in [*COMMON_WORDS.items(), ("", every_word)] for x in (F.lit(k), of(ws))]), F.when(known, F.col("lang")).otherwise(F.lit("")))
    common = by_lang(lambda ws: F.array(*map(F.lit, ws)))
    # a common word stands after white space or at the start, and before white space, punctuation or the end
    pattern = by_lang(lambda ws: F.lit(rf"(?:^|[\x20\x09-\x0D])({'|'.join(ws)})(?=[\x20\x09-\x0D.,;:!?]|$)"))
    hits = F.regexp_extract_all(F.lower(text), pattern, F.lit(1))

    def histogram(found, listed, n):
        return F.concat(F.transform(listed, lambda c: (F.size(found) - F.size(F.array_remove(found, c))).cast("long")), F.array((n - F.size(found)).cast("long")))

    def counts(words):
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
            let(common, lambda listed: let(hits, lambda found: histogram(found, listed, F.size(words)))).alias("words"),
        )

    by_word = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), counts)
    q = F.struct(
        by_word.alias("w"),
        in_class[-1].alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.concat(F.array(*in_class), F.array(left(f"({DIGITS})+").cast("long") - sum(in_class))).alias("chars"),
    )
    return docs.withColumn("q", q)


def base_failed(q, min_words: int = 10, max_repeat_percent: int = 20):
    n = q["w"]["n_words"]
    return (n < min_words) | (100 * q["w"]["n_repeat_words"] > max_repeat_percent * n)


def histograms(stats: DataFrame) -> DataFrame:
    """(r_lang, r_chars, r_words): the sums of the histograms of each language."""
    widest = len({w for ws in COMMON_WORDS.values() for w in ws}) + 1
    sums = lambda h, n, name: [F.sum(F.coalesce(F.get(h, F.lit(i)), F.lit(0))).alias(f"{name}{i}") for i in range(n)]
    chars, words = sums(F.col("q.chars"), len(CLASSES) + 1, "c"), sums(F.col("q.w.words"), widest, "w")
    found = stats.groupBy(F.col("lang").alias("r_lang")).agg(*chars, *words)
    return found.select("r_lang", F.array(*[f"c{i}" for i in range(len(chars))]).alias("r_chars"), F.array(*[f"w{i}" for i in range(len(words))]).alias("r_words"))


def references(stats: DataFrame, **limits) -> DataFrame:
    """As histograms(), of the documents that pass the base rules and don't diverge from all those of their language."""
    passed = stats.filter(~base_failed(F.col("q")))
    first = with_references(passed, cut(histograms(passed)))
    return histograms(first.filter(~diverges(F.col("q"), F.col("r_chars"), F.col("r_words"), **limits)))


def with_references(stats: DataFrame, refs: DataFrame) -> DataFrame:
    return stats.join(bounded(refs), F.col("lang").eqNullSafe(F.col("r_lang")), "left")


def js_distance(a, b):
    """Jensen-Shannon distance, in bits, of two histograms; b may be padded with empty bins."""
    total = lambda h: F.aggregate(h, F.lit(0).cast("long"), lambda s, x: s + x).cast("double")
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def each(x, y, n, m):
        p, q = F.coalesce(x, F.lit(0)) / n, F.coalesce(y, F.lit(0)) / m
        mid = (p + q) / 2
        return (term(p, mid) + term(q, mid)) / 2

    def divergence(n, m):
        return F.aggregate(F.zip_with(a, b, lambda x, y: each(x, y, n, m)), F.lit(0.0), lambda s, x: s + x)

    return F.sqrt(F.greatest(F.lit(0.0), let(total(a), lambda n: let(total(b), lambda m: divergence(n, m)))))


def diverges(q, r_chars, r_words, max_chars: float = 0.16, max_words: float = 0.3, min_chars: int = 200, min_words: int = 100):
    """True where a histogram with enough in it is too far from its reference."""
    enough_chars = F.aggregate(q["chars"], F.lit(0).cast("long"), lambda s, x: s + x) >= min_chars
    known = F.coalesce(F.aggregate(r_chars, F.lit(0).cast("long"), lambda s, x: s + x) > 0, F.lit(False))
    far_chars = known & enough_chars & (js_distance(q["chars"], r_chars) > max_chars)
    far_words = known & (q["w"]["n_words"] >= min_words) & (js_distance(q["w"]["words"], r_words) > max_words)
    return far_chars | far_words


def judge(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept); `distances` has the distances."""
    stats = cut(statistics(docs.select("doc_id", "lang", "text")).select("doc_id", "lang", "q"))
    q = F.col("q")
    found = with_references(stats, cut(references(stats, **limits)))
    bad = base_failed(q)
    verdict = ~diverges(q, F.col("r_chars"), F.col("r_words"), **limits)
    return found.select(
        "doc_id", q["w"]["n_words"].alias("n_words"), q["w"]["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"),
        q["n_dup_lines"].alias("n_dup_lines"), q["w"]["n_repeat_words"].alias("n_repeat_words"), bad.alias("base_failed"),
        (~bad & verdict).alias("kept"),
    )


def distances(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, base_failed, chars_distance, words_distance), to choose limits by."""
    stats = cut(statistics(docs.select("doc_id", "lang", "text")).select("doc_id", "lang", "q"))
    q = F.col("q")
    found = with_references(stats, cut(references(stats, **limits)))
    return found.select("doc_id", base_failed(q).alias("base_failed"), q["w"]["n_words"].alias("n_words"), js_distance(q["chars"], F.col("r_chars")).alias("chars_distance"), js_distance(q["w"]["words"], F.col("r_words")).alias("words_distance"))


def filter_documents(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Rows that pass the base rules are written once beside
    their statistics, which cost far more than that; the references of the languages come back to them."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "lang", "text")
    q = F.col("q")
    stats = stored(statistics(held).select("row", "lang", "q").filter(~base_failed(q)))
    found = with_references(stats, cut(references(stats.select("lang", "q"), **limits)))
    return found.filter(~diverges(q, F.col("r_chars"), F.col("r_words"), **limits)).select("row.*")
