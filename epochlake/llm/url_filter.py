"""URL filters: rules on host and path, and a classifier for what no rule fits.

The host stands after the first `://`, up to `/`, `?`, `#` or the end, with A-Z
lower-cased; the path follows up to `?`, `#` or the end. A rule (action, host,
path) fits its host and all subdomains where the path starts with the rule's; the
longest rule that fits wins. For other URLs the verdict is that of a logistic
regression on hashed character n-grams of host and path, fitted by gradient descent on a small labelled table. Its
threshold is measured on words left out of the fit: at most 2 % of allowed URLs are blocked there.

A null url, or one without `://`, has empty host and path and is
allowed. URLs of any length are taken whole; rules that fit alike are ordered by host and path, and a score at the
threshold blocks. Repeated rows have equal verdicts; an empty table gives an empty
table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rules of the registered query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# Words of the labelled table; labelled_urls() makes its rows from them.
BLOCKED_HOSTS = """casino poker bets betting slots lottery jackpot gamble roulette blackjack bingo baccarat sportsbook wager stake bookie odds
porn porno xxx adult escort nude naked webcam camgirls hookup hotgirls sexchat hentai milf fetish onlyfans striptease erotic swingers playmates
warez torrent crack keygen pirate piratebay nulled fmovies putlocker freestream serialz modapk leaked
pills viagra cialis meds xanax tramadol steroid slimming painkiller weedshop
spam clickbait replica counterfeit payday quickloan malware phish ransom freegift winprize getrich doubler hackz fakeid botnet""".split()
BLOCKED_PATHS = "jackpot bonus free-spins sex-videos hot-girls download-crack serial-key buy-pills fake-watches win-prize bet-now live-cams instant-loan cialis cheap-meds full-movie-free hd-xxx torrent-download".split()
ALLOWED_HOSTS = """news library school museum research docs wiki garden travel weather recipes music history science city health books forum blog shop
bakery theatre football chess cooking railway harbour archive journal university college academy kinder church parish council court police
fire hospital clinic dental nurse pharmacyboard bank insurance post energy water farm forest ocean mountain valley river lake island
bridge station airport bus bike car motor garage hotel hostel camping tennis rowing sailing ski swim marathon yoga
dance opera piano guitar choir film photo gallery design print paper pen toys kids family wedding law tax jobs data code maps""".split()
ALLOWED_PATHS = "article about contact guide chapter lesson timetable exhibition recipe interview review calendar map team history download register opening-hours".split()
#: Paths that stand under hosts of both kinds and say nothing.
NEUTRAL_PATHS = ["index", "page", "home", "en", "fr", "es", "de", "2021", "item", "a", "view"]


def labelled_urls(hosts: dict[int, list[str]] | None = None) -> list[tuple[str, int]]:
    """(url, 1 to block) for the words of hosts by label: each word in eight hosts, alone and beside others of its kind, with numbers and additions, under
    several top domains; every other path says nothing, and numbers end all paths."""
    out = []
    hosts = hosts or {1: BLOCKED_HOSTS, 0: ALLOWED_HOSTS}
    for label, words, own in ((1, hosts[1], BLOCKED_PATHS), (0, hosts[0], ALLOWED_PATHS)):
        for k, w in enumerate(words):
            for j in range(8):
                mate = words[(7 * k + 5 * j + 1) % len(words)]
                name = (w, f"{w}{mate}", f"{w}-{mate}", f"{mate}-{w}", f"{w}{10 * j + k}", f"the{w}", f"my-{w}s", f"{w}online")[j]
                front = ("www.", "", "m.", "", "blog.", "www.", "", "")[(k + j) % 8]
                top = ("com", "net", "org", "info", "co.uk", "example.com", "de")[(k + 2 * j) % 7]
                path = NEUTRAL_PATHS[(3 * k + j) % len(NEUTRAL_PATHS)] if j % 2 else own[(k + 3 * j) % len(own)]
                out.append((f"https://{front}{name}.{top}/{path}/{(37 * k + 11 * j) % 997}", label))
    return out


def grams(host: str, path: str, bits: int) -> list[int]:
    """Hashed character 3-, 4- and 5-grams of ^host$ and ^path$, of each its own."""
    out = set()
    for tag, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in (3, 4, 5):
            out.update(zlib.crc32(f"{tag}{s[i : i + n]}".encode("utf-8", "replace")) & (2**bits - 1) for i in range(len(s) - n + 1))
    return sorted(out)


def parts(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def fit(labelled: list[tuple[str, int]], bits: int = 14, epochs: int = 600, rate: float = 2.0, l2: float = 1e-3) -> np.ndarray:
    """Weights, the bias last; the table is small and given by the caller."""
    w, b = np.zeros(2**bits), 0.0
    rows = [(np.array(grams(*parts(u), bits), int), y) for u, y in labelled]
    flat = np.concatenate([r for r, _ in rows]) if rows else np.zeros(0, int)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r, _ in rows]) if rows else np.zeros(0, int)
    x = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(rows))))
    y = np.array([y for _, y in rows], float)
    for _ in range(epochs if rows else 0):
        p = 1 / (1 + np.exp(-(np.bincount(owner, w[flat], len(rows)) * x + b)))
        g = (p - y) / len(rows)
        w -= rate * (np.bincount(flat, (g * x)[owner], len(w)) * 10 + l2 * w)
        b -= rate * g.sum()
    return np.append(w, b)


def scored(weights: np.ndarray, host: str, path: str, bits: int) -> float:
    """The log-odds of a URL to be blocked; without any n-gram there is nothing to block for."""
    at = grams(host, path, bits)
    return float(weights[-1] + weights[at].sum() / np.sqrt(len(at))) if at else -np.inf


@functools.cache
def held_out(parts_: int = 5, bits: int = 14) -> tuple[tuple[float, int], ...]:
    """(probability, label) of URLs whose words the model hasn't seen: words are dealt to parts, each scored by a fit of the other parts' words."""
    out = []
    for k in range(parts_):
        deal = lambda words, own: [w for i, w in enumerate(words) if (i % parts_ == k) == own]  # noqa: E731, B023
        w = fit(labelled_urls({1: deal(BLOCKED_HOSTS, False), 0: deal(ALLOWED_HOSTS, False)}), bits)
        for url, y in labelled_urls({1: deal(BLOCKED_HOSTS, True), 0: deal(ALLOWED_HOSTS, True)}):
            out.append((1 / (1 + np.exp(-scored(w, *parts(url), bits))), y))
    return tuple(out)


def chosen_threshold(most_wrong: float = 0.02) -> float:
    """The lowest probability from which at most that share of held_out()'s allowed URLs is blocked."""
    allowed = sorted((p for p, y in held_out() if not y), reverse=True)
    return float(np.nextafter(allowed[int(most_wrong * len(allowed))], 1.0))


def split_url(url):
    """(host, path) columns of a url column."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: list[tuple[str, int]] | None = None, threshold: float | None = None, bits: int = 14) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score); rules: (allow or block, host, path).

    Without a threshold the one that chosen_threshold() measures on words that weren't in the fit.
    """
    threshold = chosen_threshold() if threshold is None else threshold
    weights = fit(labelled_urls() if labelled is None else labelled, bits)
    host, path = split_url(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = verdict = None
    # of rules that fit one page none of equal length differ: the first in this order is the longest
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(action)) if verdict is None else verdict.when(fits, F.lit(action))
    none = F.lit(None).cast("string")
    ruled = cut.select("*", (none if rule is None else rule).alias("rule"), (none if verdict is None else verdict).alias("verdict"))
    names = ["page_id", "host", "path", "rule", "verdict", "block_score"]

    def run(batches):
        for b in batches:
            scores = [scored(weights, h, p, bits) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            scores = 1 / (1 + np.exp(-np.array(scores)))
            verdicts = [v or ("block" if s >= threshold else "allow") for v, s in zip(b.column(4).to_pylist(), scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], names=names)

    return ruled.mapInArrow(run, ruled.select("*", F.lit(0.0).alias("block_score")).schema)
