"""Personal data: candidate generators, boosted trees, calibrated thresholds.

Strict patterns give the base spans: e-mail addresses, IPv4 addresses, payment
card numbers that pass Luhn's check, phone numbers with a country code. Loose
generators propose further spans that may overlap: addresses with spelled-out
signs, numbers in national phone formats, numbers that a strict pattern loses as
other digits stand beside them, card numbers with other separators, IP addresses
with any mix of plain, bracketed and spelled-out dots. The at sign and the dots of an
address may be spelled out with or without brackets. Boosted trees score a candidate by its
format and by the words before it; a candidate whose score reaches its kind's
threshold is added, the best first, unless it overlaps what is there already. The
trees are fitted on examples made by a seeded generator, and each threshold is the lowest score that keeps a
precision of 0.98 on sentences of another generator, whose words, formats and clauses are others.

Of candidates with equal scores the one of the earlier kind, then the earlier one, is taken first. Patterns run over whole texts,
however long, numbers of any length in them included, and start only at a sign or digit, so that long
runs of other characters cost linear time. A null text is an empty one and has no
spans; repeated rows have the same spans; an empty table gives an empty table;
other columns are kept by `redact` and ignored by `find`. Positions count code
points and ends are exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import BoostedTrees

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no digit before: a match that starts inside a run of digits also starts at its first
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str):
    """What `[local]+@[domain]+(\\.[domain]+)+` matches, found from its at signs."""
    after = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            after = m.end()
        at = text.find("@", max(at + 1, after))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict patterns, in order of kind and start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


# Loose generators, one or more for each kind; all start at a character that is rare in prose.
LOOSE = [
    (0, re.compile(r"[\[({]\s?(?:at|@)\s?[\])}]", re.I)),
    (1, re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\.|\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?|\sdot\s)[0-9]{1,3}){3}(?!\w|\.[0-9])", re.I)),
    (2, re.compile(r"(?<![\w.,-])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![\w-]|[.,][0-9])")),
    (2, re.compile(r"(?<![\w.,+-])(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})(?![\w-]|[.,][0-9])")),
    (3, re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![\w-]|[.,][0-9])")),
    (3, re.compile(r"(?<![\w.,+/-])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![\w/-]|[.,][0-9])")),
]
AROUND_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?$")
AROUND_DOMAIN = re.compile(r"\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[({]\s?(?:dot|\.)\s?[\])}])\s?[A-Za-z0-9-]{1,63}){1,4}", re.I)
SPELLED_AT = [" at ", " AT ", " At "]
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\sdot\s)[A-Za-z0-9-]{1,63}){1,4}", re.I)
SPELLED_DOT = re.compile(r"\bdot\b", re.I)
ENDS = frozenset("com org net edu gov io info uk us de fr es it eu".split())
VERSION = re.compile(r"section|version|chapter|release|step", re.I)
HINTS = [
    re.compile(r"e-?mail|mailto|contact|write|reach", re.I),
    re.compile(r"\bip\b|host|server|addr|client", re.I),
    re.compile(r"card|visa|credit|debit|pay|account", re.I),
    re.compile(r"phone|tel\b|tel[.:]|call|fax|mobil|cell|sms|dial|\bring\b|whatsapp|hotline|switchboard|reach|voicemail|desk", re.I),
]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) that the loose generators propose; spans may overlap."""
    out = []
    if "(" in text or "[" in text or "{" in text:
        for m in LOOSE[0][1].finditer(text):
            left = AROUND_LOCAL.search(text[max(0, m.start() - 65) : m.start()])
            right = AROUND_DOMAIN.match(text, m.end())
            if left and right:
                out.append((0, m.start() - len(left[0]), right.end()))
                # without brackets the dots of the rest may be words
                if (more := SPELLED_DOMAIN.match(text, m.end() + (text[m.end() : m.end() + 1] == " "))) and more.end() > right.end():
                    out.append((0, m.start() - len(left[0]), more.end()))
            elif left and (right := SPELLED_DOMAIN.match(text, m.end() + (text[m.end() : m.end() + 1] == " "))):
                out.append((0, m.start() - len(left[0]), right.end()))
    for sign in SPELLED_AT:
        at = text.find(sign)
        while at >= 0:
            right = SPELLED_DOMAIN.match(text, at + len(sign))
            left = right and AROUND_LOCAL.search(text[max(0, at - 64) : at])
            if left:
                out.append((0, at - len(left[0]), right.end()))
            at = text.find(sign, at + len(sign) - 1)
    if DIGIT.search(text):
        for kind, pattern in LOOSE[1:]:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return out


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span, before = text[start:end], text[max(0, start - 40) : start]
    digits = re.sub(r"[^0-9]", "", span)
    groups = re.findall(r"[0-9]+", span)
    seps = [c for c in span if not c.isalnum()]
    tail = re.search(r"[A-Za-z]+$", span)
    sign = re.match(r"(\S+)\s(at)\s(\w+)", span, re.I) if kind == 0 else None
    return [
        kind, end - start, len(digits), len(groups), max(map(len, groups), default=0), len(seps), len(set(seps)),
        span.count("."), span.count("("), float(span[:2] == "00"), float(span[:1] == "("), float(span[:1] == "+"), float(luhn(digits) if digits else 0),
        max(map(int, (g[:9] for g in groups)), default=0) if kind == 1 else 0, len(tail[0]) if tail else 0,
        float(bool(HINTS[kind].search(before))), float(any(h.search(before) for k, h in enumerate(HINTS) if k != kind)),
        float(text[end : end + 1].isdigit()), float(before[-1:].isalnum()), float(bool(re.search(r"(?:19|20)[0-9]{2}", groups[0])) if groups else 0),
        float(bool(tail) and tail[0].lower() in ENDS), len(SPELLED_DOT.findall(span)), float(bool(sign)), float(bool(sign) and sign[2].isupper()),
        float(bool(sign) and (sign[3].lower() in ("the", "a", "an", "this", "that", "each", "every", "one"))), float(bool(sign) and any(c in "0123456789._+" for c in sign[1])),
        float(bool(VERSION.search(before))),
    ]


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of n made-up candidates in context, of all kinds, half of them private."""
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstuv"), rng.integers(3, 9)))
    pick = lambda *a: a[rng.integers(len(a))]

    def card(valid: bool, sep: str) -> str:
        while True:
            d = pick("4", "5", "3") + digits(15)
            if luhn(d) == valid:
                return sep.join(d[k : k + 4] for k in range(0, 16, 4))

    # signs and dots as they are spelled without brackets
    at, dot = lambda: pick(" at ", " at ", " AT "), lambda: pick(" dot ", " dot ", " DOT ")
    mixed = lambda ns: "".join([str(ns[0]), *[pick(".", "[.]", "(.)", "[dot]", " dot ", " (dot) ") + str(n) for n in ns[1:]]])
    said = lambda ns: " dot ".join(map(str, ns))
    top = lambda: pick("com", "org", "net", "de", "fr", "es", "co.uk", f"co{dot()}uk")
    octets = lambda: [int(v) for v in rng.integers(0, 256, 4)]
    numbers = lambda: [int(v) for v in rng.integers(0, 1000, 4)]

    private = [
        lambda: (pick("email", "contact", "write to", "reach me", "and", word()), pick(word(), f"{word()}.{word()}", f"{word()}{digits(2)}") + at() + word() + (dot() if rng.random() < 0.8 else ".") + top()) if rng.random() < 0.5 else (pick("email", "contact", "write to", "reach me", "and", word()), f"{word()}.{digits(2)}{pick(' (at) ', ' [at] ', '(at)', '[at]', '{at}')}{word()}{pick('.', ' [dot] ', ' (dot) ')}{pick('com', 'org', 'net', 'de', 'fr', 'es')}"),
        lambda: (pick("host", "ip", "server", word()), pick(mixed, said)(octets())) if rng.random() < 0.5 else (pick("host", "ip", "server", word()), pick("[.]", "(.)", "[dot]", " (dot) ").join(str(rng.integers(1, 256)) for _ in range(4))),
        lambda: (pick("card", "visa", "pay with", word()), card(True, pick(".", "_", "", "", "", " ", "-"))),
        lambda: (pick("phone", "call", "tel", "tel:", "mobile", "fax", "cell", f"dial {word()}", f"call {word()} on"), pick(f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0049 {digits(3)} {digits(4)}{digits(3)}", f"0{digits(3)} {digits(3)} {digits(4)}", f"0{digits(2)}/{digits(3)}{digits(4)}")) if rng.random() < 0.6 else (word(), f"+{rng.integers(1, 99)} {pick(f'({digits(3)})', digits(3))} {digits(3)}{pick('-', ' ', '.')}{digits(4)}"),
    ]
    public = [
        lambda: (pick(word(), "please", "they"), pick("look", "arrive", "stared", "meet", "was", word()) + at() + pick(f"the dot {pick('on', 'in', 'and', word())}", f"{pick('a', 'each', 'one')} dot {word()}", f"{word()} dot {word()}", f"{word()}.{pick('com', 'org', word(), word().capitalize())}")) if rng.random() < 0.5 else (word(), f"{word()} (at) {word()}. {word().capitalize()}"),
        lambda: ((pick("section", "version", "chapter", "release"), pick(mixed, said)([int(v) for v in rng.integers(0, 30, 4)])) if rng.random() < 0.5 else (pick("section", "version", word()), pick(mixed, said)(numbers()))) if rng.random() < 0.5 else (pick("section", "version", word()), pick("[.]", "(.)").join(str(rng.integers(0, 1000)) for _ in range(4))),
        lambda: (pick("part", "order", "number", word()), card(False, pick(".", "_", "", "", "", " ", "-"))),
        lambda: (pick("in", "from", "isbn", "order", "part", "between", "page", word()), pick(f"{rng.integers(1900, 2030)}-{rng.integers(1900, 2030)} {digits(3)}", f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(2)}/{digits(3)}{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}"[: int(rng.integers(9, 15))])),
    ]
    xs, ys = [], []
    while len(ys) < n:
        y = int(rng.integers(0, 2))
        kind = int(rng.integers(0, 4))
        hint, span = (private if y else public)[kind]()
        lead = f"{word()} {word()} {hint} "
        text = f"{lead}{span} {pick(word(), digits(int(rng.integers(2, 16))), '10.20.30.40')}."
        # an example is what the generators propose for it
        for k, s, e in candidates(text):
            if k == kind and s < len(lead) + len(span) and e > len(lead):
                xs.append(features(text, k, s, e))
                ys.append(y)
    return np.array(xs[:n], float), np.array(ys[:n], float)


# Names and places of the sentences that thresholds are set by; the training examples have none of them.
PEOPLE = "alice bruno carla dmitri elena farid greta hugo ingrid jonas".split()
FIRMS = "northwind bluebird stonegate riverbank oakfield sunline".split()


def sentences(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, private spans) of n sentences, written otherwise than the training examples are: other words, other formats, a whole clause around each."""
    rng = np.random.default_rng(seed)
    pick = lambda *a: a[rng.integers(len(a))]
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    low = lambda k: "".join(map(str, rng.integers(2, 10, 1))) + d(k - 1)
    byte = lambda: int(rng.integers(0, 256))

    def paid(valid: bool, sep: str) -> str:
        while True:
            c = pick("4", "51", "37") + d(14)
            c = (c + d(2))[:16]
            if luhn(c) == valid:
                return sep.join(c[k : k + 4] for k in range(0, 16, 4))

    who, firm, end = lambda: pick(*PEOPLE), lambda: pick(*FIRMS), lambda: pick("com", "org", "net", "de")
    private = [
        lambda: (pick("For questions, mail ", "Please contact ", "Send the form to ", "The editor is "), f"{who()}{pick('', f'.{who()}', f'_{who()}', d(2))}{pick(' at ', ' (at) ', '[at]', ' [at] ')}{firm()}{pick(' dot ', '.', '[dot]', ' (dot) ')}{end()}", pick(" before Friday.", ", who answers.", " (weekdays).")),
        lambda: (pick("The printer listens on ", "Add the server ", "Our gateway is ", "Requests came from client "), pick("[.]", " dot ", "(dot)", " [dot] ").join(str(byte()) for _ in range(4)), pick(" since May.", ", port 80.", " and stays there.")),
        lambda: (pick("She paid with card ", "The account was debited: ", "Charge visa ", "Use my credit card "), paid(True, pick(".", "_", " ", "-", "")), pick(" last week.", ", valid until June.", " again.")),
        lambda: (
            pick("You can reach us on ", "Dial ", "Her mobile is ", "Ring the hotline ", "The switchboard (", "Telephone: ", "Send an SMS to ", "Fax "),
            pick(f"({low(3)}) {low(3)}-{d(4)}", f"{low(3)}-{low(3)}-{d(4)}", f"0{low(3)} {low(3)} {d(4)}", f"0{low(2)}/{low(3)}{d(4)}", f"{low(3)}.{low(3)}.{d(4)}", f"0033 {low(3)} {d(4)}{d(3)}", f"({low(3)}) {low(3)} {d(4)}"),
            pick(" after nine.", ") is open.", ", ask for me.", " at any time."),
        ),
    ]
    public = [
        lambda: (pick("We looked at ", "He met her at ", "It starts at "), pick(f"{firm()}.{end()} yesterday", "the dot in the middle", "one dot per line", f"{firm()} dot matrix"), " and left."),
        lambda: (pick("Install release ", "See section ", "It needs version "), pick(".", "[.]", " dot ").join(str(int(rng.integers(0, 40))) for _ in range(4)), " first."),
        lambda: (pick("Your parcel ", "Order ", "The serial number is ", "Reference "), paid(False, pick("", " ", "-", ".")), pick(" has left.", ", he said.", " is wrong.")),
        lambda: (pick("The town has ", "In ", "It sold ", "ISBN ", "Add up ", "Between ", "See page "), pick(f"{low(3)} {d(3)} {d(3)} people", f"19{d(2)}-19{d(2)} {d(3)}", f"{low(3)}-{d(3)}-{d(4)} pieces", f"978-{d(1)}-{d(3)}-{d(5)}", f"{low(2)}/{d(3)}{d(4)}", f"{low(3)}.{d(3)}.{d(4)} units", f"({low(3)}) {d(3)}-{d(4)}"), pick(" so far.", " in all.", " of them.")),
    ]
    out = []
    for _ in range(n):
        y, kind = int(rng.integers(0, 2)), int(rng.integers(0, 4))
        lead, span, rest = (private if y else public)[kind]()
        lead = pick("", "As I said: ", "Note that the office moved. ") + lead
        out.append((lead + span + rest, [(kind, len(lead), len(lead) + len(span))] if y else []))
    return out


def measured(found: list[list[tuple[int, int, int]]], truth: list[list[tuple[int, int, int]]]) -> dict[str, tuple[float, float]]:
    """(precision, recall) of each kind: a found span is right if it overlaps one of its kind, and that one is then found."""
    out = {}
    for k, name in enumerate(KINDS):
        hits = misses = wrong = 0
        for mine, theirs in zip(found, truth, strict=True):
            a, b = [s for s in mine if s[0] == k], [s for s in theirs if s[0] == k]
            meet = lambda x, ys: any(x[1] < y[2] and y[1] < x[2] for y in ys)
            hits += sum(meet(t, a) for t in b)
            misses += sum(not meet(t, a) for t in b)
            wrong += sum(not meet(f, b) for f in a)
        out[name] = (hits / max(1, hits + wrong), hits / max(1, hits + misses))
    return out


@functools.cache
def model(n: int = 2500, seed: int = 0, precision: float = 0.98) -> tuple[BoostedTrees, tuple[float, ...]]:
    """The fitted trees and a threshold for each kind: fitted once, on the driver, from tables of a fixed size.

    A kind's threshold lies below the lowest score, and is a half at least, from which that share of the candidates in `sentences` is private.
    """
    trees = BoostedTrees().fit(*examples(n, seed))
    xs, ys = [], []
    for text, private in sentences(2 * n, seed + 1):
        base = base_spans(text)
        for c in dict.fromkeys(candidates(text)):
            if not any(s < c[2] and c[1] < e for _, s, e in base):
                xs.append(features(text, *c))
                ys.append(any(c[0] == k and s < c[2] and c[1] < e for k, s, e in private))
    x, y = np.array(xs, float), np.array(ys, float)
    p = trees.predict(x)
    thresholds = []
    for kind in range(len(KINDS)):
        ps, own = p[x[:, 0] == kind], y[x[:, 0] == kind]
        order = np.argsort(-ps, kind="stable")
        share = np.cumsum(own[order]) / np.arange(1, len(own) + 1)
        # a threshold takes all candidates of a score or none
        last = np.r_[np.diff(ps[order]) != 0, True][: len(own)]
        good = np.flatnonzero((share >= precision) & last)
        if not len(good):
            thresholds.append(1.1)
            continue
        # half way to the next score, which would be too many
        k = int(good[-1])
        thresholds.append(max(0.5, float(ps[order][k : k + 2].mean())))
    return trees, tuple(thresholds)


def spans(text: str, base: list[tuple[int, int, int]] | None = None, fitted: tuple | None = None) -> list[tuple[int, int, int]]:
    """Base spans and those that the model adds, in order of kind and start. fitted: what model() gives, as the driver sends it to tasks."""
    base = base_spans(text) if base is None else base
    proposed = [c for c in dict.fromkeys(candidates(text)) if not any(s < c[2] and c[1] < e for _, s, e in base)]
    if not proposed:
        return base
    trees, thresholds = fitted or model()
    scored = zip(trees.predict(np.array([features(text, *c) for c in proposed], float)), proposed, strict=True)
    taken = list(base)
    for _, (k, s, e) in sorted(((-p, c) for p, c in scored if p >= thresholds[c[0]])):
        if not any(a < e and s < b for _, a, b in taken[len(base) :]):
            taken.append((k, s, e))
    return sorted(taken)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in found)


def slices(batches, most: int = 256):
    """Batches in parts of a few documents: texts, results and what goes back are held for one part at a time."""
    for b in batches:
        for s in range(0, b.num_rows, most):
            yield b.slice(s, most)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base spans, all spans."""
    pair = docs.select("doc_id", "text")
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
    fitted = model()

    def run(batches):
        for b in slices(batches):
            base = [base_spans(t or "") for t in b.column(1).to_pylist()]
            every = [spans(t or "", f, fitted) for t, f in zip(b.column(1).to_pylist(), base, strict=True)]
            counts = [pa.array([sum(x[0] == k for x in f) for f in base], pa.int64()) for k in range(len(KINDS))]
            shas = [hashlib.sha256(written(f).encode()).hexdigest() for f in base]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(shas, pa.string()), pa.array([written(f) for f in every], pa.string())], names=names)

    columns = [F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS]
    return pair.mapInArrow(run, pair.select("doc_id", *columns, F.lit("").alias("base_sha256"), F.lit("").alias("spans")).schema)


def redacted(text: str, fitted: tuple | None = None) -> str:
    """The text with each span, or group of overlapping spans, replaced by the name of its first kind."""
    out, after = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans(text, None, fitted)):
        if s >= after:
            out += [text[after:s], f"[{KINDS[k].upper()}]"]
        after = max(after, e)
    return "".join([*out, text[after:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with redacted texts; n_chars, where there is one, counts the new text."""
    fitted = model()

    def run(batches):
        for b in slices(batches):
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array([t and redacted(t, fitted) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    done = docs.mapInArrow(run, docs.schema)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
