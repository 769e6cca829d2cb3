"""Alignment against a plain version over whole texts by the two libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from epochlake.llm import alignment
from epochlake.llm.queries import tokenizer_model

PATHS = [public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, tokenizer_model()]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def to_bytes():
    """Bytes of the characters that byte-level vocabularies are written in."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain(rows):
    """{(position of the row): result}, by loops over bytes."""
    full = Tokenizer.from_file(PATHS[1])
    full.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[3])
    of = to_bytes()
    out, links, docs_of = [], [], Counter()
    for doc_id, text in rows:
        want = (" " + (text or "")).encode()
        a = full.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        a_bytes = [bytes(of[c] for c in full.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            out.append([doc_id, 0, 0, 0, 0, 0, 0, ""])
            links.append([])
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            at, mine = 0, []
            for p in parts:
                mine.append((at, at + len(p)))
                at += len(p)
            spans.append(mine)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, side) if low <= s and e <= cut) for ids, side in ((a, spans[0]), (b, spans[1]))))
            low = cut
        mine = [(i, j) for i, (s, e) in zip(a, spans[0]) for j, (t, f) in zip(b, spans[1]) if s < f and t < e]
        docs_of.update(set(mine))
        links.append(mine)
        out.append([doc_id, len(a), len(b), len(cuts), len(mine), 0, 0, hashlib.sha256(";".join(groups).encode()).hexdigest()])
    best = defaultdict(int)
    for (i, _), n in docs_of.items():
        best[i] = max(best[i], n)
    for row, mine in zip(out, links):
        row[5] = sum(docs_of[p] == best[p[0]] for p in mine)
        row[6] = sum(docs_of[p] for p in mine)
    return sorted(map(tuple, out), key=repr)


def odd_texts():
    words = "the amber cedar don't x9 naive caf\u00e9 \u4e2d\u6587 \U0001f600 fjord's 12345 re-do (well) \u00df\ufb01".split()
    r = np.random.default_rng(7)
    texts = [" ".join(r.choice(words, n)) for n in (1, 3, 40, 300)]
    texts += [None, "", " ", "  ", "\n", "a  b", "a \n b", " a", "a ", "a\u2581b c", "\u2581", "<|endoftext|> and <s> </s> <0x41>", "\x00\x01 \x1c \x85 x", "\u3000 \u00a0 y", "tab\tx  \t z", "   three", "z" * 3000, "ab" * 900 + " " * 70 + "q"]
    return texts


@pytest.fixture(scope="module")
def rows():
    texts = odd_texts()
    return [*enumerate(texts), (3, texts[3]), (None, texts[2]), (3, texts[1])]


@pytest.mark.parametrize("head", [1_000_000, 40, 0])
def test_against_a_plain_version(spark, rows, head):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({c: F.lit("x") for c in ("row", "pairs", "times", "n", "best", "n_a", "pair")})
    found = alignment.align(df, *PATHS, head=head)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows)


def test_whole_texts_agree_with_their_chunks(rows):
    both = alignment.Aligner(*PATHS)
    found = both.aligned([t for _, t in rows], 1)
    assert len(found) == len(rows)
    both.texts[both.book[" the"]] = b";1|2"
    with pytest.raises(ValueError):
        both.aligned(["the amber the"], 1)


def test_a_full_book_is_cleared(monkeypatch, rows):
    once = alignment.Aligner(*PATHS).aligned([t for _, t in rows], 10**12)
    monkeypatch.setattr(alignment, "BOOK", 3)
    both = alignment.Aligner(*PATHS)
    again = [both.aligned([t], 10**12)[0] for _, t in rows]
    assert [x[:5] for x in once] == [x[:5] for x in again]


def test_union_find_on_any_graph():
    r = np.random.default_rng(3)
    for n, m in ((1, 0), (50, 30), (200, 150), (300, 900)):
        a, b = r.integers(0, n, m), r.integers(0, n, m)
        near = defaultdict(set)
        for x, y in zip(a.tolist(), b.tolist()):
            near[x].add(y)
            near[y].add(x)
        want, seen = list(range(n)), set()
        for s in range(n):
            todo = [s] if s not in seen else []
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    want[x] = s
                    todo += near[x]
        assert alignment.united(n, a, b).tolist() == want


def test_an_empty_table(spark):
    found = alignment.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS)
    assert found.columns == COLUMNS and found.count() == 0
