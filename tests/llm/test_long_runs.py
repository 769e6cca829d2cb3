"""The check against the library holds long runs and survives a cleared cache."""

from array import array

import pytest

from epochlake.llm import pieces
from epochlake.llm.queries import tokenizer_model


@pytest.mark.parametrize(("run", "entries"), [("y" * 200, 500_000), ("word", 1)])
def test_a_wrong_merge_is_found_in_any_run(run, entries):
    coder = pieces.Pieces(tokenizer_model())
    coder.cache_entries = entries
    agenda = coder.agenda
    coder.agenda = lambda r: [*agenda(r), 5] if run in r else agenda(r)
    texts = [f"some {run} and others after it"]
    packed = [coder.encode(t) for t in texts]
    with pytest.raises(ValueError):
        coder.check(texts, packed, 10**12)


def test_right_long_runs_pass():
    coder = pieces.Pieces(tokenizer_model())
    texts = [f"a {'xyz0é中😀' * n} b  {'-' * n}\n{'the' * n}" for n in (1, 20, 300)] + ["z" * 5000, "", " ", "   q" * 40, "　" + "ß" * 90, "<s>" * 60, "\x00" * 80, "▁" * 100, " " * 100 + "x" * 100]
    coder.check(texts, [coder.encode(t) for t in texts], 1)
    assert array("I", coder.library.encode(texts[2], add_bos=True, add_eos=True)).tobytes() == coder.encode(texts[2])
