"""Spelled-out addresses without brackets are proposed and, where plain, found."""

import pytest

from epochlake.llm import pii


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("Please write to jane at mail dot com today", 0, "jane at mail dot com"),
    ("Contact jane.doe AT mail.com now", 0, "jane.doe AT mail.com"),
    ("email jane (at) mail dot com", 0, "jane (at) mail dot com"),
    ("host 192.168.1[.]1 is down", 1, "192.168.1[.]1"),
    ("server 10 dot 0 dot 0 dot 1.", 1, "10 dot 0 dot 0 dot 1"),
])
def test_spelled_out_is_found(text, kind, span):
    at = text.index(span)
    assert (kind, at, at + len(span)) in pii.candidates(text)
    assert (kind, at, at + len(span)) in pii.spans(text)


@pytest.mark.parametrize("text", ["They stared at the dot on the wall", "We met at noon. Then we left", "section 3[.]700.2.900", "version 2 dot 0 dot 1 dot 5", "arrive at one dot five"])
def test_prose_and_versions_are_left(text):
    assert pii.spans(text) == []
