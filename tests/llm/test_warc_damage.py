"""Damaged archives: every record that can be read is, and the others are rows with an error."""

import io
import os

import pytest

from epochlake.llm import warc


def archive(n=6, size=3000):
    return [warc.member(warc.record(i, f"http://x/{i}", os.urandom(size + i), None)) for i in range(n)]


@pytest.mark.parametrize("size", [777, 10**6])
def test_a_record_that_is_cut_off_is_a_row(size):
    members = archive()
    blob = b"".join(members)[:-30]
    got = [warc.parse(x) for s in range(0, len(blob), size) for x in warc.records_in(io.BytesIO(blob), s, s + size)]
    assert [r[0] for r in got] == list(range(6))
    assert all(r[7] is None for r in got[:5]) and "cut off" in got[5][7] and got[5][4:7] == (None, None, None)


def test_damage_inside_a_record_leaves_the_others():
    members = [bytearray(m) for m in archive()]
    members[2][len(members[2]) // 2 : len(members[2]) // 2 + 40] = bytes(40)
    blob = b"".join(members)
    got = [r for x in warc.records_in(io.BytesIO(blob), 0, len(blob)) if (r := warc.parse(x))]
    assert [r[0] for r in got] == list(range(6))
    assert [r[0] for r in got if r[7]] == [2]


def test_another_digest_is_a_row_and_no_failure():
    raw = warc.record(7, "u", b"payload", None).replace(b"payload", b"PAYLOAD")
    row = warc.parse(raw)
    assert row[0] == 7 and "digest" in row[7]


def test_reader_gives_errors_as_rows(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(archive(4))[:-50])
    rows = warc.read(spark, f"file://{tmp_path}", 1000).collect()
    assert sorted(r["page_id"] for r in rows) == [0, 1, 2, 3]
    assert [r["page_id"] for r in rows if r["error"]] == [3]
