"""BDF files by ranges of records: the rows of the whole-file decoder, fewer bytes, errors as rows; and on to epochs."""

import numpy as np
import pytest

from epochlake.operators import recordings
from epochlake.sources import bdf as source
from epochlake.sources.recordings import decode_bdf

from test_recordings import one_pass
from test_signal import bdf


def signals(seed, n, channels=3):
    r = np.random.default_rng(seed)
    return [r.integers(-(2**23), 2**23, n).tolist() for _ in range(channels)]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    labels = ("Fz", "Cz", "Status")
    files = {
        "whole.bdf": bdf(signals(1, 4 * 23), labels=labels),
        "deep/unknown.bdf": bdf(signals(2, 4 * 9), records=-1, labels=labels),
        "cut.bdf": bdf(signals(3, 4 * 11), records=30, tail=b"\x01\x02\x03\x04", labels=labels),
        "empty.bdf": bdf([[], [], []], labels=labels),
        "other.bdf": bdf(signals(4, 8, 2)),
        "no.bdf": b"x" * 600,
        "short.bdf": bdf(signals(1, 8), labels=labels)[:300],
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    return tmp_path, files


@pytest.mark.parametrize("records", [1, 4, 100])
def test_ranges_give_the_rows_of_the_whole_file(spark, folder, records):
    path, files = folder
    df = source.read_segments(spark, str(path), ["status", "FZ"], records)
    rows = df.collect()
    for name in ("whole.bdf", "deep/unknown.bdf", "cut.bdf"):
        mine = [r for r in rows if r["path"].endswith(name)]
        for channel, fs, x in decode_bdf(files[name], ["status", "FZ"]):
            own = sorted((r["start"], r["x"], r["fs"]) for r in mine if r["channel"] == channel)
            assert all(f == fs for *_, f in own) and len(own) == -(-len(x) // (4 * records))
            assert [s for s, *_ in own] == list(range(0, len(x), 4 * records))
            assert np.array_equal(np.concatenate([v for _, v, _ in own]), x)
    assert not [r for r in rows if r["path"].endswith("empty.bdf")]
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in rows if r["error"]}
    assert set(errors) == {"other.bdf", "no.bdf", "short.bdf"} and "status" in errors["other.bdf"] and "not a BDF" in errors["no.bdf"]
    if records == 4:
        assert df.rdd.getNumPartitions() == 6 + 3 + 3 + 3


def test_only_wanted_bytes_are_read(folder, monkeypatch):
    path, files = folder
    reader = source.BdfReader({"path": str(path / "whole.bdf"), "channels": "Cz", "records": "5"})
    taken = []
    system, at = source.opened(str(path / "whole.bdf"))

    class Counted:
        def open_input_file(self, name):
            file = system.open_input_file(name)

            class File:
                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    file.close()

                def size(self):
                    return file.size()

                def read_at(self, n, offset):
                    taken.append((offset, n))
                    return file.read_at(n, offset)

            return File()

    monkeypatch.setattr(source, "opened", lambda p: (Counted(), at))
    (batch,) = reader.read(source.Records("whole.bdf", 5, 5))
    assert batch.column("start").to_pylist() == [20] and len(batch.column("x")[0]) == 20
    body = [(o, n) for o, n in taken if o >= 256 * 4]
    assert body == [(256 * 4 + 36 * r + 12, 12) for r in range(5, 10)]


def test_channels_must_be_named(spark, folder):
    with pytest.raises(Exception, match="channels"):
        spark.dataSource.register(source.BdfSource)
        spark.read.format("bdf").load(str(folder[0])).collect()


def test_from_files_to_epochs(spark, tmp_path):
    values = [v[:] for v in signals(8, 128 * 40, 2)]
    content = bdf(values, per_record=128)
    (tmp_path / "a.bdf").write_bytes(content)
    parts = source.read_segments(spark, str(tmp_path), ["Cz"], 7).filter("error IS NULL")
    got = recordings.filtered_epochs(parts, ["path", "channel"], 128.0, 64.0, 2.0, chunk_seconds=10.0).orderBy("epoch").collect()
    want = one_pass(decode_bdf(content, ["Cz"])[0][2], 128.0, 64.0, 2.0)
    assert np.abs(np.array([r["x"] for r in got]) - want).max() < 1e-7
