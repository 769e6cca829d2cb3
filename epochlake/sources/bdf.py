"""24-bit BDF recordings by ranges of data records: `spark.read.format("bdf")`, a data source whose partitions seek.

A partition is a range of records of one file, and of each record only the bytes of the wanted channels are read. Options:
`channels` (comma-separated, without case; needed), `records` (data records a partition, 64), and the path of a file or folder (taken
with its subfolders), which pyarrow must be able to open. A row is a segment (path, channel, fs, start, x, error): samples in physical units
from position `start` of the recording on. A file that can't be read, lacks a channel, or has the wanted channels at several
rates is one row with its error. What planning reads is each file's header.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SEGMENT_ROWS = "path string, channel string, fs double, start bigint, x array<double>, error string"


class Header:
    """What the header of a BDF file says; `size` is the file's length. `records` are the whole data records that are there."""

    def __init__(self, content: bytes, size: int):
        if content[:1] != b"\xff" or content[1:8] != b"BIOSEMI":
            raise ValueError("not a BDF file")
        text = lambda a, n: content[a : a + n].decode("ascii", "replace").strip()
        self.length, said, self.seconds, n = int(text(184, 8)), int(text(236, 8)), float(text(244, 8)), int(text(252, 4))
        if len(content) < 256 * (n + 1):
            raise ValueError("a header that is cut off")
        field = lambda offset, width: [text(256 + offset * n + width * i, width) for i in range(n)]
        self.labels = field(0, 16)
        self.low, self.high, self.dlow, self.dhigh = ([float(v) for v in field(o, 8)] for o in (104, 112, 120, 128))
        self.per_record = [int(v) for v in field(216, 8)]
        self.starts = np.cumsum([0, *self.per_record]).tolist()
        self.record_bytes = 3 * self.starts[-1]
        there = max(0, size - self.length) // self.record_bytes
        self.records = there if said < 0 else min(said, there)

    def places(self, wanted: list[str]) -> list[int]:
        """Numbers of the wanted signals; an error if one is missing or the rates differ."""
        by_label = {s.lower(): i for i, s in reversed(list(enumerate(self.labels)))}
        missing = [w for w in wanted if w.lower() not in by_label]
        if missing:
            raise ValueError(f"no channel {', '.join(missing)}")
        found = [by_label[w.lower()] for w in wanted]
        if len({self.per_record[i] for i in found}) > 1:
            raise ValueError("the wanted channels have several sampling rates")
        return found

    def physical(self, i: int, raw: np.ndarray) -> np.ndarray:
        """Samples of signal i from its bytes, three each."""
        b = raw.reshape(-1, 3).astype(np.int32)
        value = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        value = np.where(value >= 1 << 23, value - (1 << 24), value)
        gain = (self.high[i] - self.low[i]) / (self.dhigh[i] - self.dlow[i])
        return (value - self.dlow[i]) * gain + self.low[i]

    def decoded(self, body: bytes, wanted: list[str], records: int) -> list[tuple[str, float, np.ndarray]]:
        """(channel, fs, samples) of the wanted signals in `records` whole records."""
        raw = np.frombuffer(body, np.uint8, records * self.record_bytes).reshape(records, self.record_bytes)
        cut = lambda i: np.ascontiguousarray(raw[:, 3 * self.starts[i] : 3 * self.starts[i + 1]])
        return [(w, self.per_record[i] / self.seconds, self.physical(i, cut(i))) for w, i in zip(wanted, self.places(wanted), strict=True)]


def opened(path: str):
    """(file system, path on it) of a path with or without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Records(InputPartition):
    def __init__(self, path: str, first: int, count: int, error: str | None = None):
        self.path, self.first, self.count, self.error = path, first, count, error


class BdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.per_partition = options["path"], int(options.get("records", 64))
        self.wanted = [c.strip() for c in options.get("channels", "").split(",") if c.strip()]
        if not self.wanted:
            raise ValueError("name the channels to read in the option `channels`")

    def header(self, path: str) -> Header:
        system, at = opened(path)
        with system.open_input_file(at) as f:
            head = f.read_at(256, 0)
            n = head[252:256].decode("ascii", "replace").strip()
            return Header(head + (f.read_at(256 * int(n), 256) if n.isdigit() else b""), f.size())

    def files(self) -> list[str]:
        from pyarrow import fs

        system, at = opened(self.path)
        scheme = self.path[: self.path.index(at)] if at in self.path else ""
        if system.get_file_info(at).type == fs.FileType.Directory:
            return sorted(scheme + i.path for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File)
        return [self.path]

    def planned(self, path: str) -> list[Records]:
        try:
            header = self.header(path)
            header.places(self.wanted)
        except (ValueError, OSError, ZeroDivisionError) as e:
            return [Records(path, 0, 0, str(e) or type(e).__name__)]
        return [Records(path, k, min(self.per_partition, header.records - k)) for k in range(0, header.records, self.per_partition)]

    def partitions(self) -> list[Records]:
        with ThreadPoolExecutor(16) as pool:
            return [p for parts in pool.map(self.planned, self.files()) for p in parts] or [Records("", 0, 0)]

    def read(self, partition: Records):
        rows = []
        if partition.error:
            rows.append((partition.path, None, None, None, None, partition.error))
        elif partition.count:
            header, (system, at) = self.header(partition.path), opened(partition.path)
            with system.open_input_file(at) as f:
                for name, i in zip(self.wanted, header.places(self.wanted), strict=True):
                    size, offset = 3 * header.per_record[i], header.length + 3 * header.starts[i]
                    raw = b"".join([f.read_at(size, offset + r * header.record_bytes) for r in range(partition.first, partition.first + partition.count)])
                    x = header.physical(i, np.frombuffer(raw, np.uint8))
                    rows.append((partition.path, name, header.per_record[i] / header.seconds, partition.first * header.per_record[i], x, None))
        kinds = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.string()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "channel", "fs", "start", "x", "error"])


class BdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bdf"

    def schema(self) -> str:
        return SEGMENT_ROWS

    def reader(self, schema) -> BdfReader:
        return BdfReader(self.options)


def read_segments(spark: SparkSession, path: str, wanted: list[str], records: int = 64) -> DataFrame:
    """(path, channel, fs, start, x, error): the wanted channels of the BDF files at path, a row for each range of records and channel."""
    spark.dataSource.register(BdfSource)
    return spark.read.format("bdf").option("channels", ",".join(wanted)).option("records", records).load(path)
