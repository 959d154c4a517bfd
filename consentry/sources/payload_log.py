"""Folders of payload lines as a stream whose offsets are (file, byte).

Each file of the folder holds one payload per line and may grow. An offset says for every file how
many of its bytes have been read, always up to the end of a line, so a restarted stream goes on at
the next line and a line that is still being written waits for its end. Lines are numbered by where
they stand: files in order of their names, in each file by byte. The number is that of the line's
first byte among all bytes of the micro-batch, so it needs no counting, and it is the same however
the batch is split.

``spark.readStream.format("payload_log").load(path)`` after ``register(spark)``. Rows have ``file``
(its name in the folder), ``position`` (of the line's first byte in the file), ``event_seq`` (its
place in the batch) and ``value`` (without the line's end). The same source reads a batch.

Options: ``path``; ``splitBytes``, what one task reads at most.

Folders are read by Arrow's file systems (local, ``file:``, ``hdfs:``, ``s3:``, ``gs:``). Names that
begin with ``.`` or ``_`` are skipped. An offset holds an entry per file, so files are to be removed
once they have been read and kept elsewhere: a file that is gone also leaves the offsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, InputPartition,
)

SCHEMA = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("position", T.LongType()),
    T.StructField("event_seq", T.LongType()), T.StructField("value", T.StringType())])
SPLIT_BYTES = 64 << 20
#: Bytes read at a time.
CHUNK = 4 << 20


@dataclass
class Part(InputPartition):
    """The lines of ``file`` that begin from ``start`` on and before ``end``, none of which reaches
    beyond ``last``; ``base`` is the number of byte 0."""

    file: str
    start: int
    end: int
    last: int
    base: int
    begins: bool  # a line begins at ``start``; else the first one begins after a line's end


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1)
                                        if path.startswith("file:/") and "//" not in path else path)
    return pafs.LocalFileSystem(), path


def _sizes(path: str) -> dict[str, int]:
    fs, at = _folder(path)
    found = fs.get_file_info(pafs.FileSelector(at, recursive=False))
    return {
        f.base_name: f.size for f in found
        if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))}


def _last_line_end(path: str, name: str, done: int, size: int) -> int:
    """The byte after the last line end between ``done`` and ``size``; ``done`` if there is none."""
    fs, at = _folder(path)
    with fs.open_input_file(f"{at}/{name}") as f:
        end = size
        while end > done:
            start = max(done, end - CHUNK)
            found = f.read_at(end - start, start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return done


def complete(path: str, done: dict[str, int], closed: bool = False) -> dict[str, int]:
    """How far each file's whole lines reach. In ``closed`` folders the last line needs no end."""
    return {
        name: size if closed or size <= done.get(name, 0)
        else _last_line_end(path, name, done.get(name, 0), size)
        for name, size in sorted(_sizes(path).items())}


def parts(start: dict[str, int], end: dict[str, int], split: int) -> list[Part]:
    """What is new between two offsets, in pieces of at most ``split`` bytes."""
    out, base = [], 0
    for name in sorted(end):
        a, b = start.get(name, 0), end[name]
        for at in range(a, b, split):
            out.append(Part(name, at, min(b, at + split), b, base - a, at == a))
        base += max(0, b - a)
    return out


def read_lines(path: str, part: Part) -> Iterator[pa.RecordBatch]:
    """The lines of a part. A line belongs to the part that its first byte is in."""
    fs, at = _folder(path)
    positions, values, size = [], [], 0
    with fs.open_input_file(f"{at}/{part.file}") as f:
        at_line = part.start  # where the line that is read begins
        if not part.begins:
            at_line = _after_line_end(f, part.start - 1, part.last)
        held, at_held = b"", at_line
        while at_line < part.end:
            cut = held.find(b"\n", at_line - at_held)
            if cut < 0:
                more = f.read_at(min(CHUNK, part.last - at_held - len(held)), at_held + len(held))
                if more:
                    held, at_held = held[at_line - at_held:] + more, at_line
                    continue
                cut = len(held)  # the last line of a closed file
            line = held[at_line - at_held:cut]
            positions.append(at_line)
            values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
            size += len(line)
            at_line = at_held + cut + 1
            if size >= CHUNK:
                yield _batch(part, positions, values)
                positions, values, size = [], [], 0
    if positions:
        yield _batch(part, positions, values)


def _after_line_end(f: pa.NativeFile, at: int, last: int) -> int:
    """The byte after the first line end from ``at`` on."""
    while at < last:
        chunk = f.read_at(min(CHUNK, last - at), at)
        found = chunk.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(chunk)
    return last


def _batch(part: Part, positions: list[int], values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "file": pa.array([part.file] * len(values)), "position": pa.array(positions, pa.int64()),
        "event_seq": pa.array([part.base + p for p in positions], pa.int64()),
        "value": pa.array(values, pa.string())})


class _Options:
    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("path"):
            raise ValueError("payload_log needs a path")
        self.path = options["path"].rstrip("/")
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))


class PayloadStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.seen = _Options(options), {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.seen = complete(self.options.path, self.seen)
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return parts(start, end, self.options.split)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return read_lines(self.options.path, partition)

    def commit(self, end: dict) -> None:
        self.seen = {**end, **self.seen}


class PayloadBatch(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = _Options(options)

    def partitions(self) -> list[Part]:
        return parts({}, complete(self.options.path, {}, closed=True), self.options.split) or [
            Part("", 0, 0, 0, 0, True)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return read_lines(self.options.path, partition) if partition.file else iter(())


class PayloadLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "payload_log"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PayloadBatch(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return PayloadStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PayloadLog)


def read_payload_log(
    spark: SparkSession, path: str, streaming: bool = False, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """The lines of a folder with their places. As a batch, a last line without an end counts."""
    register(spark)
    reader = spark.readStream if streaming else spark.read
    return reader.format("payload_log").option("splitBytes", str(split_bytes)).load(path)
