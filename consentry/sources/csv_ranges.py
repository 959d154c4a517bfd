"""Large CSV files with line breaks inside quotes, read by many tasks.

A line break ends a record unless it stands inside quotes, and whether it does depends on everything
before it. Files are split into ranges as usual; between lines there are only two states, before a
record or inside quotes, so a line, and any run of lines, maps each of the two to one of the two.

1. Each range finds its map without knowing its first state, and counts its lines.
2. The driver combines the maps of a file's ranges from left to right, a row per range, which gives
   every range its first state and the number of its first line.
3. Each range cuts its lines into records from its first true record start. Only what a record has
   in other ranges than its first, and its beginning there, is shuffled, to be joined.

The tasks of step 3 get 26 bytes per range, that is per ``spark.sql.files.maxPartitionBytes`` of input.
Both passes must see the same ranges: their number is pinned in the session, and a range that the
first pass did not see is refused.

Which quotes open and close a value is what the one-task reader does: a quote opens one only at its
start, a doubled quote inside is a quote, and after the closing one everything up to the next
delimiter or line break belongs to the value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_VALUE = rf'(?:"{_QUOTED}"[^,]*+|[^",][^,]*+)?'
#: A line that begins a record ends inside quotes.
_OPENS = rf'^(?:{_VALUE},)*+"{_QUOTED}$'
#: A line that begins inside quotes ends inside quotes.
_STAYS = rf'^{_QUOTED}(?:$|"[^,]*+,(?:{_VALUE},)*+"{_QUOTED}$)'

NUMBER = "_line"

_RANGE = ("at bigint, file string, block bigint, end0 boolean, end1 boolean, last0 bigint, "
          "last1 bigint, n bigint, crlf boolean")


def _pin_ranges(spark: SparkSession) -> None:
    """Ranges otherwise depend on how many executors there are when a job starts."""
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set(
            "spark.sql.files.minPartitionNum", str(max(1, spark.sparkContext.defaultParallelism)))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in the order of their range, with the range they begin in and what they map to."""
    text = spark.read.schema("value string").option("lineSep", "\n").text(path)
    lines = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), "value")
    quoted = F.contains("value", F.lit('"'))
    return lines.select(
        F.xxhash64("file", "block").alias("at"), "file", "block", "value",
        (quoted & F.col("value").rlike(_OPENS)).alias("end0"),
        (~quoted | F.col("value").rlike(_STAYS)).alias("end1"),
        F.endswith("value", F.lit("\r")).alias("crlf"))


def states(end0: np.ndarray, end1: np.ndarray, first: bool) -> tuple[np.ndarray, bool]:
    """Whether each line begins inside quotes, if the first one does so or not; and the state at the
    end. A line that ends in one state whatever its first settles it; others keep or flip it."""
    n = len(end0)
    if not n:
        return np.zeros(0, bool), first
    settled = np.maximum.accumulate(np.where(end0 == end1, np.arange(n), -1))
    flips = np.cumsum(end0 & ~end1)
    since = flips - np.where(settled >= 0, flips[settled], 0)
    after = np.where(settled >= 0, end0[settled], first) ^ (since % 2 == 1)
    return np.append(first, after[:-1]), bool(after[-1])


def _runs(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cuts = np.flatnonzero(np.diff(at)) + 1
    bounds = [0, *cuts.tolist(), len(at)]
    return zip(bounds[:-1], bounds[1:])


def _flags(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(bool)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per range: where it leads from either state, its last record start from either, its
    number of lines, and whether its first line ends in a carriage return."""
    held: dict | None = None

    def row(r: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([r], schema=pa.schema([
            ("at", pa.int64()), ("file", pa.string()), ("block", pa.int64()), ("end0", pa.bool_()),
            ("end1", pa.bool_()), ("last0", pa.int64()), ("last1", pa.int64()), ("n", pa.int64()),
            ("crlf", pa.bool_())]))

    for batch in batches:
        if not batch.num_rows:
            continue
        at, ends = batch.column("at").to_numpy(), [_flags(batch, c) for c in ("end0", "end1")]
        for a, b in _runs(at):
            if held is None or held["at"] != at[a]:
                if held:
                    yield row(held)
                held = {"at": int(at[a]), "file": batch.column("file")[a].as_py(),
                        "block": batch.column("block")[a].as_py(), "end0": False, "end1": True,
                        "last0": -1, "last1": -1, "n": 0, "crlf": batch.column("crlf")[a].as_py()}
            for s in ("0", "1"):
                before, held[f"end{s}"] = states(ends[0][a:b], ends[1][a:b], held[f"end{s}"])
                starts = np.flatnonzero(~before)
                if len(starts):
                    held[f"last{s}"] = held["n"] + int(starts[-1])
            held["n"] += b - a
    if held:
        yield row(held)


@dataclass
class Ranges:
    """Per range, by its hash: its first line's number, the line at which the record that reaches
    into it began (-1: it begins with a record), and whether it is its file's first and has CRLF."""

    at: np.ndarray
    base: np.ndarray
    reaches: np.ndarray
    first: np.ndarray
    crlf: np.ndarray

    def find(self, at: int) -> int:
        k = int(np.searchsorted(self.at, at))
        if k == len(self.at) or self.at[k] != at:
            raise RuntimeError("the files, or the settings that split them, changed while reading")
        return k


def _combine(rows: list) -> Ranges:
    """First states and line numbers of all ranges, file by file from left to right."""
    out, base, file = [], 0, None
    for r in sorted(rows, key=lambda r: (r.file, r.block)):
        if r.file != file:
            file, inside, begun, crlf = r.file, False, -1, r.crlf
        out.append((r.at, base, begun if inside else -1, r.block == 0, crlf))
        last = r.last1 if inside else r.last0
        begun = base + last if last >= 0 else begun
        inside = r.end1 if inside else r.end0
        base += r.n
    out.sort()
    columns = list(zip(*out)) or [()] * 5
    types = (np.int64, np.int64, np.int64, bool, bool)
    return Ranges(*[np.array(c, t) for c, t in zip(columns, types)])


class _Cutter:
    """Records of one range, over its batches."""

    def __init__(self, ranges: Ranges, at: int) -> None:
        k = ranges.find(at)
        self.line, self.reaches = int(ranges.base[k]), int(ranges.reaches[k])
        self.crlf = bool(ranges.crlf[k])
        self.header = self.line if ranges.first[k] else -1
        self.inside = self.reaches >= 0
        # The record that is open: its first line's number, the lines of it here, the first of them.
        self.record, self.held, self.begun = self.reaches, [], self.line

    def add(self, lines: pa.Array, end0: np.ndarray, end1: np.ndarray, out: list[tuple]) -> None:
        before, inside = states(end0, end1, self.inside)
        for text, continues in zip(lines.to_pylist(), before.tolist()):
            if not continues:
                self._close(out, True)
                self.record = self.begun = self.line
            self.held.append(text)
            self.line += 1
        self.inside = inside

    def _close(self, out: list[tuple], ended: bool) -> None:
        if self.held:
            whole = ended and self.record == self.begun
            out.append((self.record, self.begun, "\n".join(self.held), whole,
                        self.record == self.header, self.crlf))
            self.held = []

    def finish(self, out: list[tuple]) -> None:
        self._close(out, not self.inside)


_PIECE = "record bigint, line bigint, text string, whole boolean, first boolean, crlf boolean"
_PIECE_SCHEMA = pa.schema([
    ("record", pa.int64()), ("line", pa.int64()), ("text", pa.string()), ("whole", pa.bool_()),
    ("first", pa.bool_()), ("crlf", pa.bool_())])


def _pieces(lines: DataFrame, ranges: Ranges) -> DataFrame:
    """Whole records, and the pieces of those that reach beyond their range."""
    shared = lines.sparkSession.sparkContext.broadcast(ranges)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _PIECE_SCHEMA)], schema=_PIECE_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, here = None, None
        for batch in batches:
            out: list[tuple] = []
            at, ends = batch.column("at").to_numpy(), [_flags(batch, c) for c in ("end0", "end1")]
            for a, b in _runs(at) if batch.num_rows else ():
                if cutter is None or here != at[a]:
                    if cutter:
                        cutter.finish(out)
                    here = int(at[a])
                    cutter = _Cutter(shared.value, here)
                cutter.add(batch.column("value")[a:b], ends[0][a:b], ends[1][a:b], out)
            if out:
                yield rows(out)
        out = []
        if cutter:
            cutter.finish(out)
        if out:
            yield rows(out)

    return lines.select("at", "value", "end0", "end1").mapInArrow(run, _PIECE)


def _records(pieces: DataFrame) -> DataFrame:
    """``pieces`` with those of one record joined."""
    parts = F.transform(
        F.array_sort(F.collect_list(F.struct("line", "text"))), lambda p: p["text"])
    joined = pieces.filter("NOT whole").groupBy("record").agg(
        F.array_join(parts, "\n").alias("text"), F.max("first").alias("first"),
        F.max("crlf").alias("crlf"))
    columns = ("record", "text", "first", "crlf")
    return pieces.filter("whole").select(*columns).unionByName(joined.select(*columns))


def _is_row(names: list[str], options: dict[str, str]) -> Column:
    """False for a file's header; an error if that names other columns."""
    ddl = ", ".join(f"c{k} string" for k in range(len(names)))
    bare = F.regexp_replace("text", "^\ufeff", "")
    found = F.array(*[F.from_csv(bare, ddl, options)[f"c{k}"] for k in range(len(names))])
    equal = F.transform(found, F.lower).eqNullSafe(F.array(*[F.lit(n.lower()) for n in names]))
    wrong = F.raise_error(F.concat(F.lit("CSV header does not name the columns: "), bare))
    return F.when(F.col("first"), F.when(equal, F.lit(False)).otherwise(wrong.cast("boolean"))).otherwise(
        F.lit(True))


def read_csv_ranges(
    spark: SparkSession, path: str, schema: T.StructType, options: dict[str, str],
    number: str | None = None,
) -> DataFrame:
    """Headered CSV files whose quoted values may hold line breaks, split between tasks.

    ``number`` adds a column of that name with the number of a record's first line: files in order
    of their paths, each from its first byte to its last. Line ends are LF, or CRLF in files whose
    first line ends so; blank lines are no records.
    """
    _pin_ranges(spark)
    lines = _lines(spark, path)
    found = lines.select("at", "file", "block", "end0", "end1", "crlf").mapInArrow(
        _summaries, _RANGE).collect()
    records = _records(_pieces(lines, _combine(found)))
    plain = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\r$", "")
    records = records.withColumn("text", F.when(F.col("crlf"), plain).otherwise(F.col("text")))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = records.filter(F.col("text") != "").filter(_is_row(schema.names, options)).select(
        F.col("record"), F.from_csv("text", ddl, options).alias("row"))
    extra = [F.col("record").alias(number)] if number else []
    return rows.select(*[F.col("row").getField(n).alias(n) for n in schema.names], *extra)
