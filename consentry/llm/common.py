"""What several operators share: session settings, table access, folds, and row-wise Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from consentry.session import tune

#: White space of the word rules: space and the ASCII controls 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

SETTINGS = {
    # Rows a Python worker holds at once; documents may be long.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    # Operators write what they read twice, so shuffle files are of no use after their query.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    tune(spark)
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fold(key: str, of: int) -> Column:
    """The fold a row belongs to: crc32 of its id as text, modulo ``of``; null ids are in fold 0."""
    at = F.crc32(F.col(key).cast("string").cast("binary")) % of
    return F.coalesce(at, F.lit(0)).cast("int")


def map_rows(
    df: DataFrame, fn: Callable[[pa.StructArray], dict[str, pa.Array]], added: str,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` as one column ``row`` beside the columns that ``fn`` makes of each batch of rows.

    Names of ``df`` cannot clash with the added ones, as they stay inside ``row``. ``added`` is the
    DDL of the new columns; ``keep`` names the columns that ``row`` holds, all by default.
    """
    names = list(keep or df.columns)
    packed = df.select(F.struct("*").alias("row"))
    kept = df.select(F.struct(*names).alias("row")).schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            row = pa.StructArray.from_arrays([rows.field(c) for c in names], names)
            yield pa.RecordBatch.from_pydict({"row": row, **fn(rows)})

    return packed.mapInArrow(run, f"row {kept}, {added}")


def utf8(rows: pa.StructArray, column: str) -> list[bytes | None]:
    """A text column of a batch as UTF-8 bytes; null stays null."""
    return rows.field(column).cast(pa.binary()).to_pylist()
