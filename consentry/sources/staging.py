"""Where intermediate tables live, and how a frame is written once to be read several times."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_STORED: dict[tuple[str, ...], tuple[str, object]] = {}
_LOCAL: dict[str, str] = {}
_RECORDS: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, the folder all executors share.

    Only a local session, which has one machine, may fall back to its temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="consentry-"))
    return f"{base.rstrip('/')}/consentry-{uuid.uuid4().hex}"


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Folders staged inside are added to ``paths``, for ``discard``."""
    _RECORDS.append(paths)
    try:
        yield
    finally:
        _RECORDS.remove(paths)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged folders; frames that read them end with that."""
    while paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and return the written table.

    Later readers start from files, so a lost executor costs a re-read and not the lineage.
    """
    spark = df.sparkSession
    if not path:
        path = shared_dir(spark)
        for paths in _RECORDS:
            paths.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(df: DataFrame) -> DataFrame:
    """An aggregated table to be joined by its key, staged.

    As a written table its size is known, so Spark broadcasts it if, and only if, it is below
    ``spark.sql.autoBroadcastJoinThreshold``. Above that both join sides are plain shuffles, which
    is what adaptive execution needs to split a hot key of the other side; an aggregation in the
    same stage as the join would prevent it.
    """
    return stage(df)


def stored(spark: SparkSession, key: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """A table written once per application under ``key`` and read by everyone who asks again."""
    at = (spark.sparkContext.applicationId, *key)
    if at not in _STORED or not exists(spark, f"{_STORED[at][0]}/_SUCCESS"):
        path = shared_dir(spark)
        df = stage(build(), path)
        _STORED[at] = (path, df.schema)
    path, schema = _STORED[at]
    return spark.read.schema(schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
