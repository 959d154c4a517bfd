"""Registry storage as plain Parquet: a log of writes and versioned snapshots of their fold.

Both are laid out by buckets of the key. Readers take the newest snapshot and fold the writes after
it on top, bucket by bucket where there are any; compaction does the same and writes those buckets
alone. What counts is in one manifest (``sources.manifest``), which is replaced as a whole, so nothing
is ever overwritten under a reader and no call leaves half of its work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consentry.operators import report, state
from consentry.sources import manifest
from consentry.sources.files import append_batches, logged, read_log
from consentry.sources.manifest import Manifest, Snapshot
from consentry.spec import FLAGS, KEY, REGISTRY_COLUMNS

_FIELDS = [
    T.StructField(
        c,
        T.IntegerType() if c in FLAGS
        else T.TimestampNTZType() if c == "consent_date" else T.StringType(),
    )
    for c in REGISTRY_COLUMNS
]
#: Where a write stands in the log: its batch, and its number within the batch.
PLACE = T.StructType(
    [T.StructField("batch_id", T.LongType()), T.StructField("seq", T.LongType())])
REGISTRY_SCHEMA = T.StructType([*_FIELDS, T.StructField("row_order", PLACE)])
CELLS_SCHEMA = T.StructType([
    T.StructField("pillar", T.StringType()), T.StructField("region", T.StringType()),
    *[T.StructField(c, T.LongType()) for c in report.COUNTS]])
WRITES_SCHEMA = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()),
     T.StructField("operator", T.StringType()), *_FIELDS]
)


def versions(spark: SparkSession, root: str) -> list[int]:
    return [s.version for s in manifest.read(spark, root).snapshots]


def _bucket(m: Manifest) -> Column:
    return manifest.bucket_of(KEY, m.buckets)


def append_writes(
    writes: DataFrame, root: str, batch_id: int, audit: DataFrame | None = None
) -> None:
    """Log a batch of writes, and what the audit log is to say about them, together."""
    m = manifest.read(writes.sparkSession, root)
    logs = {"writes": (writes.select(*state.WRITE_COLUMNS), _bucket(m))}
    if audit is not None:
        logs["audit"] = (audit, None)
    append_batches(logs, root, batch_id)


def place(batch_id: Column | int, seq: Column) -> Column:
    batch = F.lit(batch_id) if isinstance(batch_id, int) else batch_id
    return F.struct(batch.cast("bigint").alias("batch_id"), seq.cast("bigint").alias("seq"))


def read_writes(
    spark: SparkSession, root: str, paths: list[str] | None = None
) -> DataFrame:
    """The log with ``seq`` as the ``place`` of each write."""
    log = read_log(spark, f"{root}/writes", WRITES_SCHEMA, paths)
    return log.withColumn("seq", place(F.col("batch_id"), F.col("seq")))


def _read_buckets(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    return spark.read.schema(REGISTRY_SCHEMA).parquet(*[f"{root}/{p}" for p in paths])


def snapshot(spark: SparkSession, root: str, buckets: set[int] | None = None) -> DataFrame:
    """The newest snapshot, or some of its buckets; empty before the first."""
    held = _newest(manifest.read(spark, root))
    return _read_buckets(
        spark, root, [p for b, p in sorted(held.items()) if buckets is None or b in buckets])


def _newest(m: Manifest) -> dict[int, str]:
    return m.snapshots[-1].buckets if m.snapshots else {}


def _write_snapshot(registry: DataFrame, root: str, m: Manifest) -> Snapshot:
    """Write records as the next snapshot, not committed yet.

    Each bucket is sorted by region and pillar, so a directory filter skips most row groups.
    """
    spark = registry.sparkSession
    version = m.snapshots[-1].version + 1 if m.snapshots else 0
    order = (*manifest.PARTITIONS, "region", "pillar", KEY)
    laid_out = logged(
        registry.select(*REGISTRY_SCHEMA.names), "registry", version, bucket=_bucket(m)
    ).repartitionByRange("bucket", "region", "pillar", KEY).sortWithinPartitions(*order)
    buckets = _leaves(spark, root, manifest.write(laid_out, root, dealt=True))
    # The counts of each bucket, from the files just written: reports add them up.
    written = _read_buckets(spark, root, list(buckets.values()))
    cells = report.report_cells(written.withColumn("bucket", _bucket(m)), "bucket")
    counted = logged(cells, "cells", version, bucket=F.col("bucket"))
    return Snapshot(version, buckets, _leaves(spark, root, manifest.write(counted, root)))


def _leaves(spark: SparkSession, root: str, folder: str) -> dict[int, str]:
    """The folder of each bucket that a written folder, of one batch of a log, has rows of."""
    return {
        b: f"{path}/dt=__HIVE_DEFAULT_PARTITION__/bucket={b}"
        for path, held in manifest.found(spark, root, folder).values() for b in held}


def replace_registry(registry: DataFrame, root: str) -> int:
    """Make ``registry`` the newest snapshot and return its version; the log stays."""
    spark = registry.sparkSession
    new = _write_snapshot(registry, root, manifest.read(spark, root))

    def change(m: Manifest) -> None:
        m.snapshots.append(new)

    manifest.commit(spark, root, change)
    return new.version


def load_registry(registry: DataFrame, root: str) -> int:
    """Make ``registry`` the whole content: a new snapshot, without the log and the older ones."""
    spark = registry.sparkSession
    before = manifest.read(spark, root)
    new = _write_snapshot(registry, root, before)

    def change(m: Manifest) -> None:
        _forget(m, before)
        m.snapshots = [new]

    manifest.commit(spark, root, change)
    manifest.clean(spark, root, before)
    return new.version


def _forget(m: Manifest, folded: Manifest) -> None:
    """Remove the batches that were folded; those that came or were replaced meanwhile stay."""
    log = m.logs.setdefault("writes", {})
    for batch, entry in folded.batches("writes").items():
        if batch in log and log[batch][0] == entry[0]:
            del log[batch]


def _folded(spark: SparkSession, root: str, m: Manifest, sticky_erasure: bool) -> DataFrame:
    """The records of the buckets that the log has writes of, as of now."""
    log = m.batches("writes")
    changed = {b for _, buckets in log.values() for b in buckets}
    old = _read_buckets(spark, root, [p for b, p in sorted(_newest(m).items()) if b in changed])
    return state.apply_changes(
        state.snapshot_writes(old), read_writes(spark, root, [p for p, _ in log.values()]),
        sticky_erasure=sticky_erasure)


def current(spark: SparkSession, root: str, sticky_erasure: bool = True) -> DataFrame:
    """The registry as of now: the log is folded into the buckets that it has writes of."""
    m = manifest.read(spark, root)
    changed = {b for _, buckets in m.batches("writes").values() for b in buckets}
    kept = _read_buckets(
        spark, root, [p for b, p in sorted(_newest(m).items()) if b not in changed])
    if not changed:
        return kept
    folded = _folded(spark, root, m, sticky_erasure)
    return folded if len(changed) == m.buckets else kept.unionByName(
        folded.select(*REGISTRY_SCHEMA.names))


def report_all(spark: SparkSession, root: str, sticky_erasure: bool = True) -> DataFrame:
    """All reports as of now. Of buckets without writes since the snapshot only the counts are read,
    a row per (pillar, region); the others are folded."""
    m = manifest.read(spark, root)
    changed = {b for _, buckets in m.batches("writes").values() for b in buckets}
    held = m.snapshots[-1].cells if m.snapshots else {}
    paths = [f"{root}/{p}" for b, p in sorted(held.items()) if b not in changed]
    cells = (
        spark.read.schema(CELLS_SCHEMA).parquet(*paths) if paths
        else spark.createDataFrame([], CELLS_SCHEMA))
    if changed:
        cells = cells.unionByName(
            report.report_cells(_folded(spark, root, m, sticky_erasure)).select(*CELLS_SCHEMA.names))
    return report.roll_up(cells)


def compact(
    spark: SparkSession, root: str, sticky_erasure: bool = True, retain: int = 0,
    hours: float = 24,
) -> int:
    """Fold the log into a new snapshot, then delete the folded batches and older snapshots.

    Only buckets that the log has writes of are read and written; the new snapshot shares the others
    with the one before. What an erasure replaced is gone from storage afterwards, unless ``retain``
    asks to keep that many older snapshots for readers that still hold them; the compaction after
    those drops them. Batches that arrive meanwhile stay in the log. A call that ends in between
    leaves the old content or the new one, and what it wrote in vain goes after ``hours``.
    """
    before = manifest.read(spark, root)
    log = before.batches("writes")
    if log or not before.snapshots:
        changed = {b for _, buckets in log.values() for b in buckets}
        new = _write_snapshot(_folded(spark, root, before, sticky_erasure), root, before)
        if before.snapshots:
            old = before.snapshots[-1]
            for mine, theirs in ((new.buckets, old.buckets), (new.cells, old.cells)):
                mine.update({b: p for b, p in theirs.items() if b not in changed})
    else:
        new = None

    def change(m: Manifest) -> None:
        if [s.version for s in m.snapshots] != [s.version for s in before.snapshots]:
            raise RuntimeError("the registry was compacted or replaced meanwhile")
        _forget(m, before)
        if new:
            m.snapshots.append(new)
        m.snapshots = m.snapshots[-1 - retain:]

    done = manifest.commit(spark, root, change)
    manifest.clean(spark, root, before, hours)
    return done.snapshots[-1].version


_PAYLOAD_KEY = rf'"{KEY}"\s*:\s*"((?:[^"\\]|\\.)*)"'


def purge_quarantine(spark: SparkSession, root: str, schema: T.StructType) -> None:
    """Blank the payloads of erased people in the quarantine log.

    Batches that hold one are written again, all of them by one job, and replaced by one commit.
    """
    before = manifest.read(spark, root)
    erased = state.erased_keys(snapshot(spark, root))

    def keyed(paths: list[str] | None = None) -> DataFrame:
        return read_log(spark, f"{root}/quarantine", schema, paths).withColumn(
            KEY, F.trim(F.regexp_extract("raw_payload", _PAYLOAD_KEY, 1)))

    held = keyed().filter("raw_payload IS NOT NULL").join(erased, KEY, "left_semi")
    batches = [r.batch_id for r in held.select("batch_id").distinct().collect()]
    if not batches:
        return
    rows = keyed([before.batches("quarantine")[b][0] for b in batches])
    clean = state.purge_erased(rows, erased, ("raw_payload",)).select(*schema.names, "batch_id")
    folder = manifest.write(
        logged(clean, "quarantine", F.col("batch_id"), F.col("timestamp")), root)
    entries = manifest.found(spark, root, folder)

    def change(m: Manifest) -> None:
        log = m.logs.setdefault("quarantine", {})
        for b in batches:
            if b not in log or log[b][0] != before.batches("quarantine")[b][0]:
                raise RuntimeError(f"batch {b} of the quarantine was replaced meanwhile")
            log[b] = entries["quarantine", b]

    manifest.commit(spark, root, change)
    manifest.clean(spark, root, before)
