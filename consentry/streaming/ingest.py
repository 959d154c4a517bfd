"""Event-driven ingest: the batch operators applied to each micro-batch.

A batch is read once: the rows of all its logs are written by one job and committed together, so a
batch that is run again after a failure replaces its own rows and the drained stream equals the
batch job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from consentry.operators import audit, quality, standardise, state
from consentry.sources import manifest, store
from consentry.sources.files import CORRUPT, PAYLOAD, numbered, read_log
from consentry.spec import DEFAULT_SPEC, EVENT_COLUMNS, KEY, REGISTRY_COLUMNS, RegistrySpec

CORRUPT_REASON = "payload is not a JSON object"

QUARANTINE_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("raw_payload", T.StringType()),
        T.StructField("failure_reasons", T.StringType()),
    ]
)
AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("operator", T.StringType()),
        T.StructField("action_type", T.StringType()),
        T.StructField("target_beneficiary_id", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("is_anomaly", T.IntegerType()),
    ]
)


def route_events(events: DataFrame, spec: RegistrySpec = DEFAULT_SPEC) -> DataFrame:
    """Raw events ``(event_seq, arrived_at, <event columns>[, _corrupt_record, payload])``
    standardised, gated and routed. ``raw`` keeps the payload as it came; of events that came as
    columns it is these as JSON."""
    raw = (
        F.col(PAYLOAD) if PAYLOAD in events.columns
        else F.to_json(F.struct(*EVENT_COLUMNS), {"ignoreNullFields": "false"})
    )
    keep = ("event_seq", "arrived_at", "raw", *[c for c in (CORRUPT,) if c in events.columns])
    routed = quality.route_ingest(
        standardise.standardise_events(events.withColumn("raw", raw), spec, keep), spec
    )
    if CORRUPT not in events.columns:
        return routed
    broken = F.col(CORRUPT).isNotNull()
    return routed.withColumns(
        {
            "ingest_status": F.when(broken, quality.QUARANTINED).otherwise(F.col("ingest_status")),
            "failure_reasons": F.when(broken, CORRUPT_REASON).otherwise(F.col("failure_reasons")),
        }
    )


def quarantine(routed: DataFrame) -> DataFrame:
    return audit.quarantine_rows(routed, "event_seq", F.col("arrived_at"))


def timed(events: DataFrame) -> DataFrame:
    """A stream of events with ``arrived_at``: the time of the micro-batch, which Spark keeps with
    the batch's offsets, so that a batch that runs again has the same one."""
    if "arrived_at" in events.columns:
        return events
    return events.withColumn("arrived_at", F.localtimestamp())


def store_batch(
    events: DataFrame, batch_id: int, root: str, arrived_at: Column | None = None
) -> None:
    """Route one batch into the write, quarantine and audit logs of a stored registry.

    ``arrived_at`` is the time of events that have none.
    """
    spark = events.sparkSession
    routed = route_events(numbered(events, arrived_at))
    folder = manifest.write(outcomes(routed, batch_id, manifest.read(spark, root).buckets), root)
    manifest.put(spark, root, [folder], [(log, batch_id) for log in LOGS])


LOGS = ("writes", "quarantine", "audit")


def outcomes(routed: DataFrame, batch_id: int, buckets: int = manifest.BUCKETS) -> DataFrame:
    """The rows of all three logs, a column for each of theirs, from one reading of ``routed``.

    An accepted event is a write and an audit row, any other one a quarantine row.
    """
    accepted = F.col("ingest_status") == quality.SUCCESS
    at, seq = F.col("arrived_at"), F.col("event_seq")
    rows = {
        "writes": (accepted, state.ingest_columns(seq)),
        "quarantine": (~accepted, audit.quarantine_columns("event_seq", at)),
        "audit": (accepted, audit.ingest_columns("event_seq", at)),
    }
    fields = {f.name: f.dataType for s in (store.WRITES_SCHEMA, QUARANTINE_SCHEMA, AUDIT_SCHEMA) for f in s}

    def one(log: str) -> Column:
        when, columns = rows[log]
        month = F.trunc(columns.get("timestamp", F.lit(None)).cast("date"), "month")
        bucket = manifest.bucket_of(KEY, buckets) if log == "writes" else F.lit(None).cast("int")
        return F.when(when, F.struct(
            F.lit(log).alias("log"), F.lit(batch_id).cast("bigint").alias("batch_id"),
            month.alias("dt"), bucket.alias("bucket"),
            *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in fields.items()]))

    each = F.array_compact(F.array(*[one(log) for log in LOGS]))
    return routed.select(F.inline(each))


def start_ingest(events: DataFrame, root: str) -> StreamingQuery:
    """Drain what the source holds now, then stop; progress is kept in ``<root>/checkpoint``."""
    return (
        timed(events).writeStream
        .foreachBatch(lambda df, batch_id: store_batch(df, batch_id, root))
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def accepted(spark: SparkSession, root: str) -> DataFrame:
    log = store.read_writes(spark, root).filter(F.col("op") == state.INGEST)
    return log.select("batch_id", F.col("seq.seq").alias("event_seq"), *REGISTRY_COLUMNS)


def quarantined(spark: SparkSession, root: str) -> DataFrame:
    return read_log(spark, f"{root}/quarantine", QUARANTINE_SCHEMA)


def audited(
    spark: SparkSession, root: str, since: str | None = None, until: str | None = None
) -> DataFrame:
    """The audit log from ``since`` to before ``until``; only months between are read."""
    return read_log(spark, f"{root}/audit", AUDIT_SCHEMA, since=since, until=until)


def registry(spark: SparkSession, root: str) -> DataFrame:
    """The stored registry, with the number of the event that wrote each record last."""
    return store.current(spark, root).withColumn("row_order", F.col("row_order.seq"))
