"""Scoring of accesses as they happen, against the policy, the view counts and a fitted model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from consentry.models.forest import IsolationForest
from consentry.operators import access
from consentry.sources import store
from consentry.sources.files import append_batch, read_log
from consentry.sources.staging import discard, lookup, recorded
from consentry.spec import DEFAULT_SPEC, RegistrySpec
from consentry.streaming.ingest import AUDIT_SCHEMA

_SCHEMA = T.StructType([f for f in AUDIT_SCHEMA.fields if f.name != "ip_address"])


def score_batch(
    requests: DataFrame,
    policy: DataFrame,
    volumes: DataFrame,
    model: IsolationForest | None,
    spec: RegistrySpec = DEFAULT_SPEC,
) -> DataFrame:
    """Audit rows of one batch of requests. Without a model no access is an anomaly."""
    filtered = access.row_policy(access.policy_join(requests, policy, spec))
    features = access.access_features(access.with_volume(filtered, volumes), spec)
    flagged = model.flag_rows(features) if model else features.withColumn("is_anomaly", F.lit(0))
    return access.access_audit(access.mask_decision(flagged, spec))


def live_volumes(
    spark: SparkSession, root: str, sticky_erasure: bool = True, spec: RegistrySpec = DEFAULT_SPEC
) -> Callable[[], DataFrame]:
    """The rows per view of a stored registry as it is at each call: its newest snapshot with the
    log folded in."""
    return lambda: access.view_volumes(store.current(spark, root, sticky_erasure), spec)


def start_alerts(
    requests: DataFrame,
    policy: DataFrame,
    volumes: DataFrame | Callable[[], DataFrame],
    model: IsolationForest | Callable[[], IsolationForest | None],
    root: str,
) -> StreamingQuery:
    """Score a stream of requests into the audit log of ``root``.

    ``volumes`` and ``model`` may be calls (``live_volumes``, ``models.store.Newest``); then each
    micro-batch sees the registry, and the newest model, as they are when it starts. A batch that
    runs again sees them as they are then.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        staged: list[str] = []
        with recorded(staged):
            counts = lookup(volumes()) if callable(volumes) else volumes
            scorer = model if isinstance(model, IsolationForest) or model is None else model()
            append_batch(score_batch(df, policy, counts, scorer), f"{root}/audit", batch_id)
        discard(df.sparkSession, staged)

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def alerts(spark: SparkSession, root: str) -> DataFrame:
    return read_log(spark, f"{root}/audit", _SCHEMA)
