"""Audit and quarantine rows, derived from what the operators did.

``seq`` orders the rows of one log. Details name records by id only, so an erased name does not
live on in the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.operators import quality, state
from consentry.sources.staging import stage
from consentry.spec import (
    DEFAULT_OPERATOR, DISCLOSURE_DETAILS, ERASE_DETAILS, INGEST_DETAILS,
    INGEST_OPERATOR, KEY, LOCAL_ADDRESS, MESSAGE_ERASE_DETAILS, MESSAGE_OPERATOR, REPORT_DETAILS,
    SELF_UPDATE_DETAILS, TEXT_UPDATE_DETAILS, UPDATE_DETAILS,
)

AUDIT_COLUMNS = (
    "seq", "timestamp", "operator", "action_type", "target_beneficiary_id", "details",
    "ip_address", "is_anomaly",
)


def _columns(
    seq: str, at: Column, operator: Column, action: Column, target: Column, details: Column
) -> dict[str, Column]:
    return {
        "seq": F.col(seq).cast("bigint"), "timestamp": at, "operator": operator,
        "action_type": action, "target_beneficiary_id": target, "details": details,
        "ip_address": F.lit(LOCAL_ADDRESS), "is_anomaly": F.lit(0),
    }


def _rows(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(*[c.alias(name) for name, c in _columns(*columns).items()])


def ingest_columns(seq: str, at: Column) -> dict[str, Column]:
    return _columns(
        seq, at, F.lit(INGEST_OPERATOR), F.lit("BENEFICIARY_INGEST"), F.col(KEY),
        F.format_string(INGEST_DETAILS, KEY, "pillar"))


def ingest_audit(routed: DataFrame, seq: str, at: Column) -> DataFrame:
    accepted = routed.filter(F.col("ingest_status") == quality.SUCCESS)
    return accepted.select(*[c.alias(name) for name, c in ingest_columns(seq, at).items()])


def change_audit(
    writes: DataFrame, at: Column, block: int = 1 << 20, only: Column | None = None,
    seq: str = "seq",
) -> DataFrame:
    """One row per change that took effect, with the status it replaced, and one per self-service
    update of an unknown record, which is logged before it fails. Only the changes ``only`` holds
    for are reported; the other writes are their history. ``seq`` names the number logged."""
    born = state.lifetimes(writes)
    found = F.col("seq") >= F.col("first_ingest")
    alive = F.col("erased_at").isNull() | (F.col("seq") <= F.col("erased_at"))
    lost = F.coalesce(~found, F.lit(True))
    logged = stage(
        writes.filter(F.col("op") != state.HOLD)
        .join(born, KEY, "left")
        .filter(F.when(lost, F.col("op") == state.SELF_UPDATE).otherwise(alive))
        .withColumn("new_status", F.coalesce("consent_status", F.lit("None")))
    )
    known = state.previous_value(logged, KEY, "seq", "consent_status", "old_status", block)
    op = F.col("op")
    by_message = F.col("operator").eqNullSafe(F.lit(MESSAGE_OPERATOR))
    details = (
        F.when(op == state.UPDATE, F.format_string(
            UPDATE_DETAILS, KEY, "old_status", "new_status", "consent_type"))
        .when(op == state.SELF_UPDATE, F.format_string(
            SELF_UPDATE_DETAILS, "consent_data_sharing", "consent_photo_use",
            "consent_sms_contact", "consent_external_reporting", "enrollment_status"))
        .when(op == state.TEXT_UPDATE, F.concat(
            F.when(F.col("new_status") == "Withdrawn", "Withdrew").otherwise("Granted"),
            F.lit(TEXT_UPDATE_DETAILS)))
        .when(by_message, MESSAGE_ERASE_DETAILS)
        .otherwise(F.format_string(ERASE_DETAILS, KEY))
    )
    operator = (
        F.when(op == state.SELF_UPDATE, F.col(KEY)).when(op == state.TEXT_UPDATE, MESSAGE_OPERATOR)
        .otherwise(F.coalesce("operator", F.lit(DEFAULT_OPERATOR)))
    )
    action = F.when(op == state.ERASE, "ANONYMIZATION").otherwise("CONSENT_CHANGE")
    return _rows(
        known.filter((op != state.INGEST) & (F.lit(True) if only is None else only)),
        seq, at, operator, action, F.col(KEY), details,
    )


def report_audit(reports: DataFrame, seq: str, at: Column) -> DataFrame:
    return _rows(
        reports, seq, at, F.lit(MESSAGE_OPERATOR), F.lit("COMPLIANCE_REPORT"),
        F.lit(None).cast("string"),
        F.lit(REPORT_DETAILS),
    )


def disclosure_audit(gated: DataFrame, seq: str, at: Column) -> DataFrame:
    return _rows(
        gated.filter("disclosed"), seq, at, F.lit(MESSAGE_OPERATOR), F.lit("PII_ACCESS"),
        F.col(KEY), F.lit(DISCLOSURE_DETAILS),
    )


def quarantine_columns(seq: str, at: Column) -> dict[str, Column]:
    return {"event_id": F.col(seq).cast("bigint"), "timestamp": at, "raw_payload": F.col("raw"),
            "failure_reasons": F.col("failure_reasons")}


def quarantine_rows(routed: DataFrame, seq: str, at: Column) -> DataFrame:
    """Rejected events with the reasons and the payload as it came (column ``raw``)."""
    rejected = routed.filter(F.col("ingest_status") != quality.SUCCESS)
    return rejected.select(*[c.alias(name) for name, c in quarantine_columns(seq, at).items()])


def newest_first(log: DataFrame, *order: str, limit: int | None = None) -> DataFrame:
    """The log newest first. With a limit Spark keeps the top rows per task and never sorts all."""
    ordered = log.orderBy(*[F.col(c).desc() for c in order])
    return ordered if limit is None else ordered.limit(limit)
