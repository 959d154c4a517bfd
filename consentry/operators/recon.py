"""Monthly reconciliation of payments against attendance and consent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.operators.state import HOLD
from consentry.spec import KEY, LOCAL_ADDRESS

MIN_ATTENDANCE = 75
STIPEND = 5000
CELL = (KEY, "month")


def attendance_rate(attendance: DataFrame, minimum: int = MIN_ATTENDANCE) -> DataFrame:
    """Sessions per (person, month) and whether they reach ``minimum`` percent, in integers."""
    per_month = attendance.groupBy(*CELL).agg(
        F.sum("sessions_held").cast("bigint").alias("sessions_held"),
        F.sum("sessions_attended").cast("bigint").alias("sessions_attended"),
    )
    return per_month.withColumn(
        "attended_enough",
        (F.col("sessions_held") > 0)
        & (F.col("sessions_attended") * 100 >= F.col("sessions_held") * minimum),
    )


def recon_join(
    rates: DataFrame, disbursements: DataFrame, registry: DataFrame
) -> DataFrame:
    """Attendance, payment and consent side by side, one row per (person, month) on any side.

    Payments are summed per cell first, so each side has one row per cell and no cell can be hot.
    The sides meet in an aggregation by hash, where a full join would sort both. A cell
    with a null matches nothing, so there the sides stay apart.
    """
    paid = disbursements.groupBy(*CELL).agg(F.sum("amount").cast("bigint").alias("amount"))
    no_cell = F.col(KEY).isNull() | F.col("month").isNull()
    sides = [
        side.withColumn("_side", F.when(no_cell, number))
        for number, side in enumerate((rates, paid))
    ]
    values = ("sessions_held", "sessions_attended", "attended_enough", "amount")
    return (
        sides[0].unionByName(sides[1], allowMissingColumns=True)
        .groupBy(*CELL, "_side").agg(*[F.max(c).alias(c) for c in values])
        .join(registry.select(KEY, "consent_data_sharing"), KEY, "left")
        .select(
            *CELL,
            "sessions_held",
            "sessions_attended",
            F.coalesce("attended_enough", F.lit(False)).alias("attended_enough"),
            F.coalesce(F.col("consent_data_sharing") == 1, F.lit(False)).alias("consent_active"),
            F.coalesce("amount", F.lit(0)).cast("bigint").alias("actual"),
        )
    )


def expected_stipend(joined: DataFrame, stipend: int = STIPEND) -> DataFrame:
    due = F.col("attended_enough") & F.col("consent_active")
    return joined.withColumn("expected", F.when(due, stipend).otherwise(0).cast("bigint"))


def reconcile(expected: DataFrame) -> DataFrame:
    """Adds ``outcome`` and, for over-payments, the ``reason``."""
    over = F.col("actual") > F.col("expected")
    reason = F.concat_ws(
        "; ",
        F.when(~F.col("attended_enough"), "low attendance"),
        F.when(~F.col("consent_active"), "withdrawn consent"),
    )
    return expected.withColumns(
        {
            "outcome": F.when(over, "OVERPAID")
            .when(F.col("actual") < F.col("expected"), "UNDERPAID")
            .otherwise("MATCHED"),
            "reason": F.when(over, F.when(reason == "", "above stipend").otherwise(reason)),
        }
    )


def recall_ledger(reconciled: DataFrame) -> DataFrame:
    """The amount to recall per over-paid (person, month). The same input gives the same rows."""
    return reconciled.filter(F.col("outcome") == "OVERPAID").select(
        *CELL, (F.col("actual") - F.col("expected")).alias("recall_amount"), "reason"
    )


def hold_requests(ledger: DataFrame, seq: Column, as_of: Column) -> DataFrame:
    """One hold per person in the ledger, as change requests."""
    none = F.lit(None)
    return ledger.select(KEY).distinct().select(
        seq.alias("seq"),
        KEY,
        F.lit(HOLD).alias("op"),
        none.cast("string").alias("new_status"),
        none.cast("string").alias("consent_type"),
        *[none.cast("int").alias(f) for f in ("f_sharing", "f_photo", "f_sms", "f_report")],
        as_of.alias("as_of"),
    )


def recall_audit(ledger: DataFrame, operator: str = "system") -> DataFrame:
    details = F.format_string(
        "Recalled %d for %s (%s); account on hold.",
        "recall_amount", F.date_format("month", "yyyy-MM"), "reason",
    )
    return ledger.select(
        F.col("month").alias("timestamp"),
        F.lit(operator).alias("operator"),
        F.lit("PAYOUT_RECALL").alias("action_type"),
        F.col(KEY).alias("target_beneficiary_id"),
        details.alias("details"),
        F.lit(LOCAL_ADDRESS).alias("ip_address"),
        F.lit(0).alias("is_anomaly"),
    )
