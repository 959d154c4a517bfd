"""Quality gates: violation flags per row, counts per rule, and the routing of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.sources.staging import lookup
from consentry.spec import DEFAULT_SPEC, KEY, RegistrySpec, Rule

SUCCESS, QUARANTINED, ERROR = "SUCCESS", "QUARANTINED", "ERROR"


class QualityGateError(ValueError):
    """The batch broke at least one rule; ``failures`` holds one entry per broken rule."""

    def __init__(self, failures: list[dict]):
        self.failures = failures
        super().__init__(
            "batch rejected: "
            + ", ".join(f"{f['rule']}({f['column_name']})={f['unexpected']}" for f in failures)
        )


def violates(rule: Rule) -> Column:
    """True where a row breaks a rule that one row can break. Never null."""
    c = F.col(rule.column)
    if rule.kind == "not_null":
        return c.isNull()
    if rule.kind == "in_set":
        bad = ~c.isin(*rule.values)
    elif rule.kind == "regex":
        bad = ~c.rlike(rule.pattern)
    else:
        raise ValueError(f"{rule.kind} is not a rule about one row")
    return F.coalesce(bad, F.lit(rule.null_fails))


def row_violations(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The rows that break any of ``rules``."""
    return df.filter(reduce(Column.__or__, [violates(r) for r in rules]))


def duplicated_rows(df: DataFrame, column: str = KEY) -> DataFrame:
    """Every row whose ``column`` occurs more than once.

    The counts are aggregated before the shuffle and joined back; adaptive skew handling splits
    a value that dominates the table.
    """
    repeated = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(column)
    )
    return df.join(lookup(repeated), column, "left_semi")


def failure_reasons(rules: tuple[Rule, ...]) -> Column:
    """The reasons of all broken rules, in the order of ``rules``. No reason is empty, and unlike
    ``array_compact`` the removal is compiled."""
    reasons = [F.when(violates(r), F.lit(r.reason)).otherwise("") for r in rules]
    return F.array_remove(F.array(*reasons), "") if reasons else F.array().cast("array<string>")


def gate_rows(df: DataFrame, rules: tuple[Rule, ...] = DEFAULT_SPEC.row_rules) -> DataFrame:
    """Adds ``failure_reasons`` and ``is_valid``; a projection only."""
    checked = df.withColumn("failure_reasons", failure_reasons(rules))
    return checked.withColumn("is_valid", F.size("failure_reasons") == 0)


def gate_report(df: DataFrame, rules: tuple[Rule, ...] = DEFAULT_SPEC.batch_rules) -> DataFrame:
    """One row per rule with its unexpected count, all rules in one pass.

    Row rules are summed per key next to the key's row count, so uniqueness needs no second scan
    and the one shuffle carries a row of counters per key and map task.
    """
    row_rules = [(i, r) for i, r in enumerate(rules) if r.kind != "unique"]
    keys = {r.column for r in rules if r.kind == "unique"}
    if len(keys) > 1:
        raise ValueError("one unique column per report")
    counters = [F.count_if(violates(r)).alias(f"_v{i}") for i, r in row_rules]
    totals = [F.sum(f"_v{i}").alias(f"_v{i}") for i, _ in row_rules]
    if keys:
        key = keys.pop()
        per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *counters)
        repeated = F.sum(F.when(F.col(key).isNotNull() & (F.col("_n") > 1), F.col("_n")))
        at = next(i for i, r in enumerate(rules) if r.kind == "unique")
        one = per_key.agg(*totals, repeated.alias(f"_v{at}"))
    else:
        one = df.agg(*counters)
    lines = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(r.check).alias("rule"),
                F.lit(r.column).alias("column_name"),
                F.coalesce(F.col(f"_v{i}"), F.lit(0)).cast("bigint").alias("unexpected"),
            )
            for i, r in enumerate(rules)
        ]
    )
    return one.select(F.inline(lines)).withColumn("passed", F.col("unexpected") == 0)


def require_valid(df: DataFrame, rules: tuple[Rule, ...] = DEFAULT_SPEC.batch_rules) -> DataFrame:
    """Return ``df`` if it breaks no rule, else raise before anything is written.

    Brings one row per rule to the driver. ``df`` is read once here and again by the caller's
    sink, so hand in a staged table rather than a long lineage.
    """
    failed = gate_report(df, rules).filter(~F.col("passed")).orderBy("position").collect()
    if failed:
        raise QualityGateError([row.asDict() for row in failed])
    return df


def route_ingest(
    standardised: DataFrame,
    spec: RegistrySpec = DEFAULT_SPEC,
    rules: tuple[Rule, ...] | None = None,
) -> DataFrame:
    """Adds ``ingest_status`` and ``failure_reasons`` (one text).

    SUCCESS rows may enter the registry, QUARANTINED rows broke a rule, and ERROR rows passed the
    gate but lack a value the registry requires. ERROR rows are kept, with their reason.
    """
    gated = gate_rows(standardised, rules or spec.row_rules)
    # Nulls are skipped by ``concat_ws``.
    missing = F.array(
        *[F.when(F.col(c).isNull(), F.lit(f"Load failed on column '{c}': value is null"))
          for c in spec.required]
    )
    lacks = reduce(Column.__or__, [F.col(c).isNull() for c in spec.required], F.lit(False))
    status = F.when(~F.col("is_valid"), QUARANTINED).when(lacks, ERROR).otherwise(SUCCESS)
    return gated.select(
        *standardised.columns,
        status.alias("ingest_status"),
        F.when(~F.col("is_valid"), F.concat_ws("; ", "failure_reasons"))
        .otherwise(F.concat_ws("; ", missing)).alias("failure_reasons"),
    )


def ingest_outcomes(routed: DataFrame) -> DataFrame:
    return routed.groupBy("ingest_status").agg(F.count(F.lit(1)).alias("n_events"))
