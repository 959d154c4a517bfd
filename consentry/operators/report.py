"""Consent reports: one pass over the registry for any number of scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.functions.text import contains_any, first_contained
from consentry.sources.staging import lookup
from consentry.spec import DEFAULT_SPEC, TOPIC_WORDS, RegistrySpec

COUNTS = ("total", "consented", "pending", "withdrawn", "erasures")


def _counts() -> list[Column]:
    status = F.col("consent_status")
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "Consented").alias("consented"),
        F.count_if(status == "Pending").alias("pending"),
        F.count_if(status == "Withdrawn").alias("withdrawn"),
        F.count_if(F.col("status") == "Anonymized").alias("erasures"),
    ]


def round_tenth(x: Column) -> Column:
    """Round to one decimal, ties to even, judged on the exact binary value as Python does.

    10x is the sum of 8x and 2x, both exact; the sum's rounding error tells on which side of a
    half the exact value lies.
    """
    high, low = x * 8, x * 2
    p = high + low
    rest = p - high
    error = (high - (p - rest)) + (low - rest)
    at_half = F.abs(p - F.rint(p)) == 0.5
    tenths = (
        F.when(at_half & (error > 0), F.ceil(p)).when(at_half & (error < 0), F.floor(p))
        .otherwise(F.rint(p))
    )
    return tenths.cast("double") / 10


def _rate() -> Column:
    percent = F.col("consented") / F.col("total") * 100
    return F.when(F.col("total") > 0, round_tenth(percent)).otherwise(F.lit(0.0)).alias(
        "consent_rate"
    )


def report_global(registry: DataFrame) -> DataFrame:
    return registry.agg(*_counts()).select("*", _rate())


def report_by(registry: DataFrame, column: str) -> DataFrame:
    return registry.groupBy(column).agg(*_counts()).select("*", _rate())


def report_cells(registry: DataFrame, *by: str) -> DataFrame:
    """Counts per (pillar, region), and per ``by``: what all reports are sums of."""
    return registry.groupBy(*by, "pillar", "region").agg(*_counts())


def roll_up(cells: DataFrame) -> DataFrame:
    """Global, per-pillar and per-region reports, keyed by ``(scope, name)``, from cells."""
    sets = cells.groupingSets(
        [["pillar"], ["region"], []], "pillar", "region"
    ).agg(F.grouping_id("pillar", "region").alias("_gid"), *[F.sum(c).alias(c) for c in COUNTS])
    gid = F.col("_gid")
    return sets.select(
        F.when(gid == 1, "pillar").when(gid == 2, "region").otherwise("global").alias("scope"),
        F.when(gid == 1, F.col("pillar")).when(gid == 2, F.col("region")).otherwise("All")
        .alias("name"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS],
    ).select("*", _rate())


def report_all(registry: DataFrame) -> DataFrame:
    """Global, per-pillar and per-region reports, keyed by ``(scope, name)``.

    Counts are taken per (pillar, region) first and rolled up from those few rows.
    """
    return roll_up(report_cells(registry))


def report_scope(messages: DataFrame, spec: RegistrySpec = DEFAULT_SPEC) -> DataFrame:
    """Adds the ``(scope, name)`` of the report a message asks for: a pillar first, then a region,
    else the global one."""
    lowered = F.lower("text")
    pillar = first_contained(lowered, spec.pillars)
    region = first_contained(lowered, spec.regions)
    return messages.withColumns(
        {
            "scope": F.when(pillar.isNotNull(), "pillar").when(region.isNotNull(), "region")
            .otherwise("global"),
            "name": F.coalesce(pillar, region, F.lit("All")),
        }
    )


def scoped_reports(messages: DataFrame, registry: DataFrame) -> DataFrame:
    """The report each message asks for. The reports are 13 rows with the default domains; they are
    staged, so Spark knows their size and broadcasts them if they are as small as that."""
    return report_scope(messages).join(lookup(report_all(registry)), ["scope", "name"], "left")


def message_topic(messages: DataFrame) -> DataFrame:
    lowered = F.lower("text")
    topic = F.coalesce(
        *[F.when(contains_any(lowered, words), t) for t, words in TOPIC_WORDS.items()],
        F.lit("help"),
    )
    return messages.withColumn("topic", topic)
