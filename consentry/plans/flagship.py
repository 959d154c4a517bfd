"""The main line of work, from raw events to the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consentry.operators import quality, report, state
from consentry.plans.inputs import Inputs
from consentry.sources.staging import stage


def registration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events, standardised, gated, routed and upserted; then the consent report per scope.

    The routed events are staged, as the ingest job stores them: a filter on the outcome would
    otherwise move below the cleansing and run it twice.
    """
    routed = stage(Inputs(spark, sf_dir).routing)
    accepted = routed.filter(F.col("ingest_status") == quality.SUCCESS)
    return report.report_all(state.registry_upsert(accepted, "event_seq"))
