"""The batch ETL: scan, stage, clean, gate, then replace the registry and write the clean CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consentry.operators import quality, standardise
from consentry.operators.standardise import FILE_ORDER
from consentry.sources import files, store
from consentry.sources.staging import stage
from consentry.spec import DEFAULT_SPEC, RegistrySpec


def extract(spark: SparkSession, csv_path: str, stage_path: str | None = None) -> DataFrame:
    """Read the raw CSV and keep it untouched as a staged table, with the order of its rows."""
    return stage(files.read_registry_csv(spark, csv_path, number=FILE_ORDER), stage_path)


def transform(extracted: DataFrame, stage_path: str | None = None) -> DataFrame:
    """Clean and stage: the gate and both sinks read the staged table, not the lineage."""
    return stage(standardise.clean_batch(extracted), stage_path)


def load(
    transformed: DataFrame, clean_csv: str, root: str, spec: RegistrySpec = DEFAULT_SPEC
) -> int:
    """Gate the whole batch, then write it. Raises ``QualityGateError`` with nothing written.

    Returns the version of the new registry snapshot. Its rows come before every later write, in
    the order of the file (``row_order`` of the batch -1).
    """
    batch = quality.require_valid(transformed, spec.batch_rules)
    files.write_csv(batch.drop(FILE_ORDER), clean_csv, mode="overwrite")
    typed = standardise.type_registry(batch, (FILE_ORDER,))
    return store.load_registry(
        typed.withColumn("row_order", store.place(-1, F.col(FILE_ORDER))), root)


def run(spark: SparkSession, csv_path: str, clean_csv: str, root: str) -> int:
    return load(transform(extract(spark, csv_path)), clean_csv, root)
