"""A write log with one hot key, made by Spark."""

from pyspark.sql import functions as F

from consentry.operators import state
from consentry.spec import FLAGS, KEY, REGISTRY_COLUMNS


def writes(spark, rows, keys):
    n = F.col("id")
    hot = (n % 3 == 0) & (n >= keys)
    who = F.when(hot, F.lit(0)).otherwise(n % keys)
    op = F.when(n < keys, state.INGEST).when(
        (n >= rows - keys) & (who % 10 == 1), state.ERASE).otherwise(state.UPDATE)
    values = {c: F.concat(F.lit(c), n.cast("string")) for c in REGISTRY_COLUMNS}
    values |= {KEY: F.concat(F.lit("P"), who.cast("string")), "status": F.when(
        op == state.ERASE, "Anonymized").otherwise("Active"),
        "consent_date": F.lit(None).cast("timestamp_ntz")}
    values |= {f: (n % 2).cast("int") for f in FLAGS}
    return spark.range(0, rows, 1, 8).select(
        n.alias("seq"), op.alias("op"),
        F.lit(None).cast("string").alias("operator"), *[values[c].alias(c) for c in REGISTRY_COLUMNS])
