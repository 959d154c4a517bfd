"""Rates round as Python rounds; scopes of messages."""

import random

from pyspark.sql import functions as F

from consentry.operators import report


def test_rounding_is_pythons(spark):
    rng = random.Random(1)
    pairs = [(c, t) for t in (8, 40, 160, 400, 1600, 2000) for c in range(t + 1)]
    pairs += [(rng.randrange(t + 1), t) for t in (rng.randrange(1, 10**9) for _ in range(500))]
    df = spark.createDataFrame(pairs, "c bigint, t bigint")
    rows = df.select("c", "t", report.round_tenth(F.col("c") / F.col("t") * 100).alias("r")).collect()
    assert all(r.r == round(r.c / r.t * 100, 1) for r in rows)
    # The decimal rounding of the engine differs on some of them.
    assert any(a != b for a, b in df.select(
        report.round_tenth(F.col("c") / F.col("t") * 100),
        F.bround(F.col("c") / F.col("t") * 100, 1)).collect())


def test_empty_registry(spark):
    none = spark.createDataFrame([], "pillar string, region string, consent_status string, status string")
    row = report.report_global(none).first()
    assert (row.total, row.consent_rate) == (0, 0.0)


def test_an_erased_record_counts_twice(spark):
    df = spark.createDataFrame(
        [("Tech", "Nyanza", "Withdrawn", "Anonymized"), ("Tech", "Coastal", "Consented", "Active")],
        "pillar string, region string, consent_status string, status string")
    rows = {(r.scope, r.name): r for r in report.report_all(df).collect()}
    assert set(rows) == {("global", "All"), ("pillar", "Tech"), ("region", "Nyanza"), ("region", "Coastal")}
    g = rows[("global", "All")]
    assert (g.total, g.consented, g.withdrawn, g.erasures, g.consent_rate) == (2, 1, 1, 1, 50.0)


def test_scope_of_a_message(spark):
    texts = ["report on the tech pillar in Nyanza", "ripoti ya nyanza", "stats for north eastern",
             "eastern", "generate report", "VOCATIONAL and plus"]
    df = spark.createDataFrame(list(enumerate(texts)), "msg_id bigint, text string")
    got = [(r.scope, r.name) for r in report.report_scope(df).orderBy("msg_id").collect()]
    assert got == [("pillar", "Tech"), ("region", "Nyanza"), ("region", "North Eastern"),
                   ("region", "Eastern"), ("global", "All"), ("pillar", "Plus")]


def test_topics(spark):
    df = spark.createDataFrame(
        [(1, "je KPC inalinda data"), (2, "Delete me"), (3, "hello")], "msg_id bigint, text string")
    assert [r.topic for r in report.message_topic(df).orderBy("msg_id").collect()] == [
        "privacy", "rights", "help"]
