"""Shapes of physical plans that must hold at any scale."""

import re

import pytest
from pyspark.sql import functions as F

from consentry.operators import access, linking, state
from consentry.plans.inputs import Inputs
from consentry.plans.queries import QUERIES
from consentry.spec import KEY

PYTHON = ("isolation", "stream_access_alerts", "access_alerts_scored")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    """The plan with the full details of its scans."""
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


LAZY = [
    "standardise_events", "clean_batch", "gate_report", "gate_rows", "route_ingest",
    "registry_upsert", "apply_changes", "change_not_found", "consent_transitions", "purge_erased",
    "directory_masked", "request_volume", "access_alerts", "link_messages_wide",
    "link_messages_tokens", "report_all", "report_scope", "reconcile", "recall_holds",
]


@pytest.fixture
def without_broadcast(spark):
    """Plans as for tables too large to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", LAZY)
def test_no_product_joins_and_no_python(spark, sf_dir, without_broadcast, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas", text)
    # A single partition is only for final rows of counters, never for data.
    assert text.count("SinglePartition") <= 2


def test_records_are_repeated_for_requested_views_only(spark, sf_dir):
    """One view asked for: the generator makes as many rows as the view has records."""
    i = Inputs(spark, sf_dir)
    asked = spark.createDataFrame(
        [(1, "Nyanza", "Tech", "All", False, True)],
        "request_id bigint, region_filter string, pillar_filter string, purpose string, "
        "masked boolean, allowed boolean")
    df = access.directory(asked, i.registry)
    rows = df.collect()
    n = i.registry.filter("region = 'Nyanza' AND pillar = 'Tech'").count()
    assert len(rows) == n > 0
    text = plan(df)
    assert "Generate" in text and "filter(" in text.replace("Filter", "filter")


def test_directory_filters_reach_the_scan(spark, sf_dir):
    rows = access.directory_filter(
        Inputs(spark, sf_dir).registry, region="Nyanza", pillar="Tech", purpose="sms_contact")
    text = scans(rows.select(KEY))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "EqualTo(region,Nyanza)" in pushed and "EqualTo(pillar,Tech)" in pushed
    assert "EqualTo(consent_sms_contact,1)" in pushed
    assert "full_name" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def test_reports_read_only_what_they_count(spark, sf_dir):
    schema = re.search(r"ReadSchema: struct<(\S+)>", scans(QUERIES["report_all"](spark, sf_dir)))
    assert sorted(c.split(":")[0] for c in schema.group(1).split(",")) == [
        "consent_status", "pillar", "region", "status"]


def test_folds_combine_before_the_shuffle(spark, sf_dir):
    text = plan(QUERIES["registry_upsert"](spark, sf_dir))
    final, partial = text.index("functions=[max_by"), text.index("functions=[partial_max_by")
    assert final < text.index("Exchange hashpartitioning(beneficiary_id") < partial


def test_the_log_is_folded_before_it_is_shuffled(spark, sf_dir):
    """With the erased keys broadcast, no uncombined write crosses the network."""
    text = plan(QUERIES["apply_changes"](spark, sf_dir))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    partial = text.index("functions=[partial_max")
    assert "Exchange hashpartitioning" not in text[partial:]


def test_the_block_window_is_partitioned_by_key_and_block(spark, sf_dir, without_broadcast):
    text = plan(QUERIES["consent_transitions"](spark, sf_dir))
    first = text.index("windowspecdefinition(beneficiary_id")
    exchange = text.index("Exchange hashpartitioning(beneficiary_id", first)
    assert "_block" in text[exchange:text.index("\n", exchange)]


def test_a_hot_key_is_split_in_the_erasure_join(spark, without_broadcast):
    """One key with a third of all writes: the join splits it, and the fold still combines."""
    from compare_writes import writes

    log = writes(spark, rows=60_000, keys=3_000)
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = state.apply_changes(log)
        rows = df.collect()
        assert "skew=true" in plan(df)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == 3_000
    # A third of the keys, every multiple of three, gave its last writes to the hot one.
    erased = {f"P{k}" for k in range(3_000) if k % 10 == 1 and k % 3}
    assert {r[KEY] for r in rows if r.status == "Anonymized"} == erased


def test_few_substrings_survive_the_bitmap(spark):
    people = spark.createDataFrame(
        [(f"REG-{k:06d}", f"Name{k} X", f"{k:08d}", f"+2547{k:08d}", k) for k in range(200)],
        "beneficiary_id string, full_name string, national_id string, phone string, row_order bigint")
    keys = linking.link_keys(people)
    text = spark.createDataFrame(
        [(True, f"{a}{b}{c}defg") for a in "klmpq" for b in "xyz" for c in "0vw"] + [(True, "00000007")],
        "plus boolean, key string")
    kept = text.withColumn("_s", linking._slot("key")).filter(
        linking._may_be_key(linking._starts(keys)))
    assert [r.key for r in kept.filter(F.col("key") == "00000007").collect()] == ["00000007"]
    assert kept.count() <= 3
