"""The two models, on the cases they must get right."""

import pytest
from pyspark.sql import functions as F

from consentry.models import forest, intent

FEATURES = ("hour_of_day", "role_code", "region_mismatch", "query_volume")
SCHEMA = "request_id bigint, hour_of_day int, role_code int, region_mismatch int, query_volume bigint"


@pytest.fixture(scope="module")
def accesses(spark):
    """Office hours and small answers on a regular grid; every 21st access is at night, out of scope
    and large."""
    n = F.col("id")
    odd = n % 21 == 20
    return spark.range(1050).select(
        n.alias("request_id"),
        F.when(odd, n % 4 + 1).otherwise(8 + n * 7 % 11).cast("int").alias("hour_of_day"),
        F.when(odd, 1 + 2 * (n % 2)).otherwise(n % 3).cast("int").alias("role_code"),
        F.when(odd, (n % 5 > 0).cast("int")).otherwise(0).alias("region_mismatch"),
        F.when(odd, 60 + n * 13 % 100).otherwise(1 + n * 5 % 12).alias("query_volume"))


@pytest.fixture(scope="module")
def model(accesses):
    return forest.fit(accesses, FEATURES, "request_id")


def test_verdicts(spark, model):
    df = spark.createDataFrame([(1, 12, 0, 0, 10), (2, 2, 1, 1, 150)], SCHEMA)
    got = {r.request_id: r.is_anomaly for r in model.flag(df).collect()}
    assert got == {1: 0, 2: 1}


def test_about_the_contamination_share_is_flagged(accesses, model):
    flagged = model.flag(accesses).filter("is_anomaly = 1").count()
    assert 30 <= flagged <= 53


def test_both_scorings_agree(accesses, model):
    by_vector = {r.request_id: r.is_anomaly for r in model.flag(accesses).collect()}
    by_row = {r.request_id: r.is_anomaly for r in model.flag_rows(accesses).collect()}
    assert by_vector == by_row and len(by_row) == 1050


def test_independent_of_partitions_and_bounded(accesses, model):
    again = forest.fit(accesses.repartition(13), FEATURES, "request_id")
    assert again.nodes.equals(model.nodes) and again.threshold == model.threshold
    assert model.nodes["tree"].nunique() == 100 and model.sample == 256 and model.max_depth == 8
    assert len(model.nodes) <= 100 * 511


def test_few_rows(spark):
    df = spark.createDataFrame([(n, n, 0, 0, n) for n in range(5)], SCHEMA)
    small = forest.fit(df, FEATURES, "request_id", trees=10)
    assert small.sample == 5 and small.flag(df).count() == 5
    with pytest.raises(ValueError):
        forest.fit(df.limit(0), FEATURES, "request_id")


def test_trees_draw_independently(spark, monkeypatch):
    """Also from a table much larger than all samples together, two trees share few rows."""
    seen = {}
    df = spark.range(40_000).select(
        "id", F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    model = forest.fit(df, ("x", "y"), "id", trees=12, sample=64)
    for tree, part in model.nodes[model.nodes["feature"] >= 0].groupby("tree"):
        seen[tree] = set(part["threshold"])
    assert len(seen) == 12
    assert not set.intersection(*seen.values())


def test_percentile_is_exact(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(forest, "_LAST_VALUES", 5)
    rng = np.random.default_rng(1)
    values, counts = rng.normal(size=300).round(2), rng.integers(1, 9, 300)
    df = spark.createDataFrame(
        [(float(v), int(n)) for v, n in zip(values, counts)], "v double, n bigint")
    for share in (0.0, 0.05, 0.31, 0.5, 1.0):
        want = np.percentile(np.repeat(values, counts), 100 * share)
        assert forest.weighted_percentile(df, "v", "n", share) == pytest.approx(want, abs=1e-12)


def test_too_many_grams_are_refused_and_none_dropped(spark):
    rows = [(f"word{k} other{k}", "a" if k % 2 else "b") for k in range(20)]
    df = spark.createDataFrame(rows, "text string, intent string")
    with pytest.raises(ValueError, match="more than 59 grams"):
        intent.fit(df, max_vocabulary=59)
    model = intent.fit(df, max_vocabulary=60)
    assert intent.weights(spark, model).select("gram").distinct().count() == 60


@pytest.mark.parametrize("hashed", [None, 1 << 10])
def test_weights_of_all_grams(spark, hashed):
    """Every gram has weights that tell its intent."""
    rows = [(f"word{k} {'left' if k % 2 else 'right'}", "a" if k % 2 else "b") for k in range(20)]
    df = spark.createDataFrame(rows, "text string, intent string")
    model = intent.fit(df, max_vocabulary=50 if hashed is None else 10, hashed=hashed)
    got = {(r.intent, r.gram): r.weight for r in intent.gram_weights(df, model).collect()}
    assert len(got) == 2 * 42 and len({g for _, g in got}) == 42
    assert got["a", "left"] > got["b", "left"] and got["b", "right"] > got["a", "right"]
    if hashed is None:
        want = {(r.intent, r.gram): r.weight for r in intent.weights(spark, model).collect()}
        assert got == pytest.approx(want, abs=1e-12)
    told = intent.predict(df.withColumnRenamed("intent", "label"), model).collect()
    assert all(r.label == r.intent for r in told)


def test_few_rows_and_many_are_hashed_alike(spark):
    """What a feature is does not depend on how many grams there are."""
    kinds = []
    for n in (3, 300):
        rows = [(f"word{k} other{k % 7}", "ab"[k % 2]) for k in range(n)]
        model = intent.fit(
            spark.createDataFrame(rows, "text string, intent string"), max_vocabulary=20, hashed=64)
        kinds.append([type(s).__name__ for s in model.stages])
        assert model.stages[-2].coefficientMatrix.numCols == 64
    assert kinds[0] == kinds[1] and "HashingTF" in kinds[0]


@pytest.mark.parametrize("message, expected", [
    ("show my profile details", "view_data"),
    ("nataka kufuta maelezo yangu", "request_deletion"),
    ("withdraw my consent please", "update_consent"),
    ("please erase all my data", "request_deletion"),
    ("ripoti ya nyanza region", "generate_report"),
])
def test_intents(spark, message, expected):
    df = spark.createDataFrame([(1, message)], "msg_id bigint, text string")
    assert intent.predict(df, intent.default_model(spark)).first().intent == expected


def test_without_a_model_everything_is_a_question(spark):
    df = spark.createDataFrame([(1, "futa")], "msg_id bigint, text string")
    assert intent.predict(df, None).first().intent == "general_faq"


def test_model_can_be_stored(spark, folder):
    from pyspark.ml import PipelineModel

    model = intent.default_model(spark)
    model.write().overwrite().save(folder + "/intent")
    df = intent.phrases(spark)
    renamed = df.withColumnRenamed("intent", "label")
    first = intent.predict(renamed, model).collect()
    again = intent.predict(renamed, PipelineModel.load(folder + "/intent")).collect()
    assert first == again
    assert sum(r.label == r.intent for r in first) >= 0.9 * len(first)


def test_messages_become_actions(spark, sf_dir):
    from pyspark.sql import functions as F

    from consentry.plans.inputs import AFTER_ALL, Inputs
    from consentry.plans.messages import handle_messages
    from consentry.operators import state

    i = Inputs(spark, sf_dir)
    wanted = i.registry.filter("consent_status = 'Consented'").orderBy("beneficiary_id").first()
    who, other = wanted.beneficiary_id, i.registry.filter(
        F.col("beneficiary_id") != wanted.beneficiary_id).first().beneficiary_id
    texts = [f"show my profile details {who}", f"withdraw consent {other}", f"futa data yangu {who}",
             "report on the tech pillar", "how do you protect my privacy?", "show profile for nobody"]
    messages = spark.createDataFrame(list(enumerate(texts)), "msg_id bigint, text string")
    at = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    done = handle_messages(messages, i.registry, intent.default_model(spark), at)
    got = {r.msg_id: (r.action, r.beneficiary_id, r.detail) for r in done.actions.collect()}
    assert got == {
        0: ("DISCLOSURE", who, None), 1: ("CONSENT_CHANGE", other, "Withdrawn"),
        2: ("ERASURE", who, None), 3: ("REPORT", None, "pillar: Tech"),
        4: ("ANSWER", None, "privacy"), 5: ("NOT_FOUND", None, None),
    }
    assert {r.action_type for r in done.audit(at).collect()} == {"PII_ACCESS", "COMPLIANCE_REPORT"}
    after = state.apply_changes(
        i.ingest_log, state.change_writes(done.changes, F.col("seq") + AFTER_ALL))
    rows = {r.beneficiary_id: r for r in after.collect()}
    assert rows[who].status == "Anonymized" and rows[other].consent_type == "Chatbot OTP"


def test_a_published_forest_scores_alike_in_another_session(spark, sf_dir, folder):
    import subprocess
    import sys

    from consentry.models import forest, store
    from consentry.plans.inputs import Inputs

    i = Inputs(spark, sf_dir)
    names = ("hour_of_day", "role_code", "region_mismatch", "query_volume")
    features = i.features.select("request_id", *names)
    features.write.parquet(f"{folder}/features")
    model = forest.fit(features, names, "request_id", trees=10)
    assert store.load(spark, folder) is None
    assert store.publish(spark, model, folder) == 1
    again = store.load(spark, folder)
    assert (again.features, again.sample, again.max_depth, again.threshold, again.trained_on) == (
        model.features, model.sample, model.max_depth, model.threshold, features.count())
    want = sorted(map(tuple, model.flag(features).collect()), key=repr)
    assert sorted(map(tuple, again.flag(features).collect()), key=repr) == want
    code = f"""
from pyspark.sql import SparkSession
from consentry.models import store
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
rows = spark.read.parquet('{folder}/features')
store.load(spark, '{folder}', 1).flag_rows(rows).write.parquet('{folder}/scored')
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=200, capture_output=True)
    other = spark.read.parquet(f"{folder}/scored")
    assert sorted(map(tuple, other.select(*model.flag(features).columns).collect()), key=repr) == want


def test_versions_of_a_model(spark, folder, monkeypatch):
    import pandas as pd

    from consentry.models import forest, store
    from consentry.sources import manifest

    def model(threshold):
        nodes = pd.DataFrame([(0, 0, -1, 0.0, 1.0)], columns=["tree", "node", "feature", "threshold", "path"])
        return forest.IsolationForest(("x",), nodes, 2, 1, threshold)

    newest = store.Newest(spark, folder)
    assert newest() is None
    for k in (1, 2, 3):
        assert store.publish(spark, model(-0.1 * k), folder) == k
        assert newest().threshold == -0.1 * k and newest() is newest()
    assert store.load(spark, folder, 2).threshold == -0.2
    with monkeypatch.context() as m:  # killed before its name: no reader sees it
        m.setattr(manifest.Files, "rename", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.publish(spark, model(-0.9), folder)
    assert store.versions(spark, folder) == [1, 2, 3]
    store.drop(spark, folder, keep=1)
    assert store.versions(spark, folder) == [3] and newest().threshold == pytest.approx(-0.3)
    with pytest.raises(ValueError, match="no version 1"):
        store.load(spark, folder, 1)
