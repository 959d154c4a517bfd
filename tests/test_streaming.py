"""Drained streams equal the batch jobs."""

from pyspark.sql import functions as F

from consentry.operators import quality, state
from consentry.plans.inputs import Inputs
from consentry.sources import files
from consentry.spec import EVENT_COLUMNS
from consentry.streaming import ingest


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_many_batches_equal_one(spark, sf_dir, folder):
    i = Inputs(spark, sf_dir)
    bounds = [0, 400, 401, 1100, 1500]
    for n, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        i.events.filter(f"event_seq >= {lo} AND event_seq < {hi}").coalesce(1).write.parquet(
            f"{folder}/in/part={n}")
        # Files of one folder are read in the order they were written.
        stream = (
            spark.readStream.schema(i.events.schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        )
        ingest.start_ingest(stream, f"{folder}/out").awaitTermination()
    out = f"{folder}/out"
    assert ingest.accepted(spark, out).select("batch_id").distinct().count() == 4
    assert rows(ingest.registry(spark, out)) == rows(i.registry)
    assert rows(ingest.quarantined(spark, out).drop("batch_id")) == rows(
        ingest.quarantine(i.routed))
    assert ingest.audited(spark, out).count() == i.accepted.count()


def test_a_batch_run_twice_counts_once(spark, sf_dir, folder):
    i = Inputs(spark, sf_dir)
    for _ in range(2):
        ingest.store_batch(i.events, 3, folder)
    assert rows(ingest.registry(spark, folder)) == rows(i.registry)
    assert ingest.quarantined(spark, folder).count() == i.routed.filter(
        F.col("ingest_status") != quality.SUCCESS).count()


def test_payload_lines_and_corrupt_ones(spark, sf_dir, folder):
    i = Inputs(spark, sf_dir)
    good = i.events.orderBy("event_seq").limit(20)
    lines = good.select(
        "event_seq", "arrived_at",
        F.to_json(F.struct(*EVENT_COLUMNS), {"ignoreNullFields": "false"}).alias("value"))
    broken = lines.limit(3).withColumn("event_seq", F.col("event_seq") + 10_000).withColumn(
        "value", F.expr("left(value, length(value) - 4)"))
    parsed = files.parse_events(lines.unionByName(broken))
    assert rows(parsed.filter("_corrupt_record IS NULL").drop("_corrupt_record", "payload")) == rows(
        good.select("event_seq", "arrived_at", *EVENT_COLUMNS))
    ingest.store_batch(parsed, 0, folder)
    lost = ingest.quarantined(spark, folder).filter("event_id >= 10000").collect()
    assert len(lost) == 3
    assert {r.failure_reasons for r in lost} == {ingest.CORRUPT_REASON}
    assert all(r.raw_payload.startswith('{"beneficiary_id"') for r in lost)


def test_empty_logs_are_empty(spark, folder):
    assert ingest.registry(spark, folder + "/none").count() == 0
    assert state.registry_upsert(
        ingest.accepted(spark, folder + "/none"), "event_seq").count() == 0


def test_drained_alerts_equal_the_batch_job(spark, sf_dir, folder):
    from consentry.models import forest
    from consentry.operators import access
    from consentry.sources import tables
    from consentry.streaming import alerts

    i = Inputs(spark, sf_dir)
    features = ("hour_of_day", "role_code", "region_mismatch", "query_volume")
    model = forest.fit(i.features, features, "request_id", trees=20)
    want = access.access_audit(access.mask_decision(model.flag_rows(i.features)))
    schema = tables.load(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    requests = tables.adapt(spark, "access_requests", {"events": stream})
    volumes = access.view_volumes(i.registry)
    policy = access.policy_of(i.requests)
    alerts.start_alerts(requests, policy, volumes, model, folder).awaitTermination()
    got = alerts.alerts(spark, folder).drop("batch_id")
    assert rows(got.select(*want.columns)) == rows(want)
    assert {r.is_anomaly for r in want.collect()} == {0, 1}


def test_each_micro_batch_sees_the_registry_and_the_model_of_its_time(spark, sf_dir, folder):
    import pandas as pd

    from consentry.models import forest, store
    from consentry.operators import access
    from consentry.streaming import alerts

    i = Inputs(spark, sf_dir)
    half = i.events.filter("event_seq < 700")
    ingest.store_batch(half, 0, f"{folder}/registry")
    policy = spark.createDataFrame([("desk", "hq_admin", "All", "All")], access.POLICY_SCHEMA)

    def constant(anomalous):
        """A forest of one leaf: every access, or none, is below its threshold."""
        nodes = pd.DataFrame(
            [(0, 0, -1, 0.0, 1.0)], columns=["tree", "node", "feature", "threshold", "path"])
        return forest.IsolationForest(
            ("hour_of_day", "query_volume"), nodes, 2, 1, 1.0 if anomalous else -2.0)

    def ask(n):
        spark.createDataFrame(
            [(n, "2025-01-01 12:00:00", "desk", "All", "All", "All", False)],
            "request_id bigint, ts string, operator string, region string, pillar string, "
            "purpose string, force_anonymize boolean",
        ).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode(
            "append").parquet(f"{folder}/in")
        schema = spark.read.parquet(f"{folder}/in").schema
        alerts.start_alerts(
            spark.readStream.schema(schema).parquet(f"{folder}/in"), policy,
            alerts.live_volumes(spark, f"{folder}/registry"), newest, f"{folder}/out",
        ).awaitTermination()
        row = alerts.alerts(spark, f"{folder}/out").filter(F.col("seq") == n).first()
        return row.details, row.is_anomaly

    newest = store.Newest(spark, f"{folder}/models")
    counts = [ingest.registry(spark, f"{folder}/registry").count()]
    told = [ask(1)]
    ingest.store_batch(i.events.filter("event_seq >= 700"), 1, f"{folder}/registry")
    store.publish(spark, constant(True), f"{folder}/models")
    counts.append(i.registry.count())
    told.append(ask(2))
    store.publish(spark, constant(False), f"{folder}/models")
    told.append(ask(3))
    assert counts[0] < counts[1]
    assert [a for _, a in told] == [0, 1, 0]
    for (details, _), n in zip(told, [counts[0], counts[1], counts[1]]):
        assert str(n) in details
