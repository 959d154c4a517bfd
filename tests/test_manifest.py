"""Logs and snapshots change as a whole: whatever step fails, readers see the old or the new."""

import datetime as dt
import glob
import json

import pytest
from pyspark.sql import functions as F
from test_state import frames, history, simulate

from consentry.operators import report, state
from consentry.plans.inputs import Inputs
from consentry.registry import Registry
from consentry.sources import files, manifest, store
from consentry.spec import KEY
from consentry.streaming import ingest

#: Every step of a call, in order: what it writes, the manifest, its rename, what it deletes.
STEPS = [("manifest", "write"), ("Files", "write"), ("Files", "rename"), ("manifest", "clean"),
         ("Files", "delete")]


class Killed(Exception):
    pass


def kill(monkeypatch, owner, name, after):
    """Ends the call before, or right after, the step is done."""
    place = manifest if owner == "manifest" else manifest.Files
    real = getattr(place, name)

    def step(*args, **kwargs):
        if after:
            real(*args, **kwargs)
        raise Killed

    monkeypatch.setattr(place, name, step)


def content(spark, root):
    def rows(df):
        return sorted(map(repr, df.collect()))

    return (rows(store.current(spark, root).drop("row_order")),
            rows(ingest.quarantined(spark, root)), rows(ingest.audited(spark, root)))


def payloads(spark, *rows):
    good = {"beneficiary_id": "REG-1", "full_name": "Zawadi Unique", "national_id": "77123456",
            "email": "z@post.example", "phone": "0711999888", "pillar": "Tech", "region": "Nyanza",
            "consent_status": "Consented"}
    return files.parse_events(
        spark.createDataFrame([(json.dumps(good | r),) for r in rows], "value string"))


@pytest.fixture
def two_batches(spark, folder):
    """A registry with a snapshot, two batches after it, and quarantined rows of an erased person."""
    bad = {"pillar": "Nowhere"}
    ingest.store_batch(payloads(spark, {}, bad, {"beneficiary_id": "REG-2"}), 0, folder)
    store.compact(spark, folder)
    erase = state.change_writes(spark.createDataFrame(
        [(0, "REG-1", "erase_subject", None, None, 0, 0, 0, 0, dt.datetime(2025, 1, 1))],
        "seq bigint, beneficiary_id string, op string, new_status string, consent_type string, "
        "f_sharing int, f_photo int, f_sms int, f_report int, as_of timestamp_ntz"))
    store.append_writes(erase, folder, 1)
    ingest.store_batch(payloads(spark, bad, {"beneficiary_id": "REG-3"}), 2, folder)
    return folder


CALLS = {
    "repeated batch": lambda spark, root: ingest.store_batch(
        payloads(spark, {"beneficiary_id": "REG-4", "pillar": "None"}), 2, root),
    "compact": store.compact,
    "purge": lambda spark, root: store.purge_quarantine(spark, root, ingest.QUARANTINE_SCHEMA),
    "load": lambda spark, root: store.load_registry(
        store.current(spark, root).filter(f"{KEY} = 'REG-2'"), root),
}


@pytest.mark.parametrize("call", CALLS)
def test_a_call_that_is_killed_leaves_all_or_nothing(spark, two_batches, monkeypatch, call):
    if call == "purge":
        store.compact(spark, two_batches)  # from the snapshot on, REG-1 is erased
    old, seen = content(spark, two_batches), []
    for owner, name in STEPS:
        for after in (False, True):
            with monkeypatch.context() as m:
                kill(m, owner, name, after)
                try:
                    CALLS[call](spark, two_batches)
                except Killed:
                    seen.append(content(spark, two_batches))
    CALLS[call](spark, two_batches)
    new = content(spark, two_batches)
    assert len(seen) >= 5 and all(s in (old, new) for s in seen)
    if call != "compact":  # which changes no content
        assert old != new
    manifest.clean(spark, two_batches, manifest.Manifest(), hours=0)
    assert content(spark, two_batches) == new
    named = manifest.read(spark, two_batches).paths()
    on_disk = {p.split("/data/")[1].split("/")[0] for p in glob.glob(f"{two_batches}/data/write=*")}
    assert on_disk == {p.split("/")[1] for p in named}


def test_the_faster_commit_wins_and_the_other_starts_from_it(spark, folder, monkeypatch):
    real, raced = manifest.Files.write, []

    def write(self, name, text):
        if not raced:
            raced.append(1)
            manifest.commit(spark, folder, lambda m: m.logs.setdefault("a", {}).update({1: ("x", [])}))
        real(self, name, text)

    monkeypatch.setattr(manifest.Files, "write", write)
    done = manifest.commit(spark, folder, lambda m: m.logs.setdefault("b", {}).update({2: ("y", [])}))
    assert done.number == 2 and set(done.logs) == {"a", "b"}
    assert manifest.read(spark, folder) == done


def test_compaction_reads_and_writes_the_changed_bucket_alone(spark, folder):
    manifest.create(spark, folder, 16)
    log = history(21, n=600)
    whole, _, _ = simulate(log, True)
    first, change = frames(spark, log, 2)
    store.append_writes(state.union_writes(first, change), folder, 0)
    store.compact(spark, folder)
    before = manifest.read(spark, folder).snapshots[-1].buckets
    assert len(before) == 16
    one = store.snapshot(spark, folder).filter("status = 'Active'").first()
    row = spark.createDataFrame([(5, one[KEY], "hold", None, None, 0, 0, 0, 0, None)],
        "seq bigint, beneficiary_id string, op string, new_status string, consent_type string, "
        "f_sharing int, f_photo int, f_sms int, f_report int, as_of timestamp_ntz")
    store.append_writes(state.change_writes(row), folder, 1)
    m = manifest.read(spark, folder)
    plan = store._folded(spark, folder, m, True)
    held = {f.split("bucket=")[1].split("/")[0] for f in plan.inputFiles() if "bucket=" in f}
    assert len(held) == 1
    store.compact(spark, folder)
    after = manifest.read(spark, folder).snapshots[-1].buckets
    assert {b for b in after if after[b] != before[b]} == {int(held.pop())}
    got = {r[KEY]: r.enrollment_status for r in store.snapshot(spark, folder).collect()}
    assert got == {k: r["enrollment_status"] for k, r in whole.items()} | {one[KEY]: "On Hold"}


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_any_number_of_buckets_gives_the_full_fold(spark, folder, buckets):
    manifest.create(spark, folder, buckets)
    log = history(22, n=300)
    whole, _, _ = simulate(log, True)
    for b in range(3):
        first, change = frames(spark, log[b * 100:(b + 1) * 100], 2)
        store.append_writes(state.union_writes(first, change), folder, b)
        if b == 1:
            store.compact(spark, folder)
    got = {r[KEY]: r.asDict() | {"row_order": r.row_order.seq}
           for r in store.current(spark, folder).collect()}
    assert got == whole


def test_older_snapshots_stay_for_readers_that_hold_them(spark, two_batches):
    held = store.snapshot(spark, two_batches)
    want = held.count()
    store.compact(spark, two_batches, retain=1)
    assert held.count() == want and len(store.versions(spark, two_batches)) == 2
    store.compact(spark, two_batches)
    assert len(store.versions(spark, two_batches)) == 1


@pytest.mark.parametrize("sticky", [True, False])
def test_maintained_reports_equal_the_full_ones(spark, folder, sticky):
    """Over a history with erasure and, if that is not sticky, revival, whenever it is compacted."""
    manifest.create(spark, folder, 5)
    log = history(23, n=400)
    for b in range(4):
        first, change = frames(spark, log[b * 100:(b + 1) * 100], 2)
        store.append_writes(state.union_writes(first, change), folder, b)
        if b != 1:
            store.compact(spark, folder, sticky)
        kept = store.report_all(spark, folder, sticky)
        full = report.report_all(store.current(spark, folder, sticky))
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, full.collect()))
        if b != 1:  # all writes are folded: no record is read
            files_ = kept.inputFiles()
            assert files_ and all("log=cells" in f for f in files_)
    assert {r.scope for r in kept.collect()} == {"global", "pillar", "region"}


def test_the_audit_log_is_read_by_month(spark, folder):
    registry = Registry(spark, folder)
    days = [dt.datetime(2025, m, d, 10) for m in (1, 2, 3) for d in (1, 20)]

    def events(shift):
        rows = [(k, f"REG-{k}", "A B", "12345678", "a@b.example", "0711222333", "Tech", "Nyanza",
                 "Consented", at + dt.timedelta(days=shift)) for k, at in enumerate(days)]
        return spark.createDataFrame(
            rows, "event_seq bigint, beneficiary_id string, full_name string, national_id string, "
            "email string, phone string, pillar string, region string, consent_status string, "
            "arrived_at timestamp_ntz").selectExpr(
            "*", "'SMS OTP' as consent_type", "'' as consent_date", "'Active' as status")

    registry.ingest(events(0), 0)
    some = registry.audit_log(since="2025-02-10 00:00:00", until="2025-03-02 00:00:00")
    assert [r.timestamp for r in some.collect()] == [days[4], days[3]]
    assert "PartitionFilters: [isnotnull(dt" in some._jdf.queryExecution().toString()
    assert len(glob.glob(f"{folder}/data/*/log=audit/batch_id=0/dt=*")) == 3
    registry.ingest(events(1), 0)  # the same batch again, a day later everywhere
    assert [r.timestamp for r in registry.audit_log().collect()] == [
        d + dt.timedelta(days=1) for d in reversed(days)]


def test_a_batch_is_read_once(spark, sf_dir, folder):
    i = Inputs(spark, sf_dir)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    counted = i.events.mapInArrow(count, i.events.schema)
    ingest.store_batch(counted, 0, folder)
    assert read.value == i.events.count()
    logged = ingest.accepted(spark, folder).count() + ingest.quarantined(spark, folder).count()
    assert logged == read.value and ingest.audited(spark, folder).count() == (
        ingest.accepted(spark, folder).count())


def test_rows_of_one_write_go_to_their_logs(spark, sf_dir):
    routed = Inputs(spark, sf_dir).routed
    rows = ingest.outcomes(routed, 7)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    counts = {r.log: r["count"] for r in rows.groupBy("log").count().collect()}
    assert counts["writes"] == counts["audit"]
    assert rows.filter(F.col("log") == "writes").filter("bucket IS NULL OR dt IS NOT NULL").isEmpty()
