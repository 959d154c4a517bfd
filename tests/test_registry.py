"""The stored registry end to end."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from consentry.models import intent
from consentry.operators import access
from consentry.plans.inputs import Inputs
from consentry.registry import Registry, slot
from consentry.sources import files
from consentry.spec import EVENT_COLUMNS, KEY, PII, REDACTED, REGISTRY_COLUMNS

CHANGE = ("seq bigint, beneficiary_id string, op string, new_status string, consent_type string, "
          "f_sharing int, f_photo int, f_sms int, f_report int, as_of timestamp_ntz")


@pytest.fixture(scope="module")
def loaded(spark, sf_dir, tmp_path_factory):
    i = Inputs(spark, sf_dir)
    accounts = spark.createDataFrame(
        [("lake_desk", "field_officer", "Nyanza", "All"),
         ("outside_check", "compliance_auditor", "All", "All")], access.POLICY_SCHEMA)
    registry = Registry(
        spark, str(tmp_path_factory.mktemp("registry")), accounts,
        intents=intent.default_model(spark))
    registry.ingest(i.events, 0)
    return registry, i


def record(registry, who):
    return registry.current().filter(F.col(KEY) == who).first()


def test_life_of_a_record(spark, loaded):
    import datetime as dt

    registry, i = loaded
    assert registry.current().count() == i.registry.count()
    at = dt.datetime(2025, 1, 1)
    who = i.registry.filter("consent_status = 'Consented'").orderBy(KEY).first()[KEY]

    def change(batch, *rows):
        df = spark.createDataFrame(
            [(n, *row, at) for n, row in enumerate(rows)], CHANGE)
        return registry.change(df, batch).collect()

    lost = change(1, (who, "consent_self_update", None, None, 0, 1, 0, 0),
                  ("REG-nobody", "consent_update", "Consented", None, 0, 0, 0, 0))
    assert [(r[KEY], r.reported) for r in lost] == [("REG-nobody", True)]
    row = record(registry, who)
    assert (row.consent_status, row.enrollment_status, row.consent_photo_use) == (
        "Withdrawn", "On Hold", 1)

    registry.compact()
    assert change(2, (who, "consent_update", "Consented", None, 0, 0, 0, 0)) == []
    row = record(registry, who)
    assert (row.enrollment_status, row.consent_type) == ("Enrolled", "Digital Signature")
    texts = registry.audit_log().filter(
        F.col("target_beneficiary_id") == who).filter("action_type = 'CONSENT_CHANGE'").collect()
    assert texts[0].details == (
        f"Changed consent status for {who} from Withdrawn to Consented via Digital Signature.")
    assert texts[0].timestamp == at and texts[1].operator == who

    assert change(3, (who, "erase_subject", None, None, 0, 0, 0, 0)) == []
    row = record(registry, who)
    assert [row[c] for c in PII] == [REDACTED] * 4 and row.status == "Anonymized"
    registry.compact()
    change(4, (who, "consent_update", "Consented", None, 0, 0, 0, 0))
    assert record(registry, who).consent_status == "Withdrawn"
    assert registry.audit_log(1).first().action_type == "ANONYMIZATION"


def test_reads_are_scoped_masked_and_logged(loaded):
    registry, _ = loaded
    at = "2025-01-01 12:00:00"
    field = registry.read("lake_desk", at, 10, region="Coastal")
    assert {r.region for r in field.rows.collect()} == {"Nyanza"} and not field.masked
    assert field.query_volume == field.rows.count()
    auditor = registry.read("outside_check", at, 11, pillar="Tech")
    assert auditor.masked and all("***" in r.phone or r.phone == REDACTED
                                  for r in auditor.rows.collect())
    refused = registry.read("nobody", at, 12)
    assert not refused.allowed and refused.rows.count() == 0
    person = registry.current().filter("status = 'Active'").first()[KEY]
    assert registry.read(person, at, 13, region="Nyanza").masked
    log = registry.audit_log(4).collect()
    assert [r.operator for r in log] == [person, "nobody", "outside_check", "lake_desk"]
    assert all(r.action_type == "PII_ACCESS" for r in log)


def test_messages_change_the_registry(spark, loaded):
    registry, _ = loaded
    who = registry.current().filter("consent_status = 'Consented'").orderBy(KEY).first()[KEY]
    df = spark.createDataFrame(
        [(1, f"withdraw consent for {who}"), (2, "generate report")], "msg_id bigint, text string")
    done = registry.messages(df, "2025-02-01 00:00:00", 20)
    assert {r.action for r in done.actions.collect()} == {"CONSENT_CHANGE", "REPORT"}
    row = record(registry, who)
    assert (row.consent_status, row.consent_type) == ("Withdrawn", "Chatbot OTP")
    kinds = registry.audit_log().filter(F.col("batch_id") >= slot(20))
    assert sorted(r.action_type for r in kinds.collect()) == ["COMPLIANCE_REPORT", "CONSENT_CHANGE"]


def test_a_stream_and_changes_share_batch_numbers(spark, sf_dir, folder):
    import datetime as dt

    i = Inputs(spark, sf_dir)
    registry = Registry(spark, folder + "/reg")
    i.events.coalesce(1).write.parquet(folder + "/in")
    stream = spark.readStream.schema(i.events.schema).parquet(folder + "/in")
    registry.ingest_stream(stream).awaitTermination()
    who = i.registry.first()[KEY]
    df = spark.createDataFrame(
        [(0, who, "erase_subject", None, None, 0, 0, 0, 0, dt.datetime(2025, 1, 1))], CHANGE)
    for _ in range(2):
        assert registry.change(df, 0).count() == 0
    assert registry.current().count() == i.registry.count()
    assert record(registry, who).status == "Anonymized"
    assert registry.audit_log().filter("action_type = 'ANONYMIZATION'").count() == 1


def test_export_and_views(spark, loaded, folder):
    registry, i = loaded
    registry.export(folder + "/out")
    rows = files.read_registry_csv(spark, folder + "/out").collect()
    assert len(rows) == registry.current().filter("status = 'Active'").count()
    assert all(r.national_id.startswith("*****") for r in rows)
    assert registry.quarantine().count() == i.routed.filter("ingest_status <> 'SUCCESS'").count()
    newest = [r.event_id for r in registry.quarantine(5).collect()]
    assert newest == sorted(newest, reverse=True) and len(newest) == 5
    total = registry.reports().filter("scope = 'global'").first().total
    assert total == registry.current().count()


def test_large_batch_and_sequence_numbers(spark, folder):
    """Orders are kept as they are, not packed into one number."""
    import datetime as dt

    registry = Registry(spark, folder)
    event = ("REG-1", "A B", "12345678", "a@b.example", "0711222333", "Tech", "Nyanza",
             "Consented", "SMS OTP", "2025-01-01 00:00:00", "Active")
    names = ", ".join(f"{c} string" for c in EVENT_COLUMNS)
    for batch, seq, status in ((10_000_000, 1 << 41, "Pending"), (9_999_999, 1 << 42, "Consented")):
        row = [(*event[:7], status, *event[8:], seq, dt.datetime(2025, 1, 1))]
        registry.ingest(spark.createDataFrame(
            row, names + ", event_seq bigint, arrived_at timestamp_ntz"), batch)
    assert record(registry, "REG-1").consent_status == "Pending"
    change = [(1 << 41, "REG-1", "consent_update", "Withdrawn", None, 0, 0, 0, 0,
               dt.datetime(2025, 1, 2))]
    assert registry.change(spark.createDataFrame(change, CHANGE), 10_000_000).collect() == []
    assert record(registry, "REG-1").consent_status == "Withdrawn"
    last = registry.audit_log(1).first()
    assert last.seq == 1 << 41 and " from Pending to Withdrawn " in last.details
    assert last.operator == "system"


def test_who_asked_is_logged(spark, folder):
    import datetime as dt

    registry = Registry(spark, folder, intents=intent.default_model(spark))
    lines = [json.dumps({"beneficiary_id": f"REG-{k}", "full_name": f"Wanja{k} Maina",
                         "national_id": f"5551234{k}", "email": f"w{k}@post.example",
                         "phone": f"071122233{k}", "pillar": "Tech", "region": "Nyanza",
                         "consent_status": "Consented"}) for k in range(4)]
    registry.ingest(files.parse_events(spark.createDataFrame([(x,) for x in lines], "value string")), 0)
    at = dt.datetime(2025, 1, 1)
    rows = [(0, "REG-0", "consent_update", "Pending", None, 0, 0, 0, 0, at, "desk_7"),
            (1, "REG-1", "erase_subject", None, None, 0, 0, 0, 0, at, "desk_8"),
            (2, "REG-2", "erase_subject", None, None, 0, 0, 0, 0, at, None)]
    registry.change(spark.createDataFrame(rows, CHANGE + ", operator string"), 1)
    registry.messages(spark.createDataFrame(
        [(5, "delete my record for REG-3")], "msg_id bigint, text string"), "2025-01-02 00:00:00", 2)
    log = {r.target_beneficiary_id: (r.operator, r.details) for r in registry.audit_log().filter(
        "action_type <> 'BENEFICIARY_INGEST'").collect()}
    executed = "Executed Right to be Forgotten (KDPA redaction) for beneficiary profile {}."
    assert log == {
        "REG-0": ("desk_7", "Changed consent status for REG-0 from Consented to Pending via "
                            "Digital Signature."),
        "REG-1": ("desk_8", executed.format("REG-1")),
        "REG-2": ("system", executed.format("REG-2")),
        "REG-3": ("chatbot_interface",
                  "Right to be Forgotten request executed via AI Chatbot self-service."),
    }


def test_payloads_are_quarantined_as_they_came(spark, folder):
    registry = Registry(spark, folder)
    lines = ['{"beneficiary_id": "REG-1",  "channel": "kiosk", "email": "x"}', '{"beneficiary_id": "R']
    registry.ingest(files.parse_events(spark.createDataFrame([(x,) for x in lines], "value string")), 0)
    assert {r.raw_payload for r in registry.quarantine().collect()} == set(lines)


def test_an_erased_person_is_in_no_file(spark, folder, monkeypatch):
    """Also not in quarantine, nor in what calls have staged."""
    import datetime as dt
    import glob

    import pyarrow.parquet as pq

    from consentry.sources import staging

    staged = folder + "/staged"
    monkeypatch.setattr(staging, "shared_dir", lambda spark: f"{staged}/{uuid.uuid4().hex}")
    root = folder + "/registry"
    accounts = spark.createDataFrame([("desk", "hq_admin", "All", "All")], access.POLICY_SCHEMA)
    registry = Registry(spark, root, accounts, intents=intent.default_model(spark))
    good = {"beneficiary_id": "REG-1", "full_name": "Zawadi Unique", "national_id": "77123456",
            "email": "zawadi.unique@post.example", "phone": "0711999888", "pillar": "Tech",
            "region": "Nyanza", "consent_status": "Consented"}
    other = good | {"beneficiary_id": "REG-2", "full_name": "Baraka Stays", "email": "b@post.example",
                    "national_id": "88123456"}
    lines = [json.dumps(r) for r in (good, other, good | {"pillar": "Nowhere"})]
    registry.ingest(files.parse_events(spark.createDataFrame([(x,) for x in lines], "value string")), 0)
    at = dt.datetime(2025, 1, 1)
    registry.change(spark.createDataFrame(
        [(0, "REG-1", "consent_update", "Pending", None, 0, 0, 0, 0, at)], CHANGE), 1)
    registry.messages(spark.createDataFrame(
        [(1, "show my profile details REG-1")], "msg_id bigint, text string"), "2025-01-01 00:00:00", 2)
    assert registry.read("desk", "2025-01-01 10:00:00", 3).rows.count() == 2

    def found(text):
        files_ = glob.glob(f"{folder}/**/*.parquet", recursive=True)
        return sum(text in str(pq.ParquetFile(f).read().to_pylist()) for f in files_)

    assert found("zawadi.unique") > 3
    registry.change(spark.createDataFrame(
        [(0, "REG-1", "erase_subject", None, None, 0, 0, 0, 0, at)], CHANGE), 4)
    registry.compact()
    assert not found("zawadi.unique") and not found("Zawadi") and not found("77123456")
    assert found("Baraka Stays") == 1
    assert registry.quarantine().count() == 1


def test_an_erased_record_can_come_back_if_asked_for(spark, folder):
    import datetime as dt

    at = dt.datetime(2025, 1, 1)
    row = {"beneficiary_id": "REG-1", "full_name": "A B", "national_id": "1", "email": "a@b.example",
           "phone": "0711999888", "pillar": "Tech", "region": "Nyanza", "consent_status": "Consented"}
    lines = spark.createDataFrame([(json.dumps(row),)], "value string")
    for sticky, status in ((True, "Anonymized"), (False, "Active")):
        registry = Registry(spark, f"{folder}/{sticky}", sticky_erasure=sticky)
        registry.ingest(files.parse_events(lines), 0)
        registry.change(spark.createDataFrame(
            [(0, "REG-1", "erase_subject", None, None, 0, 0, 0, 0, at)], CHANGE), 1)
        registry.ingest(files.parse_events(lines), 2)
        assert record(registry, "REG-1").status == status


def test_file_order_decides_between_equal_names(spark, folder):
    import csv

    with open(folder + "/in.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(REGISTRY_COLUMNS)
        for who in ("Z9", "A1", "Z9"):
            values = {"beneficiary_id": who, "full_name": "Joseph\nKariuki", "national_id": "12345678",
                      "email": f"{who}@post.example", "phone": "+254711222333", "pillar": "Tech",
                      "region": "Nyanza", "consent_status": "Consented", "status": "Active",
                      "consent_type": "SMS OTP", "enrollment_status": "Enrolled"}
            out.writerow([values.get(c, "1") if c != "consent_date" else "" for c in REGISTRY_COLUMNS])
    registry = Registry(spark, folder + "/reg", intents=intent.default_model(spark))
    registry.load_csv(folder + "/in.csv", folder + "/clean")
    assert registry.current().count() == 2
    done = registry.messages(spark.createDataFrame(
        [(1, "show profile for joseph")], "msg_id bigint, text string"), "2025-01-01 00:00:00", 0)
    assert done.actions.first()[KEY] == "Z9"
