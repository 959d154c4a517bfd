"""Governed reads: expected answers written out, on a small registry."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F
from test_state import frames, history

from consentry.functions import masks
from consentry.operators import access, state
from consentry.sources.store import REGISTRY_SCHEMA
from consentry.spec import ALL, KEY, PII, REDACTED, REGISTRY_COLUMNS

REQUEST = ("request_id bigint, ts timestamp_ntz, operator string, role string, "
           "region_scope string, pillar_scope string, region string, pillar string, "
           "purpose string, force_anonymize boolean")
AT = dt.datetime(2024, 1, 1, 2)


@pytest.fixture(scope="module")
def registry(spark):
    ingest, change = frames(spark, history(21, n=400, ids=30), 2)
    return state.apply_changes(ingest, change).persist()


@pytest.fixture(scope="module")
def requests(spark):
    roles = {"hq_admin": (ALL, ALL), "pillar_coord": (ALL, "Tech"),
             "field_officer": ("Nyanza", ALL), "compliance_auditor": (ALL, ALL),
             "beneficiary": (ALL, ALL), "stranger": (ALL, ALL)}
    asked = itertools.product(
        roles, ["Nyanza", "Coastal", ALL], ["Tech", "Plus", ALL],
        [ALL, "data_sharing", "photo_use", "nonsense"], [True, False])
    rows = [(n, AT, f"op_{role}", role, *roles[role], region, pillar, purpose, force)
            for n, (role, region, pillar, purpose, force) in enumerate(asked)]
    return spark.createDataFrame(rows, REQUEST)


#: Five records: id, region, pillar, sharing, photo, status; and how each looks when masked.
PEOPLE = {
    "P1": ("Nyanza", "Tech", 1, 0, "Active"),
    "P2": ("Nyanza", "Plus", 1, 1, "Active"),
    "P3": ("Coastal", "Tech", 0, 1, "Active"),
    "P4": ("Coastal", "Plus", 0, 0, "Active"),
    "P5": ("Nyanza", "Tech", 0, 0, "Anonymized"),
}
PLAIN = ("Wanja Maina Otieno", "55512345", "wanja@post.example", "+254700111222")
HIDDEN = ("W. Mai***", "*****345", "wa***@post.example", "+254 *** *** 22")
GONE = (REDACTED,) * 4
#: Operator, what is asked for, whether it is forced or anomalous; ids seen, and whether masked.
ANSWERS = [
    ("hq_admin", ALL, ALL, ALL, False, 0, "P1 P2 P3 P4 P5", False),
    ("hq_admin", "Nyanza", ALL, ALL, False, 0, "P1 P2 P5", False),
    ("hq_admin", "Nyanza", "Plus", ALL, False, 0, "P2", False),
    ("hq_admin", ALL, ALL, "data_sharing", False, 0, "P1 P2", False),
    ("hq_admin", "Coastal", ALL, "photo_use", False, 0, "P3", False),
    ("hq_admin", ALL, "Tech", ALL, True, 0, "P1 P3 P5", True),
    ("hq_admin", ALL, "Tech", ALL, False, 1, "P1 P3 P5", True),
    ("hq_admin", "Western", ALL, ALL, False, 0, "", False),
    ("hq_admin", ALL, ALL, "nonsense", False, 0, "", None),
    ("pillar_coord", ALL, ALL, ALL, False, 0, "P1 P3 P5", False),
    ("pillar_coord", "Nyanza", "Plus", ALL, False, 0, "P1 P5", False),
    ("field_officer", "Coastal", ALL, ALL, False, 0, "P1 P2 P5", False),
    ("field_officer", ALL, "Plus", "photo_use", False, 0, "P2", False),
    ("compliance_auditor", "Coastal", ALL, ALL, False, 0, "P3 P4", True),
    ("beneficiary", ALL, ALL, "data_sharing", False, 0, "P1 P2", True),
    ("stranger", ALL, ALL, ALL, False, 0, "", None),
]


def test_directory_per_request(spark):
    values = dict.fromkeys(REGISTRY_COLUMNS)
    rows = []
    for who, (region, pillar, sharing, photo, status) in PEOPLE.items():
        private = GONE if status == "Anonymized" else PLAIN
        row = values | dict(zip(PII, private)) | {
            KEY: who, "region": region, "pillar": pillar, "status": status,
            "consent_data_sharing": sharing, "consent_photo_use": photo,
            "consent_sms_contact": 0, "consent_external_reporting": 0}
        rows.append((*[row[c] for c in REGISTRY_COLUMNS], (0, len(rows))))
    people = spark.createDataFrame(rows, REGISTRY_SCHEMA)
    scope = {"pillar_coord": (ALL, "Tech"), "field_officer": ("Nyanza", ALL)}
    asked = spark.createDataFrame(
        [(n, AT, f"op_{a[0]}", a[0], *scope.get(a[0], (ALL, ALL)), *a[1:5])
         for n, a in enumerate(ANSWERS)], REQUEST)
    odd = [n for n, a in enumerate(ANSWERS) if a[5]]
    scoped = access.row_policy(access.policy_join(asked, access.policy_of(asked)))
    volumes = access.request_volume(scoped, people)
    decided = access.mask_decision(access.access_features(volumes).withColumn(
        "is_anomaly", F.col("request_id").isin(odd).cast("int")))
    got = {}
    for r in access.request_rows(decided, access.directory(decided, people)).collect():
        got.setdefault(r.request_id, {})[r[KEY]] = tuple(r[c] for c in PII)
    counts = {r.request_id: r.query_volume for r in volumes.collect()}
    for n, (*_, ids, masked) in enumerate(ANSWERS):
        want = {k: GONE if PEOPLE[k][4] == "Anonymized" else HIDDEN if masked else PLAIN
                for k in ids.split()}
        assert got.get(n, {}) == want, ANSWERS[n]
        assert counts[n] == len(want), ANSWERS[n]


def test_scope_comes_from_the_policy_not_from_the_request(spark, requests):
    policy = spark.createDataFrame(
        [("op_field_officer", "field_officer", "Coastal", ALL)],
        "operator string, role string, region_scope string, pillar_scope string")
    rows = access.row_policy(access.policy_join(requests, policy)).collect()
    officer = [r for r in rows if r.operator == "op_field_officer"]
    assert officer and all(r.region_filter == "Coastal" for r in officer)
    assert not any(r.allowed for r in rows if r.operator != "op_field_officer")


def test_omitted_filters_mean_all_and_unknown_purpose_is_refused(spark, registry):
    df = spark.createDataFrame(
        [(1, AT, "a", "hq_admin", ALL, ALL, None, None, None, False)], REQUEST)
    row = access.row_policy(access.policy_join(df, access.policy_of(df))).first()
    assert row.allowed and row.region_filter == ALL == row.purpose
    with pytest.raises(ValueError):
        access.directory_filter(registry, purpose="x = 1 OR consent_photo_use")
    assert access.directory_filter(registry, region="Nyanza", purpose="photo_use").count() == (
        registry.filter("region = 'Nyanza' AND consent_photo_use = 1").count())


def test_features(spark, registry, requests):
    scoped = access.row_policy(access.policy_join(requests, access.policy_of(requests)))
    for r in access.access_features(access.request_volume(scoped, registry)).collect():
        code = {"hq_admin": 0, "pillar_coord": 1, "field_officer": 1, "compliance_auditor": 2,
                "beneficiary": 2}.get(r.role, 3)
        odd = (r.role == "field_officer" and r.region != r.region_scope) or (
            r.role == "pillar_coord" and r.pillar != r.pillar_scope)
        assert (r.hour_of_day, r.role_code, r.region_mismatch) == (2, code, int(odd))


def test_alert_text(spark, registry, requests):
    one = requests.filter("role = 'hq_admin' AND region = 'Nyanza' AND purpose = 'All' "
                          "AND pillar = 'All' AND NOT force_anonymize")
    scoped = access.row_policy(access.policy_join(one, access.policy_of(requests)))
    n = registry.filter("region = 'Nyanza'").count()
    volumes = access.access_features(access.request_volume(scoped, registry))
    for flag, masked in ((0, "False"), (1, "True")):
        row = access.access_audit(
            access.mask_decision(volumes.withColumn("is_anomaly", F.lit(flag)))).first()
        plain = (f"Query Directory (Region: Nyanza, Pillar: All, Purpose: All). Returned {n} "
                 f"records. Anonymization applied: {masked}.")
        assert row.is_anomaly == flag
        assert row.details == (plain if not flag else "[SECURITY ALERT] " + plain
                               + " Access flagged as ANOMALOUS by Machine Learning.")


def test_consent_gate_hides_personal_data(spark, registry):
    ids = [r[KEY] for r in registry.select(KEY).collect()]
    linked = spark.createDataFrame([(n, k) for n, k in enumerate(ids)], f"msg_id bigint, {KEY} string")
    rows = access.consent_gate(linked, registry).collect()
    assert {r.disclosed for r in rows} == {True, False}
    for r in rows:
        assert r.disclosed == (r.consent_status == "Consented")
        assert r.disclosed or (r.full_name, r.email, r.phone) == (None, None, None)


def test_masks_cover_all_personal_columns():
    assert set(masks.MASKS) == set(PII)
