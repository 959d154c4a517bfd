"""Column expressions against Python's own string methods, and the carried-over cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from consentry.functions import masks, text
from consentry.operators import quality, standardise
from consentry.spec import DEFAULT_SPEC, EVENT_SCHEMA, REDACTED


def apply(spark, expression, values):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string")
    return [r[0] for r in df.orderBy("n").select(expression(F.col("v"))).collect()]


NAMES = [
    "  jane  achieng ", "o'brien  anne-marie", "3rd mcDONALD", "jane achieng", "\tA\nB c",
    "Élan VITAL", "jean-luc d'arc", "x", "", " ", "a1b2 c3", "MARY ann  o neil", "\x1ff\x85 g",
]


def test_title_name_is_pythons(spark):
    got = apply(spark, text.title_name, NAMES)
    assert got == [" ".join(n.split()).title() for n in NAMES]


def test_strip_is_pythons_on_random_text(spark):
    rng = random.Random(7)
    alphabet = list("ab \t\n  　\x1c\x85é'-")
    values = ["".join(rng.choices(alphabet, k=rng.randint(0, 9))) for _ in range(400)]
    assert apply(spark, text.strip, values) == [v.strip() for v in values]
    assert apply(spark, text.squeeze, values) == [" ".join(v.split()) for v in values]
    assert apply(spark, text.blank_to_null, values) == [v if v.strip() else None for v in values]


@pytest.mark.parametrize("raw, expected", [
    ("0711 222 333", "+254711222333"), ("01 12", "+254112"), ("712", "+254712"),
    ("254712", "254712"), ("+254 712", "+254712"), ("1", "+2541"), ("  07 ", "+2547"),
])
def test_phone(spark, raw, expected):
    assert apply(spark, text.phone_e164, [raw]) == [expected]


def test_region_and_pillar(spark):
    regions = apply(spark, lambda c: text.region(c, DEFAULT_SPEC.region_aliases),
                    ["north-eastern", "RIFTVALLEY", "rift  valley", " nyanza "])
    assert regions == ["North Eastern", "Rift Valley", "Rift  Valley", "Nyanza"]
    pillars = apply(spark, lambda c: text.canonical(c, DEFAULT_SPEC.pillars),
                    [" PLUS ", " Corporate ", "tech"])
    assert pillars == ["Plus", " Corporate ", "Tech"]


@pytest.mark.parametrize("mask, raw, expected", [
    ("full_name", "Jane Achieng", "J. Ach***"), ("full_name", "Jane", "Ja***"),
    ("full_name", "A  B C", "A. B C***"), ("full_name", "Jo X", "J. X***"),
    ("full_name", REDACTED, REDACTED), ("full_name", None, None), ("full_name", "", ""),
    ("email", "jane@x.org", "ja***@x.org"), ("email", "a@b@c", "a***@b"),
    ("email", "nope", "no***@"), ("national_id", "12", "*****12"),
    ("national_id", "34567890", "*****890"), ("phone", "+254711222333", "+254 *** *** 33"),
    ("phone", REDACTED, REDACTED),
])
def test_masks(spark, mask, raw, expected):
    assert apply(spark, masks.MASKS[mask], [raw]) == [expected]


GOOD = {
    "beneficiary_id": "REG-1", "full_name": "Wanja Maina", "national_id": "55512345",
    "email": "wanja@post.example", "phone": "+254700111222", "pillar": "Scholarship",
    "region": "Nairobi", "consent_status": "Consented",
}


def event(spark, **changes):
    row = {**GOOD, **changes}
    return spark.createDataFrame([[row.get(f.name) for f in EVENT_SCHEMA]], EVENT_SCHEMA)


def test_cleanse_case(spark):
    row = standardise.standardise_events(event(
        spark, full_name="  jane  achieng ", email="JANE@gmail.com", phone="0711 222 333",
        pillar="scholarship", region="nyanza", status="")).first()
    assert (row.full_name, row.email, row.phone, row.pillar, row.region, row.status) == (
        "Jane Achieng", "jane@gmail.com", "+254711222333", "Scholarship", "Nyanza", "Active")


def test_valid_and_invalid_rows(spark):
    ok = quality.gate_rows(standardise.standardise_events(event(spark))).first()
    assert ok.is_valid and ok.failure_reasons == []
    bad = quality.gate_rows(standardise.standardise_events(event(
        spark, email="invalid_email_no_at", pillar="Corporate", region="Kampala"))).first()
    assert not bad.is_valid
    assert bad.failure_reasons == [
        "Validation failed on column 'pillar' for check 'expect_column_values_to_be_in_set'",
        "Validation failed on column 'region' for check 'expect_column_values_to_be_in_set'",
        "Validation failed on column 'email' for check 'expect_column_values_to_match_regex'",
    ]


@pytest.mark.parametrize("change, status", [
    ({}, "SUCCESS"), ({"full_name": ""}, "QUARANTINED"), ({"beneficiary_id": " "}, "QUARANTINED"),
    ({"national_id": None}, "ERROR"), ({"email": None}, "ERROR"), ({"region": None}, "ERROR"),
    ({"consent_status": ""}, "ERROR"), ({"consent_type": None}, "SUCCESS"),
    ({"email": "a@b@c.d"}, "QUARANTINED"),
])
def test_routing(spark, change, status):
    routed = quality.route_ingest(standardise.standardise_events(event(spark, **change)))
    assert routed.first().ingest_status == status


def test_strict_rules_reject_nulls_but_not_a_missing_email(spark):
    rules = DEFAULT_SPEC.strict_rules
    row = quality.gate_rows(standardise.standardise_events(
        event(spark, pillar=None, email=None)), rules).first()
    assert row.failure_reasons == ["pillar must be Scholarship, Plus, Vocational, or Tech"]


def test_consent_pending_on_ingest_and_on_update(spark):
    from consentry.functions import consent

    df = spark.createDataFrame([("Pending",), ("Consented",), ("Other",)], "s string")
    rows = df.select(consent.enrollment_on_ingest(F.col("s")),
                     consent.enrollment_on_update(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [
        ("Pending Review", "On Hold"), ("Enrolled", "Enrolled"), ("On Hold", "On Hold")]


def test_email_pattern_is_pythons(spark):
    values = ["a@b.c", "a@b", "@b.c", "a@@b.c", "a b@c.d", "a@b.c.d", "a@.b", "a@b."]
    pattern = DEFAULT_SPEC.row_rules[-1].pattern
    got = apply(spark, lambda c: c.rlike(pattern), values)
    assert got == [bool(re.match(pattern, v)) for v in values]


def test_title_of_random_text_is_pythons(spark):
    rng = random.Random(11)
    printable = [chr(n) for n in range(32, 127)] + list("abAB  '-")
    values = ["".join(rng.choices(printable, k=rng.randint(0, 12))) for _ in range(3000)]
    values += ["".join(rng.choices("aB \t\x01'é,", k=rng.randint(0, 8))) for _ in range(500)]
    assert apply(spark, text.title, values) == [v.title() for v in values]


def test_gates_are_compiled(spark):
    rows = spark.createDataFrame([], EVENT_SCHEMA)
    plan = quality.gate_rows(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan
    # Generated methods beyond this size would stay interpreted.
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
