"""The batch path: scan, clean, gate, sinks."""

import os

import pytest
from pyspark.sql import functions as F

from consentry.operators import quality, standardise
from consentry.plans import batch
from consentry.sources import files, store
from consentry.spec import BATCH_RULES, REGISTRY_COLUMNS


def line(n, **changes):
    row = {
        "beneficiary_id": f"REG-{n}", "full_name": "  jane  achieng ", "national_id": f"0{n}",
        "email": "j@x.org", "phone": "0711 222 333", "pillar": "Tech", "region": "Nyanza",
        "consent_status": "Consented", "consent_type": "None", "consent_date": "",
        "status": "Active", "enrollment_status": "Enrolled", "consent_data_sharing": "1",
        "consent_photo_use": "0", "consent_sms_contact": "1", "consent_external_reporting": "0",
    } | changes
    return ",".join(row[c] for c in REGISTRY_COLUMNS)


def write(folder, *lines):
    path = os.path.join(folder, "raw.csv")
    with open(path, "w") as f:
        f.write("\n".join([",".join(REGISTRY_COLUMNS), *lines]) + "\n")
    return path


def test_missing_file(spark, folder):
    with pytest.raises(FileNotFoundError):
        files.read_registry_csv(spark, folder + "/none.csv")


def test_batch_loads_and_replaces(spark, folder):
    raw = write(folder, line(1), line(1), line(2, national_id="007"))
    version = batch.run(spark, raw, folder + "/clean", folder + "/reg")
    rows = {r.beneficiary_id: r for r in store.snapshot(spark, folder + "/reg").collect()}
    assert version == 0 and len(rows) == 2
    assert rows["REG-2"].national_id == "007" and rows["REG-1"].phone == "+254711222333"
    assert rows["REG-1"].full_name == "Jane Achieng" == rows["REG-1"].full_name.title()
    assert rows["REG-1"].consent_type is None and rows["REG-1"].consent_photo_use == 0
    assert files.read_registry_csv(spark, folder + "/clean").count() == 2
    raw = write(folder, line(9))
    assert batch.run(spark, raw, folder + "/clean", folder + "/reg") == 1
    assert [r.beneficiary_id for r in store.snapshot(spark, folder + "/reg").collect()] == ["REG-9"]


def test_rejected_batch_writes_nothing(spark, folder):
    # Copies that differ in blanks survive the dedupe and break uniqueness.
    raw = write(folder, line(1), line(1, full_name="jane achieng"), line(2, region="Kampala"))
    with pytest.raises(quality.QualityGateError) as e:
        batch.run(spark, raw, folder + "/clean", folder + "/reg")
    assert {(f["rule"], f["column_name"]): f["unexpected"] for f in e.value.failures} == {
        ("expect_column_values_to_be_unique", "beneficiary_id"): 2,
        ("expect_column_values_to_be_in_set", "region"): 1,
    }
    assert not os.path.exists(folder + "/clean") and not os.path.exists(folder + "/reg")


def test_report_counts_every_member_of_a_duplicate_group_and_no_null(spark):
    df = spark.createDataFrame(
        [(k, "n", "Tech", "Nyanza", "Consented", "a@b.c") for k in ["a", "a", "a", "b", None, None]],
        "beneficiary_id string, full_name string, pillar string, region string, "
        "consent_status string, email string")
    got = {(r.rule, r.column_name): r.unexpected for r in quality.gate_report(df, BATCH_RULES).collect()}
    assert got[("expect_column_values_to_be_unique", "beneficiary_id")] == 3
    assert got[("expect_column_values_to_not_be_null", "beneficiary_id")] == 2
    assert quality.duplicated_rows(df).count() == 3


def test_nulls_stay_null_in_a_batch(spark):
    df = spark.createDataFrame([(None, " x ", None)], "full_name string, email string, phone string")
    row = standardise.clean_batch(df).first()
    assert (row.full_name, row.email, row.phone) == (None, "x", None)


def test_empty_report(spark):
    df = spark.createDataFrame([], "beneficiary_id string, full_name string, pillar string, "
                                   "region string, consent_status string, email string")
    rows = quality.gate_report(df).filter(~F.col("passed")).collect()
    assert rows == []
