"""The fold against a one-at-a-time simulation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consentry.operators import state
from consentry.spec import FLAGS, KEY, PII, REDACTED, REGISTRY_COLUMNS
from consentry.sources import store

NUMBERED = T.StructType(
    [*store.REGISTRY_SCHEMA.fields[:-1], T.StructField("row_order", T.LongType())])
T0 = dt.datetime(2024, 1, 1)
CHANGE = ("seq bigint, beneficiary_id string, op string, new_status string, consent_type string, "
          "f_sharing int, f_photo int, f_sms int, f_report int, as_of timestamp_ntz")


def history(seed, n=1200, ids=40):
    """Random ingests and changes in arrival order."""
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        who = f"P{rng.randrange(ids) if rng.random() < .7 else 0}"
        at = T0 + dt.timedelta(minutes=seq)
        if rng.random() < .35:
            status = rng.choice(["Consented", "Pending", "Withdrawn"])
            row = dict.fromkeys(REGISTRY_COLUMNS)
            row |= {KEY: who, "full_name": f"N{seq}", "national_id": f"I{seq}", "email": f"e{seq}",
                    "phone": f"t{seq}", "pillar": rng.choice(["Tech", "Plus"]), "region": "Nyanza",
                    "consent_status": status, "consent_type": rng.choice([None, "SMS OTP"]),
                    "consent_date": rng.choice([None, at]), "status": "Active",
                    "enrollment_status": "Enrolled"} | {f: rng.randrange(2) for f in FLAGS}
            out.append((seq, "ingest", row))
        else:
            op = rng.choices([state.UPDATE, state.SELF_UPDATE, state.TEXT_UPDATE, state.ERASE,
                              state.HOLD], [4, 4, 2, .6, 1])[0]
            out.append((seq, op, (
                seq, who, op, rng.choice(["Consented", "Pending", "Withdrawn"]),
                rng.choice([None, "Paper"]), rng.choice([0, 1, None]), rng.randrange(2),
                rng.randrange(2), rng.randrange(2), at)))
    return out


def simulate(log, sticky):
    registry, missing, moves, erased = {}, [], [], set()
    for seq, op, row in log:
        if op == "ingest":
            if sticky and row[KEY] in erased:
                continue
            registry[row[KEY]] = dict(row) | {"row_order": seq}
            continue
        _, who, _, status, kind, sharing, photo, sms, report, at = row
        rec = registry.get(who)
        if rec is None:
            missing.append((seq, who, op))
            continue
        if sticky and who in erased:
            continue
        before = rec["consent_status"]
        if op in (state.UPDATE, state.TEXT_UPDATE):
            on = int(status == "Consented")
            rec |= {"consent_status": status, "consent_date": at,
                    "consent_type": "Chatbot OTP" if op == state.TEXT_UPDATE
                    else kind or "Digital Signature",
                    "enrollment_status": "Enrolled" if on else "On Hold"} | dict.fromkeys(FLAGS, on)
        elif op == state.SELF_UPDATE:
            on = (sharing or 0) != 0
            rec |= dict(zip(FLAGS, (sharing or 0, photo, sms, report))) | {
                "consent_status": "Consented" if on else "Withdrawn",
                "enrollment_status": "Enrolled" if on else "On Hold", "consent_date": at}
        elif op == state.HOLD:
            rec["enrollment_status"] = "On Hold"
        else:
            rec |= dict.fromkeys(PII, REDACTED) | dict.fromkeys(FLAGS, 0) | {
                "consent_status": "Withdrawn", "enrollment_status": "On Hold",
                "status": "Anonymized"}
            erased.add(who)
        if op == state.UPDATE:
            moves.append((seq, who, before, status))
    return registry, missing, moves


def frames(spark, log, partitions, seed=0):
    rows = [r for _, op, r in log if op == "ingest"]
    seqs = [s for s, op, _ in log if op == "ingest"]
    ingest = spark.createDataFrame(
        [[r[c] for c in REGISTRY_COLUMNS] + [s] for r, s in zip(rows, seqs)], NUMBERED)
    changes = [r for _, op, r in log if op != "ingest"]
    random.Random(seed).shuffle(changes)
    change = state.change_writes(spark.createDataFrame(changes, CHANGE))
    return (state.ingest_writes(ingest, F.col("row_order")).repartition(partitions),
            change.repartition(partitions, F.rand(seed)))


@pytest.mark.parametrize("sticky", [True, False])
@pytest.mark.parametrize("seed, partitions", [(1, 1), (2, 7)])
def test_fold_equals_simulation(spark, seed, partitions, sticky):
    log = history(seed)
    registry, missing, moves = simulate(log, sticky)
    ingest, change = frames(spark, log, partitions, seed)
    got = {r[KEY]: r.asDict() for r in state.apply_changes(
        ingest, change, sticky_erasure=sticky).collect()}
    assert got == registry
    writes = state.union_writes(ingest, change)
    lost = state.change_not_found(writes, change).collect()
    assert sorted((r.seq, r[KEY], r.op) for r in lost) == missing
    assert all(r.reported == (r.op != state.SELF_UPDATE) for r in lost)
    for block in (1 << 20, 16):
        turned = state.consent_transitions(writes, sticky, block).collect()
        assert sorted((r.seq, r[KEY], r.old_status, r.new_status) for r in turned) == moves


def test_upsert_keeps_nulls_of_the_last_row(spark):
    log = history(5)
    ingest = [(s, r) for s, op, r in log if op == "ingest"]
    df = spark.createDataFrame(
        [[r[c] for c in REGISTRY_COLUMNS] + [s] for s, r in ingest], NUMBERED)
    last = {r[KEY]: r | {"row_order": s} for s, r in ingest}
    got = {r[KEY]: r.asDict() for r in state.registry_upsert(
        df.repartition(5), "row_order").collect()}
    assert got == last


def test_previous_value_equals_lag_for_any_block(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcaaa"), n, rng.choice([None, "x", "y"])) for n in range(300)]
    df = spark.createDataFrame(rows, "k string, n bigint, v string").repartition(5)
    last, want = {}, []
    for k, n, v in rows:
        want.append((k, n, last.get(k)))
        last[k] = v
    for block in (1, 7, 1 << 20):
        got = state.previous_value(df, "k", "n", "v", "p", block).select("k", "n", "p").collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_purge_keeps_rows(spark):
    log = history(9)
    ingest, change = frames(spark, log, 3)
    registry = state.apply_changes(ingest, change)
    erased = {r[KEY] for r in state.erased_keys(registry).collect()}
    purged = state.purge_erased(ingest, state.erased_keys(registry))
    rows = purged.collect()
    assert erased and len(rows) == sum(op == "ingest" for _, op, _ in log)
    assert all((r.full_name is None) == (r[KEY] in erased) for r in rows)


def test_aggregates_of_structs_sort_by_a_hash(spark):
    ingest, change = frames(spark, history(3, n=200), 2)
    df = state.fold(state.union_writes(ingest, change))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate(key=[_groupingexpression" in plan and "_hash" not in df.columns
