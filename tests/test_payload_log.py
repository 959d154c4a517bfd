"""Payload folders: offsets are (file, byte), and every line is read once."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from consentry.sources import files, payload_log
from consentry.streaming import ingest


def append(folder, name, data):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "ab") as f:
        f.write(data)


def drain(spark, folder, got, split=7):
    lines = payload_log.read_payload_log(spark, f"{folder}/in", True, split)
    done = lines.writeStream.foreachBatch(
        lambda df, n: got.append([tuple(r) for r in df.orderBy("event_seq").collect()])
    ).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    done.awaitTermination()


def plain(folder):
    """(file, position, value) of all whole lines, file by file."""
    out = []
    for name in sorted(os.listdir(folder)):
        data, at = open(f"{folder}/{name}", "rb").read(), 0
        for line in data.split(b"\n")[:-1]:
            out.append((name, at, line.decode()))
            at += len(line) + 1
    return out


def test_a_restarted_stream_reads_each_line_once(spark, folder):
    steps = [("b", b'{"a": 1}\n{"a": 2}\n{"a"'), ("b", b': 3}\n'), ("a", "née\n\n".encode()),
             ("c", b"cut"), ("b", b'{"a": 4}\n'), ("_hidden", b"no\n")]
    seen = []
    for name, data in steps:
        append(f"{folder}/in", name, data)
        got = []
        drain(spark, folder, got)
        for batch in got:
            assert [r[2] for r in batch] == sorted({r[2] for r in batch})
            assert [(r[0], r[1]) for r in batch] == sorted((r[0], r[1]) for r in batch)
            seen += [(r[0], r[1], r[3]) for r in batch]
    os.remove(f"{folder}/in/_hidden")
    assert sorted(seen) == plain(f"{folder}/in") and len(seen) == len(set(seen))


@pytest.mark.parametrize("split", [1, 5, 64, 1 << 20])
def test_numbers_do_not_depend_on_the_splits(spark, folder, split):
    r = random.Random(3)
    for name in "xyz":
        for _ in range(40):
            append(f"{folder}/in", name, ("é" * r.randint(0, 9) + "w" * r.randint(0, 30) + "\n").encode())
    found = []
    for part in payload_log.parts({}, payload_log.complete(f"{folder}/in", {}), split):
        for batch in payload_log.read_lines(f"{folder}/in", part):
            found += [tuple(row.values()) for row in batch.to_pylist()]
    want, base = [], {}
    for name, at, value in plain(f"{folder}/in"):
        base.setdefault(name, sum(os.path.getsize(f"{folder}/in/{n}") for n in "xyz" if n < name))
        want.append((name, at, base[name] + at, value))
    assert found == want


def test_long_lines_and_chunks(folder, monkeypatch):
    monkeypatch.setattr(payload_log, "CHUNK", 16)
    lines = ["x" * n for n in (0, 1, 15, 16, 17, 100, 5)]
    append(f"{folder}/in", "f", "\r\n".join(lines).encode())
    end = payload_log.complete(f"{folder}/in", {}, closed=True)
    for split in (10, 1000):
        got = [row["value"] for p in payload_log.parts({}, end, split)
               for b in payload_log.read_lines(f"{folder}/in", p) for row in b.to_pylist()]
        assert got == lines
    assert payload_log.complete(f"{folder}/in", {}) == {"f": os.path.getsize(f"{folder}/in/f") - 5}


def test_an_empty_folder_has_no_lines(spark, folder):
    os.makedirs(f"{folder}/in")
    assert payload_log.read_payload_log(spark, f"{folder}/in").collect() == []


def test_the_last_arrival_wins_by_offset(spark, folder):
    def line(name):
        return json.dumps({
            "beneficiary_id": "REG-1", "full_name": name, "national_id": "12345678",
            "email": "a@b.example", "phone": "0711222333", "pillar": "Tech", "region": "Nyanza",
            "consent_status": "Consented"}).encode() + b"\n"

    for k in range(30):
        append(f"{folder}/in", f"f{k % 3}", line(f"Name {chr(65 + k % 26)}x"))
    append(f"{folder}/in", "f2", line("The Last") + b"broken\n")
    lines = payload_log.read_payload_log(spark, f"{folder}/in", True, 100)
    ingest.start_ingest(files.parse_events(lines), f"{folder}/out").awaitTermination()
    assert [r.full_name for r in ingest.registry(spark, f"{folder}/out").collect()] == ["The Last"]
    lost = ingest.quarantined(spark, f"{folder}/out").collect()
    assert [(r.raw_payload, r.timestamp is not None) for r in lost] == [("broken", True)]


def test_a_batch_that_runs_again_has_the_same_times(spark, folder):
    append(f"{folder}/in", "f", b"broken\n")
    times = []
    lines = payload_log.read_payload_log(spark, f"{folder}/in", True)
    events = ingest.timed(files.parse_events(lines))

    def fail(df, n):
        times.append(df.first().arrived_at)
        if len(times) == 1:
            raise RuntimeError("lost")

    for _ in range(2):
        done = events.writeStream.foreachBatch(fail).option(
            "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        try:
            done.awaitTermination()
        except Exception:
            assert len(times) == 1
    assert len(times) == 2 and times[0] == times[1]


def test_a_table_of_lines_without_times_has_none(spark, folder):
    lines = spark.createDataFrame([("broken",)], "value string")
    ingest.store_batch(files.parse_events(lines), 0, folder)
    assert ingest.quarantined(spark, folder).first().timestamp is None
    ingest.store_batch(files.parse_events(lines), 0, folder, F.lit("2025-01-01 00:00:00"))
    assert str(ingest.quarantined(spark, folder).first().timestamp) == "2025-01-01 00:00:00"
