"""Split reading of quoted CSV gives the rows of Spark's one-task reader."""

import csv
import io
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from consentry.sources import csv_ranges, files

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b", "c")])
SPLIT = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}


@pytest.fixture
def split(spark):
    """Sets how many bytes a range has."""
    names = [*SPLIT, "spark.sql.files.maxPartitionBytes"]
    old = {n: spark.conf.get(n, None) for n in names}

    def into(size):
        for n, v in {**SPLIT, names[-1]: str(size)}.items():
            spark.conf.set(n, v)

    yield into
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def write(folder, name, content):
    with open(os.path.join(folder, name), "w", newline="", encoding="utf-8") as f:
        f.write(content)


def csv_text(rows, end="\n", quoting=csv.QUOTE_MINIMAL, head=True):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end, quoting=quoting)
    if head:
        w.writerow(SCHEMA.names)
    w.writerows(rows)
    return out.getvalue()


def by_one_task(spark, path):
    return spark.read.schema(SCHEMA).options(
        **files._CSV, multiLine="true", enforceSchema="false").csv(path)


def both(spark, path):
    got = files.read_registry_csv(spark, path, SCHEMA, number="at").orderBy("at").drop("at").collect()
    want = by_one_task(spark, path).collect()
    return [tuple(r) for r in got], [tuple(r) for r in want]


def random_rows(seed, n=60):
    r = random.Random(seed)
    parts = ["x", " ", ",", '"', '""', "\n", "\n\n", "é", "word", ",\n", '"\n', "0", "+1", "'"]
    return [["".join(r.choices(parts, k=r.randint(0, 9))) for _ in range(3)] for _ in range(n)]


@pytest.mark.parametrize("size", [33, 150, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_the_one_task_reader(spark, folder, split, size, end):
    quoting = csv.QUOTE_ALL if size % 2 else csv.QUOTE_MINIMAL
    write(folder, "one.csv", csv_text(random_rows(size), end, quoting))
    split(size)
    got, want = both(spark, folder)
    assert got == want and len(got) > 50


def test_many_files_and_their_order(spark, folder, split):
    for k in range(5):
        write(folder, f"part-{k}.csv", csv_text(random_rows(k, 20 * k), "\r\n" if k == 3 else "\n"))
    split(90)
    got = files.read_registry_csv(spark, folder, SCHEMA, number="at").orderBy("at").collect()
    want = []
    for k in range(5):
        want += map(tuple, by_one_task(spark, f"{folder}/part-{k}.csv").collect())
    assert [tuple(r[:3]) for r in got] == want
    assert len({r["at"] for r in got}) == len(got)


def test_stray_quotes_ragged_rows_and_blank_lines(spark, folder, split):
    write(folder, "f.csv", "\n".join([
        "a,b,c", 'five 5" pipe,x,y', '', '"q"tail,2,3', '1', '1,2,3,4', '"in\nside","a ""b"" c",',
        ' "space",b,c', '"","",""', ',,', '"last', 'open",z,"w"', 'é,"ü\n\nö",ß', ""]))
    split(20)
    got, want = both(spark, folder)
    assert got == want


def test_a_value_longer_than_many_ranges(spark, folder, split):
    long = "line, of text\n" * 400
    write(folder, "f.csv", csv_text([["1", long, "x"], ["2", "y", long], ["3", "", "z"]]))
    split(100)
    got, want = both(spark, folder)
    assert got == want and got[0][1] == long


def test_it_takes_more_than_one_task(spark, folder, split):
    write(folder, "f.csv", csv_text(random_rows(1, 400), quoting=csv.QUOTE_ALL))
    split(256)
    rows = files.read_registry_csv(spark, folder, SCHEMA)
    assert csv_ranges._lines(spark, folder).rdd.getNumPartitions() > 8
    assert rows.count() == 400


def test_byte_order_mark_and_header_in_any_case(spark, folder):
    write(folder, "f.csv", "﻿A,b,C\n1,2,3\n")
    assert [tuple(r) for r in files.read_registry_csv(spark, folder, SCHEMA).collect()] == [
        ("1", "2", "3")]


def test_other_headers_are_refused(spark, folder):
    write(folder, "f.csv", "a,b,wrong\n1,2,3\n")
    with pytest.raises(Exception, match="header"):
        files.read_registry_csv(spark, folder, SCHEMA).collect()


def test_empty_files_and_missing_paths(spark, folder):
    write(folder, "f.csv", "")
    write(folder, "g.csv", "a,b,c\n")
    assert files.read_registry_csv(spark, folder, SCHEMA).collect() == []
    with pytest.raises(FileNotFoundError):
        files.read_registry_csv(spark, folder + "/none", SCHEMA)


def test_ranges_that_changed_between_the_passes_are_refused(spark, folder, split):
    write(folder, "f.csv", csv_text(random_rows(2, 200)))
    split(500)
    rows = files.read_registry_csv(spark, folder, SCHEMA)
    split(300)
    with pytest.raises(Exception, match="changed while reading"):
        rows.collect()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans()), max_size=12), st.booleans())
def test_states_equal_one_line_at_a_time(maps, first):
    want, now = [], first
    for end0, end1 in maps:
        want.append(now)
        now = end1 if now else end0
    ends = [np.array([m[k] for m in maps], bool) for k in (0, 1)]
    before, last = csv_ranges.states(*ends, first)
    assert (before.tolist(), last) == (want, now)
