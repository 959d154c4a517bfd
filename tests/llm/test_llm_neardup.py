import random

import brute
import numpy as np
import pytest

from consentry.llm import neardup
from consentry.llm.components import components
from consentry.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, kept string, node int"


def found(spark, rows, shingle):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA)
    return neardup.near_classes(df, shingle=shingle).collect()


def check(spark, rows, shingle):
    """``rows`` have distinct ids in ascending order."""
    want = brute.near_classes([t for _, t in rows], shingle)
    got = {r.key: (r.n_shingles, r.class_key, r.kept) for r in found(spark, rows, shingle)}
    keys = [k for k, _ in rows]
    assert got == {k: (n, keys[c], keys[c] == k) for k, (n, c) in zip(keys, want)}


def text(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = brute.near_classes([r.text for r in rows], 2)
    got = {r.doc_id: r for r in QUERIES["op8_near_dedup"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for row, (n, c) in zip(rows, want):
        r = got[row.doc_id]
        assert (r.n_shingles, r.component_id, r.kept) == (n, rows[c].doc_id, c == rows.index(row))


def test_copies_that_only_link_through_a_base(spark):
    """Edited copies are far from each other; the base, which links them, has the largest id."""
    rng, rows = random.Random(4), []
    base = text(rng, 200)
    for k in range(60):
        copy = list(base)
        for at in rng.sample(range(200), 17):
            copy[at] = f"new{k}_{at}"
        rows.append((k, " ".join(copy)))
    rows += [(100, " ".join(base)), (101, " ".join(text(rng, 200)))]
    pairs = brute.near_classes([t for _, t in rows[:60]], 2)
    assert len({c for _, c in pairs}) > 30
    check(spark, rows, 2)


def test_long_chains(spark):
    rng, rows = random.Random(5), []
    words = text(rng, 120)
    for k in range(50):
        words = words[6:] + text(rng, 6)
        rows.append((k, " ".join(words)))
    check(spark, rows, 5)


def test_blocks_of_an_entry(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    test_copies_that_only_link_through_a_base(spark)


def test_borderline_pairs(spark):
    rng, rows = random.Random(6), []
    for k in range(0, 400, 2):
        words = text(rng, 100)
        n = rng.randrange(2, 16)
        rows += [(k, " ".join(words)), (k + 1, " ".join(words[:-n] + text(rng, n)))]
    check(spark, rows, 2)


@pytest.mark.parametrize("shingle", [2, 5])
def test_short_texts_nulls_and_ties(spark, shingle):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "two one"),
            (8, "One  two\n"), (9, "É"), (10, "é"), (11, None), (12, "a b c d e"),
            (13, "a b c d e e")]
    check(spark, rows, shingle)


def test_repeated_and_null_ids(spark):
    rows = [(2, "a b c d e f"), (2, "a b c d e f"), (1, "x y z u v w"), (1, "a b c d e f"),
            (None, "a b c d e f"), (None, "lone text here")]
    got = sorted(((r.key, r.class_key, r.kept) for r in found(spark, rows, 2)), key=repr)
    assert got == sorted([(2, 1, False), (2, 1, False), (1, 1, True), (1, 1, True),
                          (None, 1, False), (None, None, True)], key=repr)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA)
    left = neardup.near_unique(df, shingle=2).collect()
    assert left[0].asDict().keys() == {"doc_id", "text", "kept", "node"}
    assert sorted((str(r.doc_id), r.text) for r in left) == [
        ("1", "a b c d e f"), ("1", "x y z u v w"), ("None", "lone text here")]
    twice = spark.createDataFrame([(1, "a b c", "x", 1), (1, "a b c", "y", 2)], SCHEMA)
    assert neardup.near_unique(twice, shingle=2).count() == 1


def test_empty_table(spark):
    assert found(spark, [], 2) == []


def test_no_signature_pair_under_the_distance_is_missed():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (500, neardup.PLACES), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(neardup.PLACES, neardup.DISTANCE, replace=False)] ^= 1
    same = neardup.entries(a) == neardup.entries(b)
    assert same.any(axis=1).all()


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 90), (90, 95), (5, 5), (200, 300)]
    got = {r.node: r.root for r in components(
        spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 95: 90, 100: 90, 300: 200}


def test_query_keeps_by_the_contract(spark, folder):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    got = QUERIES["op8_near_dedup"](spark, folder).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [
        (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)]
