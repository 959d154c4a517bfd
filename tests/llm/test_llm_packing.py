import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from consentry.llm import packing
from consentry.llm.queries import QUERIES

WORD = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, length int, `offset` int, rank string"


def encoded(texts, end=0):
    t = Tokenizer.from_file(WORD)
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def check_whole(rows, docs, capacity):
    """Every document is there once, in pieces as stated, and sequences are gapless and hold."""
    pieces = Counter((r.key, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for key, ids in docs:
        for k, a in enumerate(range(0, len(ids), capacity)):
            some = ids[a:a + capacity]
            want[key, k, a, len(some), zlib.crc32(np.array(some, "<u4").tobytes())] += 1
    assert pieces == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_query_packs_every_document_and_wastes_little(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    docs = list(zip([r.doc_id for r in table], encoded([r.text for r in table])))
    rows = QUERIES["op12_packing"](spark, sf_dir).withColumnRenamed("doc_id", "key").collect()
    used = check_whole(rows, docs, 2048)
    least = math.ceil(sum(len(ids) for _, ids in docs) / 2048)
    assert used <= 1.02 * least + 1


@pytest.mark.parametrize("capacity, groups", [(16, 4), (7, 2), (2048, 64), (1, 3)])
def test_nulls_ties_repeats_and_long_texts(spark, capacity, groups):
    texts = ["a b c", None, "", "word " * 40, "word " * 16, "x y", "x y", "a b c d e f g", " \t",
             "one two three four five six seven eight"] * 3
    keys = [3, 1, None, 3, 5, 6, 6, 8, 9, 10] * 3
    df = spark.createDataFrame(
        [(k, t, 1, 2, "r") for k, t in zip(keys, texts)], SCHEMA).repartition(5)
    packed = packing.pack(df, WORD, capacity=capacity, groups=groups, word_level=True, ids=True)
    rows = packed.collect()
    docs = list(zip(keys, encoded(texts)))
    used = check_whole(rows, docs, capacity)
    assert used <= 1.35 * math.ceil(sum(len(ids) for _, ids in docs) / capacity) + 1
    made = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert sorted(x for ids in made.values() for x in ids) == sorted(x for _, d in docs for x in d)
    for r in rows:
        assert made[r.sequence_id][r.offset:r.offset + r.length] == r.ids


@pytest.mark.parametrize("text", ["word " * 2, "word " * 30, None])
def test_only_one_length(spark, text):
    df = spark.createDataFrame([(k, text) for k in range(50)], "doc_id bigint, text string")
    rows = packing.pack(df, WORD, capacity=16, word_level=True).collect()
    ids = encoded([text])[0]
    used = check_whole(rows, [(k, ids) for k in range(50)], 16)
    last = len(ids) % 16
    assert used == 50 * (len(ids) // 16) + (math.ceil(50 / (16 // last)) if last else 0)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(df, WORD).collect() == []


def test_the_plan_does_not_grow_with_the_rows(spark):
    few = {600 + 7 * k: 5 for k in range(100)}
    many = {n: c * 1_000_000 for n, c in few.items()}
    small = {20 + k: 1_000_003 for k in range(50)}
    a, _ = packing._large_plan(few, 16, 2048)
    b, taken = packing._large_plan(many, 16, 2048)
    steps, _ = packing.best_fit(small, {100: 5_000_000, 37: 4_000_000}, 2048)
    assert len(b) < 20 * 16 and len(a) < 20 * 16 and len(steps) < 300
    assert taken >= sum(n * c for n, c in many.items()) / 2048


counts = st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12)


def one_by_one(pieces, rooms):
    """Best fit with one piece at a time; how many sequences end with each room."""
    left, opened = sorted(r for r, n in rooms.items() for _ in range(n)), 0
    for length in sorted((x for x, n in pieces.items() for _ in range(n)), reverse=True):
        fit = [r for r in left if r >= length]
        if fit:
            room = min(fit)
            left.remove(room)
        else:
            room, opened = 40, opened + 1
        left.append(room - length)
    return sorted(left), opened


@settings(max_examples=200, deadline=None)
@given(counts, counts)
def test_best_fit_equals_one_piece_at_a_time(pieces, rooms):
    steps, opened = packing.best_fit(pieces, rooms, 40)
    rooms = {r: n for r, n in rooms.items() if r < 40}
    steps, opened = packing.best_fit(pieces, rooms, 40)
    filled = Counter()
    placed = Counter()
    for s in steps:
        placed[s.length] += s.times * s.each
        for k in range(s.times):
            at = (s.room, s.first + k)
            assert filled[at] == s.offset - (40 - s.room)
            filled[at] += s.each * s.length
    assert placed == Counter(pieces)
    left = [r - filled[r, k] for r, n in rooms.items() for k in range(n)]
    left += [40 - filled[40, k] for k in range(opened)]
    assert (sorted(left), opened) == one_by_one(pieces, rooms)


@settings(max_examples=100, deadline=None)
@given(counts, st.integers(1, 6))
def test_rounding_and_configurations(lengths, groups):
    sizes = packing.rounded(lengths, groups)
    total = sum(lengths.values())
    assert sum(sizes.values()) == total and len(sizes) <= groups
    each = sorted(x for x, n in lengths.items() for _ in range(n))
    up = sorted(x for x, n in sizes.items() for _ in range(n))
    assert all(a <= b for a, b in zip(each, up))
    used = packing.configurations(sizes, 40)
    made = Counter()
    for pattern, times in used:
        assert sum(s * n for s, n in pattern.items()) <= 40
        for s, n in pattern.items():
            made[s] += n * times
    assert made == Counter(sizes)
    n = sum(times for _, times in used)
    assert n <= math.ceil(1.001 * one_by_one(sizes, {})[1]) + len(sizes)


def test_configurations_reach_the_least():
    # Three pieces of 0.3 to 0.4 fill a sequence only if unlike ones are put together.
    demand = {400: 300, 350: 300, 250: 300}
    assert sum(n for _, n in packing.configurations(demand, 1000)) == 300


def test_pieces_are_numbered_within_their_task(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7)
    made = packing.cut(docs, WORD, key="doc_id", text="text", end_id=0, capacity=64,
                       word_level=True, ids=False)
    rows, counts = packing.ranked(packing.stage(made), "length")
    got = rows.groupBy("length").agg(
        F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("top"))
    for r in got.collect():
        assert r.n == r.d == r.top + 1 == counts[r.length]
