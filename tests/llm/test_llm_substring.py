import random

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from consentry.llm import substring

SCHEMA = "doc_id bigint, text string, kept string, anchor int"


def check(spark, texts, length=6, gram=2):
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)]
    got = substring.remove_repeated(
        spark.createDataFrame(rows, SCHEMA).repartition(3), length=length, gram=gram).collect()
    by_key = {r.key: (r.n_words, sum(s.end - s.start for s in r.removed), r.kept) for r in got}
    assert by_key == dict(enumerate(brute.kept_words(texts, length)))


def passages(rng, n, letters):
    shared = [" ".join(rng.choice(letters) for _ in range(rng.randrange(3, 14))) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(
            rng.choice(letters) for _ in range(rng.randrange(0, 12))) for _ in range(4)]
        out.append(" ".join(parts))
    return out


def test_random_texts(spark):
    rng = random.Random(1)
    check(spark, passages(rng, 60, "abcdefgh") + [None, "", " ", "a b"])
    check(spark, passages(rng, 60, "ab"))
    check(spark, passages(rng, 80, [f"w{k}" for k in range(500)]))


def test_anchors_with_many_variants(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(substring, "VARIANTS", 2)
    check(spark, passages(rng, 60, "abcdefgh"))
    common = " ".join(f"c{k}" for k in range(9))
    check(spark, [f"l{k} m{k} n{k} {common} x{k} y{k} z{k}" for k in range(40)])


def test_small_shards(spark, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_WORDS", 10)
    check(spark, passages(random.Random(3), 60, "abcd"))


def test_periodic_and_repeated_texts(spark):
    check(spark, ["a " * 50, "a b " * 20, "x y z " * 3, "q w e r t y u", "q w e r t y u", "a b c"])


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f g", "x", 1), (1, "a b c d e f g", "x", 1),
            (None, "b c d e f g h", "x", 1), (2, "h i j k l m", "x", 1)]
    got = substring.remove_repeated(spark.createDataFrame(rows, SCHEMA), length=6, gram=2).collect()
    assert sorted((str(r.key), r.kept) for r in got) == [
        ("1", ""), ("1", ""), ("2", "h i j k l m"), ("None", "h")]


def test_production_length(spark):
    rng = random.Random(4)
    words = [f"v{k}" for k in range(300)]
    check(spark, passages(rng, 5, words) + [" ".join(words[:80]), " ".join(words[20:60]) + " end",
          "start " + " ".join(words[10:44])], length=35, gram=8)


def test_empty_table(spark):
    check(spark, [])


sequences = st.lists(st.lists(st.integers(0, 2), max_size=30), min_size=1, max_size=5)


@settings(max_examples=200, deadline=None)
@given(sequences, st.integers(1, 6))
def test_automaton(found, length):
    automaton = substring.Automaton(found)
    places = {}
    for s in found:
        for k in range(len(s) - length + 1):
            places[tuple(s[k:k + length])] = places.get(tuple(s[k:k + length]), 0) + 1
    for s in found:
        want = [k for k in range(len(s) - length + 1) if places[tuple(s[k:k + length])] > 1]
        assert automaton.repeated(s, length) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), max_size=6))
def test_stretches_cover_every_window_once(docs):
    starts = np.cumsum([0, *map(len, docs)])
    words = np.array([w for d in docs for w in d], np.uint64)
    _, doc, window, count = substring.stretches(words, starts, 5, 2)
    seen = [(d, w + k) for d, w, n in zip(doc, window, count) for k in range(n)]
    want = [(d, starts[d] + k) for d, t in enumerate(docs) for k in range(len(t) - 4)]
    assert sorted(seen) == sorted(want)
