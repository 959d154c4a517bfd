import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from consentry.llm import trie
from consentry.llm.sql import ORACLE_SQL

SCHEMA = "conv_id bigint, turn bigint, role string, text string, seq string, words int"


def number(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}:{text or ''}".encode()).digest()[:16]


def plain(rows):
    """All nodes as tuples, from a dictionary of prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        own[conv].append(((turn is not None, turn or 0, number(role, text)), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        base = [] if c is None else own.get(c - int(abs(c) % 20) * (1 if c >= 0 else -1), [])
        whole[c] = tuple(base[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    least = {p: min((c for c in m if c is not None), default=None) for p, m in members.items()}
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += p not in children
    out = []
    for p, m in members.items():
        ends = sorted(c for c in m if c is not None and len(whole[c]) == len(p))
        out.append((
            least[p], len(p), least[p[:-1]] if p else None, len(m), children.get(p, 0), leaves[p],
            saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = trie.prefix_trie(df, **how).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        "ends_sha256").collect()
    return sorted(map(tuple, got), key=repr)


def random_turns(seed, convs, longest, texts):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-30, 4 * convs), convs):
        for k in range(r.randint(1, longest)):
            rows.append((c, k * 2, r.choice(["user", "bot"]) if k > 2 else "user", r.choice(texts), "s", 1))
    return rows


@pytest.mark.parametrize("sequences, size", [(512, 1 << 20), (1, 1 << 20), (3, 1 << 20), (512, 40)])
def test_equals_plain_trie(spark, sequences, size):
    rows = random_turns(sequences, 60, 6, ["a b", "c", "", "d  e\tf"])
    assert nodes(spark, rows, sequences=sequences, size=size) == plain(rows)


def test_long_shared_beginning_copies_and_hot_first_turn(spark):
    line = [(0, k, "user", f"w{k} x", "s", 1) for k in range(40)]
    rows = list(line)
    for c in range(20, 120):  # copies, and beginnings that end within the others
        rows += [(c, *t[1:]) for t in line[:5 + (c % 7) * 5]]
    rows += [(200 + c, k, "user", f"w{k if k < 30 else c} x", "s", 1) for c in range(50) for k in range(32)]
    want = plain(rows)
    assert nodes(spark, rows, sequences=4) == want
    assert nodes(spark, rows) == want


def test_nulls_ties_repeats_and_turnless(spark):
    rows = [
        (20, None, None, None, "s", 1), (20, 0, "user", "a b c", "s", 1), (20, 0, "user", "a b c", "s", 1),
        (20, 5, "bot", None, "s", 1), (21, 0, "x", "y", "s", 1), (22, 0, "u", "long " * 30_000, "s", 1),
        (None, 0, "user", "a b c", "s", 1), (None, None, "user", "z", "s", 1), (-3, 0, "user", "q", "s", 1),
        (47, 0, "user", "no first of the family", "s", 1), (1_000_000_007, 1, "", "", "s", 1),
        (65, 0, "only", "turn", "s", 1), (66, 0, "only", "turn", "s", 1), (67, 0, "only", "turn", "s", 1),
    ]
    assert nodes(spark, rows) == plain(rows)
    assert nodes(spark, rows, sequences=1) == plain(rows)


def test_no_conversations(spark):
    assert nodes(spark, []) == []


def test_ids_in_blocks_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(trie, "ID_BLOCK_BITS", 2)
    rows = [(c, 0, "u", "same", "s", 1) for c in range(-40, 300, 20)]
    assert nodes(spark, rows) == plain(rows)


@pytest.mark.parametrize("sequences", [5, 40])
def test_equals_sql_with_bursts(spark, sequences):
    folder = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{folder}/conversations.parquet")
    assert difference(
        trie.prefix_trie(df, sequences=sequences), connect(folder), ORACLE_SQL["op13_trie"]) == ""


def test_a_shared_beginning_bursts_in_one_round(spark, monkeypatch):
    rounds = []
    burst = trie._burst
    monkeypatch.setattr(trie, "_burst", lambda *a: rounds.append(1) or burst(*a))
    df = spark.range(1000).select(
        (F.col("id") * 20).alias("conv_id"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("turn"),
        F.lit("u").alias("role"), F.when(F.col("turn") == 20, F.col("conv_id")).otherwise(
            F.col("turn")).cast("string").alias("text"))
    tops = trie.prefix_trie(df, sequences=100).filter("depth = 20").collect()
    assert [(r.n_convs, r.n_children, r.n_leaves) for r in tops] == [(1000, 1000, 1000)]
    assert len(rounds) == 1
