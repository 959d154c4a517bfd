"""Prefix trie of conversations by burst tries.

A turn's number is 128 bits of a SHA-256 over its role and text, so a conversation is a byte string
of its turns' numbers and texts travel no further. Equal conversations are one sequence with a
weight. All sequences start in one container. A container with too many sequences or bytes bursts:
what its sequences have in common becomes a head (a chain of nodes), and each next turn number after
it starts a container of its own, until all containers are small. The common part is that of the
least and the greatest sequence, so a long shared beginning takes one round and not one per turn.
Small containers are dealt to tasks, sorted and swept: one pass over a container's sorted sequences
emits its nodes, with runs of nodes that do not branch handled as arrays. Totals of the containers'
top nodes then go up from head to head, the last burst first.

Every round writes its sequences and heads, so a lost executor repeats one round at most. Bursting
looks at counts and sums formed before the shuffle; a hot beginning is what bursts. Ids of equal
conversations are joined in blocks of bounded size, whose texts one pass streams through SHA-256.

Sizes: a conversation's numbers are one row (20 bytes a turn); one alone is never burst.

Cases: null turns come first, and turns of equal number are ordered by their own number's bytes (a
row that repeats is a turn of its own); null role or text counts as empty; rows without an id are
one conversation, whose id comes after all others, is empty in ``ends``, and which shares no other's
beginning; texts of any length are hashed whole; an empty table has no nodes; further columns are
left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.llm.common import WORD, prepare
from consentry.sources.staging import lookup, stage

#: Conversations that share the beginning of the first of them.
FAMILY = 20
#: A container with more sequences or bytes bursts, unless it holds one sequence.
SEQUENCES = 512
BYTES = 4 << 20
#: Ids (by value) that are joined to one text before they are streamed.
ID_BLOCK_BITS = 12
#: Nodes that leave a task together, unless one container has more.
NODES = 10_000
#: Bytes of a turn's number.
WIDTH = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = ("conv_id {key}, depth bigint, parent_conv_id {key}, n_convs bigint, n_children bigint, "
         "n_leaves bigint, saved_tokens bigint, ends_sha256 string, parent_head binary")


def turn_number(role: Column, text: Column) -> Column:
    """128 bits of role and text, in hex; the role's length keeps the two apart."""
    whole = F.concat_ws(":", F.octet_length(role).cast("string"), role, text)
    return F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * WIDTH)


def rebuilt(turns: DataFrame, family: int = FAMILY) -> DataFrame:
    """``conv_id``, ``seq`` (its turns' numbers) and ``words`` (of each turn) per conversation.

    A conversation c starts with the first h turns of c - c % family as they were, h = crc32(c) % 4,
    and goes on with its own turns after its first h.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    one = F.struct(
        F.col("turn").isNotNull().alias("known"), "turn", turn_number(role, text).alias("number"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    first = F.col("conv_id") - F.col("conv_id") % family
    own = turns.select("conv_id", one.alias("one")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("one")).alias("own")).withColumn("base", first)
    own = stage(own.select(
        "conv_id", "base", F.col("own.number").alias("numbers"), F.col("own.words").alias("words")))
    shared = F.coalesce((F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int"), F.lit(0))
    heads = own.filter("conv_id = base").select(
        "base", F.slice("numbers", 1, 3).alias("head"), F.slice("words", 1, 3).alias("head_words"))
    n = F.col("n")

    def joined(head: str, rest: str) -> Column:
        none = F.array().cast(rest_type[rest])
        start = F.when(n > 0, F.slice(F.coalesce(F.col(head), none), F.lit(1), F.greatest(n, F.lit(1))))
        return F.concat(F.coalesce(start, none), F.slice(rest, n + 1, F.size(rest) + 1))

    rest_type = {"numbers": "array<string>", "words": "array<bigint>"}
    return own.join(heads, "base", "left").withColumn("n", shared).select(
        "conv_id", F.unhex(F.array_join(joined("head", "numbers"), "")).alias("seq"),
        joined("head_words", "words").alias("words"))


def _digest(seq: str) -> Column:
    return F.unhex(F.substring(F.sha2(seq, 256), 1, 2 * WIDTH))


def _weights(convs: DataFrame) -> DataFrame:
    """Per sequence: ``conv_id`` (the least), ``n``, and the hash of all its ids in order."""
    block = F.shiftright("conv_id", ID_BLOCK_BITS)
    blocks = convs.groupBy(_digest("seq").alias("at"), block.alias("block")).agg(
        F.min("conv_id").alias("first"), F.count("*").alias("n"),
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    key = convs.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, n, hashed, type_ = None, None, 0, hashlib.sha256(), None

        def done(rows: list[tuple]) -> pa.RecordBatch:
            ids, counts, hashes = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, type_), pa.array(counts, pa.int64()), pa.array(hashes, pa.string())],
                names=["conv_id", "n", "ends"])

        for batch in batches:
            rows, type_ = [], batch.schema.field("first").type
            for key_, first_, n_, ids in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if key_ != at:
                    if at is not None:
                        rows.append((first, n, hashed.hexdigest()))
                    at, first, n, hashed = key_, first_, 0, hashlib.sha256()
                elif ids:
                    hashed.update(b",")
                hashed.update(ids.encode())
                n += n_
            if rows:
                yield done(rows)
        if at is not None:
            yield done([(first, n, hashed.hexdigest())])

    ordered = blocks.repartition("at").sortWithinPartitions(
        "at", F.col("block").asc_nulls_last()).select("at", "first", "n", "ids")
    return ordered.mapInArrow(run, f"conv_id {key}, n bigint, ends string")


def common(a: bytes, b: bytes) -> int:
    """How many turns two sequences have in common at their start."""
    n = min(len(a), len(b)) // WIDTH
    if a[:n * WIDTH] == b[:n * WIDTH]:
        return n
    x, y = (np.frombuffer(s, np.uint8, n * WIDTH) for s in (a, b))
    return int((x != y).argmax()) // WIDTH


def _heads(live: DataFrame, sequences: int, size: int) -> DataFrame:
    """The containers that burst: what their sequences have in common, and their sums."""
    key = live.schema["conv_id"].dataType.simpleString()
    bounds = live.groupBy("container").agg(
        F.count("*").alias("count"), F.sum(F.octet_length("seq")).alias("bytes"),
        F.min(F.struct("seq", "words", "ends")).alias("lo"), F.max("seq").alias("hi"),
        F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("top"), F.first("parent_head").alias("parent_head"),
        F.first("parent_conv_id").alias("parent_conv_id"))
    full = bounds.filter((F.col("count") > 1) & ((F.col("count") > sequences) | (F.col("bytes") > size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = (batch.column(k).to_pylist() for k in (0, 1))
            end = [common(a, b) for a, b in zip(lo, hi)]
            yield batch.append_column("end", pa.array(end, pa.int64()))

    shared = full.select(
        "lo.seq", "hi", "container", "top", "lo.words", "lo.ends", "n_convs", "conv_id",
        "parent_head", "parent_conv_id").mapInArrow(
        run, f"seq binary, hi binary, container binary, top bigint, words array<bigint>, "
        f"ends string, n_convs bigint, conv_id {key}, parent_head binary, parent_conv_id {key}, "
        f"end bigint")
    whole = F.octet_length("seq") == WIDTH * F.col("end")
    return shared.select(
        "container", "top", "end", F.slice("words", 1, F.col("end").cast("int")).alias("words"),
        F.when(whole, F.col("ends")).otherwise(F.lit(NO_ENDS)).alias("ends"),
        "n_convs", "conv_id", "parent_head", "parent_conv_id")


def _burst(live: DataFrame, heads: DataFrame) -> DataFrame:
    """``live`` with the sequences of burst containers in new ones; ``open`` tells which those are.

    A sequence that ends with its head is done: the head has its weight and ends.
    """
    at = heads.select(
        F.col("container"), F.col("end"), F.col("conv_id").alias("head_conv_id"))
    next_at = (F.col("end") + 1).cast("int")
    own = F.col("end").isNotNull()
    return live.join(at, "container", "left").filter(
        ~own | (F.octet_length("seq") > WIDTH * F.col("end"))).select(
        F.when(own, F.unhex(F.substring(F.sha2(
            F.substring("seq", F.lit(1), next_at * WIDTH), 256), 1, 2 * WIDTH)))
        .otherwise(F.col("container")).alias("container"),
        F.coalesce(F.col("end") + 1, F.col("depth")).alias("depth"), "seq", "words", "n", "conv_id",
        "ends",
        F.when(own, F.col("container")).otherwise(F.col("parent_head")).alias("parent_head"),
        F.when(own, F.col("head_conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        own.alias("open"))


class _Run:
    """A run of nodes from depth ``top`` to ``end`` that have the same members and do not branch."""

    __slots__ = ("top", "end", "n", "conv", "ends", "words", "children", "leaves", "saved", "below")

    def __init__(self, top: int, end: int, words: np.ndarray) -> None:
        self.top, self.end, self.words = top, end, words  # words of the turn that leads to each node
        self.n, self.conv, self.ends = 0, None, NO_ENDS
        self.children, self.leaves, self.saved = 0, 0, 0
        self.below: list[int] = []  # output rows of the children's top nodes

    def take(self, n: int, conv: int | None) -> None:
        self.n += n
        if self.conv is None or (conv is not None and conv < self.conv):
            self.conv = conv


class _Nodes:
    """Nodes of finished containers, a list per column."""

    def __init__(self, key: pa.DataType) -> None:
        self.key = key
        self._clear()

    def _clear(self) -> None:
        self.conv, self.depth, self.parent, self.n, self.children = [], [], [], [], []
        self.leaves, self.saved, self.ends, self.head = [], [], [], []

    def batch(self) -> pa.RecordBatch:
        long = pa.int64()
        out = pa.RecordBatch.from_pydict({
            "conv_id": pa.array(self.conv, self.key), "depth": pa.array(self.depth, long),
            "parent_conv_id": pa.array(self.parent, self.key), "n_convs": pa.array(self.n, long),
            "n_children": pa.array(self.children, long), "n_leaves": pa.array(self.leaves, long),
            "saved_tokens": pa.array(self.saved, long),
            "ends_sha256": pa.array(self.ends, pa.string()),
            "parent_head": pa.array(self.head, pa.binary())})
        self._clear()
        return out


class _Sweep:
    """Nodes of one container from its sequences in order."""

    def __init__(
        self, nodes: _Nodes, top: int, parent_head: bytes | None, parent_conv: int | None
    ) -> None:
        self.nodes, self.top = nodes, top
        self.parent_head, self.parent_conv = parent_head, parent_conv
        self.stack: list[_Run] = []
        self.last: bytes | None = None

    def add(self, seq: bytes, words: np.ndarray, n: int, conv: int | None, ends: str) -> None:
        depth = len(seq) // WIDTH
        if self.last is None:
            self.push(self.top, depth, words)
        else:
            keep = common(self.last, seq)
            while self.stack[-1].top > keep:
                self._pop()
            run = self.stack[-1]
            if run.end > keep:  # the run branches here: its lower part is a child of the upper one
                lower = self._split(run, keep)
                self._close(lower, run)
            self.push(keep + 1, depth, words)
        for run in self.stack:
            run.take(n, conv)
        self.stack[-1].ends = ends
        self.last = seq

    def push(self, top: int, end: int, words: np.ndarray) -> _Run:
        # words[k] is of the turn that leads to depth k + 1; nothing leads to the root.
        own = words[top - 1:end] if top else np.append(0, words[:end])
        self.stack.append(_Run(top, end, own))
        return self.stack[-1]

    def _split(self, run: _Run, keep: int) -> _Run:
        lower = _Run(keep + 1, run.end, run.words[keep + 1 - run.top:])
        for name in ("n", "conv", "ends", "children", "leaves", "saved", "below"):
            setattr(lower, name, getattr(run, name))
        run.end, run.words = keep, run.words[:keep + 1 - run.top]
        run.ends, run.children, run.leaves, run.saved, run.below = NO_ENDS, 0, 0, 0, []
        return lower

    def _pop(self) -> None:
        run = self.stack.pop()
        self._close(run, self.stack[-1] if self.stack else None)

    def _close(self, run: _Run, parent: _Run | None) -> None:
        size, out = run.end - run.top + 1, self.nodes
        row, leaves = len(out.conv), run.leaves or 1
        saved = (run.saved + np.cumsum(((run.n - 1) * run.words)[::-1])[::-1]).tolist()
        out.conv += [run.conv] * size
        out.depth += range(run.top, run.end + 1)
        out.parent += [None] + [run.conv] * (size - 1)
        out.n += [run.n] * size
        out.children += [1] * (size - 1) + [run.children]
        out.leaves += [leaves] * size
        out.saved += saved
        out.ends += [NO_ENDS] * (size - 1) + [run.ends]
        out.head += [None] * size
        for below in run.below:
            out.parent[below] = run.conv
        if parent:
            parent.below.append(row)
            parent.children += 1
            parent.leaves += leaves
            parent.saved += saved[0]
        else:
            out.parent[row], out.head[row] = self.parent_conv, self.parent_head

    def finish(self) -> None:
        while self.stack:
            self._pop()


def _swept(settled: DataFrame) -> DataFrame:
    """The nodes of all small containers; a container's top node names the head above it."""
    key = settled.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, at, nodes = None, None, None
        columns = ("container", "depth", "seq", "n", "conv_id", "ends", "parent_head", "parent_conv_id")
        for batch in batches:
            nodes = nodes or _Nodes(batch.schema.field("conv_id").type)
            words = batch.column("words")
            flat, bounds = words.values.to_numpy(), words.offsets.to_numpy()
            for k, (container, depth, seq, n, conv, ends, head, parent) in enumerate(
                zip(*[batch.column(c).to_pylist() for c in columns])
            ):
                if container != at:
                    if sweep:
                        sweep.finish()
                        if len(nodes.conv) >= NODES:
                            yield nodes.batch()
                    sweep, at = _Sweep(nodes, depth, head, parent), container
                sweep.add(seq, flat[bounds[k]:bounds[k + 1]], n, conv, ends)
        if sweep:
            sweep.finish()
            yield nodes.batch()

    ordered = settled.repartition("container").sortWithinPartitions("container", "seq")
    return ordered.mapInArrow(run, _NODE.format(key=key))


def _head_nodes(heads: DataFrame, tops: DataFrame) -> DataFrame:
    """Heads of one round with the totals of what hangs below them: ``below`` counts their children."""
    sums = tops.filter("parent_head IS NOT NULL").groupBy(F.col("parent_head").alias("container")).agg(
        F.count("*").alias("children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved"))
    return heads.join(lookup(sums), "container")


def _chain(heads: DataFrame) -> DataFrame:
    """The nodes of heads, one per depth from top to end; the first names the head above."""
    key = heads.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = _Nodes(batch.schema.field("conv_id").type)
            for r in batch.to_pylist():
                sweep = _Sweep(nodes, r["top"], r["parent_head"], r["parent_conv_id"])
                chain = sweep.push(r["top"], r["end"], np.array(r["words"], np.int64))
                chain.n, chain.conv, chain.ends = r["n_convs"], r["conv_id"], r["ends"]
                chain.children, chain.leaves, chain.saved = r["children"], r["n_leaves"], r["saved"]
                sweep.finish()
                if len(nodes.conv) >= NODES:
                    yield nodes.batch()
            yield nodes.batch()

    return heads.mapInArrow(run, _NODE.format(key=key))


def prefix_trie(
    turns: DataFrame, *, sequences: int = SEQUENCES, size: int = BYTES, family: int = FAMILY
) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, from ``conv_id``, ``turn``, ``role``, ``text``."""
    prepare(turns.sparkSession)
    convs = stage(rebuilt(turns, family))
    weights = _weights(convs)
    live = stage(
        convs.alias("c").join(weights.alias("w"), F.col("c.conv_id").eqNullSafe(F.col("w.conv_id")))
        .select(
            F.lit(b"").alias("container"), F.lit(0).cast("bigint").alias("depth"), "seq", "words", "n",
            F.col("c.conv_id").alias("conv_id"), "ends", F.lit(None).cast("binary").alias("parent_head"),
            F.lit(None).cast(convs.schema["conv_id"].dataType).alias("parent_conv_id")))
    settled, rounds = [], []
    while True:
        heads = lookup(_heads(live, sequences, size))
        if heads.isEmpty():
            settled.append(live)
            break
        rounds.append(heads)
        dealt = stage(_burst(live, heads))
        settled.append(dealt.filter("NOT open").drop("open"))
        live = dealt.filter("open").drop("open")
    nodes = [stage(_swept(reduce(DataFrame.unionByName, settled)))]
    tops = nodes[0].filter("parent_head IS NOT NULL")
    for heads in reversed(rounds):
        chain = stage(_chain(_head_nodes(heads, tops)))
        nodes.append(chain)
        tops = tops.unionByName(chain.filter("parent_head IS NOT NULL"))
    return reduce(DataFrame.unionByName, nodes).drop("parent_head")
