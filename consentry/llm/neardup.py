"""Near-duplicate classes: b-bit minhash signatures joined by a multi-index Hamming search.

A text is the set of its word shingles. Equal sets are one *node*. A node's signature has ``CHUNKS``
chunks of ``CHUNK`` minhashes, each cut to 16 bits. Two signatures that differ in at most
``DISTANCE = 2 * CHUNKS - 1`` places have, by the pigeonhole principle, a chunk with at most one
difference. So each chunk is entered once per place where the error may be, without that place:
nodes that agree in one entry are candidates, and none under the distance is missed. Pairs beyond
it, up to ``FAR`` differences, are candidates too if they share an entry. At a true similarity of 0.8,
three pairs in ten million differ in more places; of those with fewer, two in a billion share none.

A link is confirmed on the full sets (of 64-bit shingle numbers). What is wanted is the connected
classes of the link graph, not every link, so candidates are tried in this order:

1. Each entry's least node is its hub. Every node tries the hubs it shares most entries with.
   That is linear in the entries, however many nodes share one.
2. Entries (of some chunks) whose nodes then still belong to several classes are looked at in blocks
   of bounded size; of each node the nearest partner of another class is tried.
3. What still lies in several classes is tried exhaustively: all candidate pairs of different
   classes, checked within the blocks, so that they never become rows. Nothing is
   capped: after this, no candidate pair between two classes is untried.

Cases: texts without words (null, empty, white space) have no shingle, link with nothing and are
their own class; a text with fewer words than a shingle has one shingle, all its words; rows of
equal text link whatever their ids; a null id has no class id unless a linked row has one; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from consentry.llm import words as W
from consentry.llm.common import map_rows, prepare, utf8
from consentry.llm.components import components
from consentry.sources.staging import lookup, stage

SHINGLE = 5
PERCENT = 80
CHUNKS = 15
CHUNK = 5
PLACES = CHUNKS * CHUNK
DISTANCE = 2 * CHUNKS - 1
#: Differences up to which a pair that shares an entry is looked at.
FAR = 34
#: Hubs a node tries before entries are looked at in blocks.
HUBS = 3
#: Entries in which the nearest partner is looked for, those of the first chunks; the exhaustive
#: search that follows looks at all.
NEAREST_PLACES = 25
#: Nodes of one entry that are compared with another block of as many at once.
BLOCK = 2048

_SEED = np.random.default_rng(20).integers(1, 1 << 63, PLACES, dtype=np.uint64) * 2 + 1


def shingles(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle numbers of all texts in a row, and where each text's begin."""
    split = [t.lower().split() if t else [] for t in texts]
    numbers, starts = W.numbers(split)
    counts = np.diff(starts)
    long = counts >= size
    runs = W.sequences(numbers, size)
    owner = np.repeat(np.arange(len(texts)), np.where(long, counts - size + 1, 0))
    first = np.repeat(starts[:-1], np.where(long, counts - size + 1, 0))
    within = np.arange(len(owner)) - np.repeat(
        np.cumsum(np.where(long, counts - size + 1, 0)) - np.where(long, counts - size + 1, 0),
        np.where(long, counts - size + 1, 0))
    values = runs[first + within] if len(owner) else np.zeros(0, np.uint64)
    short = np.flatnonzero(~long & (counts > 0))
    if len(short):
        own = [W.sequences(numbers[starts[k]:starts[k + 1]], int(counts[k]))[0] for k in short]
        values = np.concatenate([values, np.array(own, np.uint64)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    return values, bounds


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of ``PLACES`` 16-bit minhashes per text that has a shingle."""
    at = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(at), PLACES), np.uint16)
    if len(at):
        for p in range(PLACES):
            least = np.minimum.reduceat(values * _SEED[p], at)
            out[:, p] = (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16)
    return out


def entries(signature: np.ndarray) -> np.ndarray:
    """The index entries of signatures: a number per chunk and place left out."""
    wide = signature.astype(np.uint64).reshape(len(signature), CHUNKS, CHUNK)
    out = np.empty((len(signature), CHUNKS, CHUNK), np.uint64)
    for left_out in range(CHUNK):
        packed = np.zeros((len(signature), CHUNKS), np.uint64)
        for k in range(CHUNK):
            if k != left_out:
                packed = (packed << np.uint64(16)) | wide[:, :, k]
        # Which chunk and place it is goes into the number; packed itself is exact.
        tag = (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(left_out + 1))
        out[:, :, left_out] = W.mix(packed ^ W.mix(tag)[None, :])
    return out.reshape(len(signature), PLACES)


def _sets(docs: DataFrame, text: str, size: int) -> DataFrame:
    """Per row: key, number of shingles, the set's 128-bit identity, and its signature."""

    def run(rows: pa.StructArray) -> dict[str, pa.Array]:
        values, bounds = shingles(utf8(rows, text), size)
        n = np.diff(bounds)
        some = n > 0
        mixed, other = W.mix(values), W.mix(values ^ np.uint64(0x5851F42D4C957F2D))
        sums = np.zeros((2, len(n)), np.uint64)
        if some.any():
            at = bounds[:-1][some]
            sums[0, some], sums[1, some] = np.add.reduceat(mixed, at), np.add.reduceat(other, at)
        signed = iter(signatures(values, bounds))
        return {
            "n": pa.array(n.astype(np.int64)),
            "s1": pa.array(sums[0].view(np.int64)), "s2": pa.array(sums[1].view(np.int64)),
            "signature": pa.array(
                [next(signed).tobytes() if x else None for x in some], pa.binary()),
        }

    return map_rows(docs, run, "n bigint, s1 bigint, s2 bigint, signature binary", ["key", "hash"])


def _full_sets(docs: DataFrame, size: int) -> DataFrame:
    """``node`` and ``body`` to ``node``, ``n`` and the shingle numbers ``set``."""

    def run(rows: pa.StructArray) -> dict[str, pa.Array]:
        values, bounds = shingles(utf8(rows, "body"), size)
        lists = pa.ListArray.from_arrays(
            pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
        return {"set": lists}

    return map_rows(docs, run, "set array<bigint>", ["node", "n"]).select("row.*", "set")


def _index(nodes: DataFrame) -> DataFrame:
    """``node``, ``signature`` to a row per entry: ``entry``, the ``place`` left out, ``node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = b"".join(batch.column(1).to_pylist())
                found = entries(np.frombuffer(raw, np.uint16).reshape(-1, PLACES))
                yield pa.RecordBatch.from_pydict({
                    "entry": pa.array(found.ravel().view(np.int64)),
                    "place": pa.array(np.tile(np.arange(PLACES, dtype=np.int16), len(found))),
                    "node": pa.array(np.repeat(batch.column(0).to_numpy(), PLACES))})

    return nodes.select("node", "signature").mapInArrow(
        run, "entry bigint, place smallint, node bigint")


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Sizes that leave room for a link."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").filter(_alike(F.col("na"), F.col("nb"), percent))
    common = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    both = both.select("a", "b", "na", "nb", common.alias("common"))
    union = F.col("na") + F.col("nb") - F.col("common")
    return both.filter(100 * F.col("common") >= percent * union).select("a", "b")


_BLOCK = "entry bigint, place smallint, x int, y int, own int, node bigint, root bigint, " \
    "signature binary"


def _blocks(members: DataFrame) -> DataFrame:
    """``members`` of an entry, dealt into blocks, repeated for each pair of blocks of the entry.

    An entry with at most ``BLOCK`` members, the usual case, is one block and is not repeated.
    """
    count = lookup(members.groupBy("entry").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    dealt = members.join(count, "entry").withColumn(
        "own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least("own", k).alias("x"), F.greatest("own", k).alias("y")))
    return dealt.withColumn("block", F.explode(pairs)).select(
        "entry", "place", "block.x", "block.y", "own", "node", "root", "signature")


def _together(blocks: DataFrame) -> DataFrame:
    """The rows of a block next to each other."""
    return blocks.repartition("entry", "x", "y").sortWithinPartitions("entry", "x", "y")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block, from batches in which they are next to each other."""
    held: list[pa.RecordBatch] = []
    at: tuple | None = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("entry", "x", "y")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and tuple(keys[:, a]) != at:
                yield held[0] if len(held) == 1 else pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            at = tuple(keys[:, a])
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


class _Block:
    """The members of one block (or of two, ``x`` and ``y``, that meet)."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        self.node, self.root, self.own = (
            rows.column(c).to_numpy() for c in ("node", "root", "own"))
        raw = b"".join(rows.column("signature").to_pylist())
        self.signature = np.frombuffer(raw, np.uint16).reshape(-1, PLACES)
        self.place, self.x, self.y = (rows.column(c)[0].as_py() for c in ("place", "x", "y"))

    def partners(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Members of other classes that ``k`` meets here, and how far their signatures are."""
        other = (self.own == self.y) & (self.root != self.root[k])
        if self.own[k] != self.x:
            other[:] = False
        other = np.flatnonzero(other)
        equal = self.signature[other] == self.signature[k]
        far = PLACES - equal.sum(1)
        near = far <= FAR
        return other[near], far[near]

    def first_here(self, k: int, other: np.ndarray) -> np.ndarray:
        """Whether this is the first of the entries that ``k`` and each other share."""
        equal = (self.signature[other] == self.signature[k]).reshape(-1, CHUNKS, CHUNK)
        wrong = CHUNK - equal.sum(2)
        chunk = (wrong <= 1).argmax(1)
        inside = equal[np.arange(len(other)), chunk]
        # Chunks that agree in all places are entered under each; the first counts.
        return chunk * CHUNK + np.where(inside.all(1), 0, inside.argmin(1)) == self.place

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each pair of different classes near enough once, at its first entry."""
        for k in range(len(self.node)):
            other, _ = self.partners(k)
            if self.x == self.y:
                other = other[self.root[other] > self.root[k]]
            if len(other):
                other = other[self.first_here(k, other)]
            if len(other):
                yield k, other


def _nearest_pairs(members: DataFrame) -> DataFrame:
    """``a`` < ``b`` and how ``far``: of each member, the nearest of another class in its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int, int]] = set()
        for rows in _groups(batches):
            block = _Block(rows)
            for k in range(rows.num_rows):
                other, far = block.partners(k)
                if len(other):
                    a, b = block.node[k], block.node[other[far.argmin()]]
                    found.add((min(a, b), max(a, b), int(far.min())))
            if len(found) > 100_000:
                yield table(found)
                found = set()
        yield table(found)

    def table(found: set) -> pa.RecordBatch:
        a, b, d = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_pydict({
            "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()),
            "far": pa.array(d, pa.int32())})

    return _together(_blocks(members)).mapInArrow(run, "a bigint, b bigint, far int")


def _all_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join the classes, from all candidate pairs of different classes.

    Blocks are looked at by signature first, to find the members with a candidate at all; only
    their full sets travel, and pairs are checked where the sets are and never become rows.
    """

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            keep = np.zeros(rows.num_rows, bool)
            for k, other in _Block(rows).pairs():
                keep[k] = keep[other] = True
            if keep.any():
                yield rows.filter(pa.array(keep))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            found = confirmed(_Block(rows), rows)
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def confirmed(block: _Block, rows: pa.RecordBatch) -> list[tuple[int, int]]:
        lists = rows.column("set")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        values = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        size, joined, out = np.diff(bounds), {}, []
        mark = np.zeros(values.max() + 1, np.int64)

        def root(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        for k, other in block.pairs():
            mark[values[bounds[k]:bounds[k + 1]]] = 1
            common = np.add.reduceat(mark[values], bounds[:-1])[other]
            mark[values[bounds[k]:bounds[k + 1]]] = 0
            for j in other[100 * common >= percent * (size[other] + size[k] - common)]:
                a, b = root(block.root[k]), root(block.root[j])
                if a != b:
                    joined[max(a, b)] = min(a, b)
                    out.append((block.node[k], block.node[j]))
        return out

    blocks = stage(_together(_blocks(members)).mapInArrow(wanted, _BLOCK))
    full = blocks.join(sets.select("node", "set"), "node").select(*blocks.columns, "set")
    return _together(full).mapInArrow(links, "a bigint, b bigint")


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of each node, its nearest pair."""
    one = F.min(F.struct("far", "b"))
    first = pairs.groupBy("a").agg(one.alias("p")).select("a", F.col("p.b").alias("b"))
    one = F.min(F.struct("far", "a"))
    second = pairs.groupBy("b").agg(one.alias("p")).select(F.col("p.a").alias("a"), "b")
    return first.unionByName(second).distinct()


def _body(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def near_classes(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """Per row: ``key``, ``hash`` (of its text), ``n_shingles``, ``class_key`` (the smallest key
    it is connected to) and ``kept`` (one row of each class: the first with that key).
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(key).alias("key"), _body(text).alias("body")).withColumn(
        "hash", F.xxhash64("body"))
    rows = stage(
        _sets(docs, "body", shingle).select("row.*", "n", "s1", "s2", "signature")
        .withColumn("id", F.monotonically_increasing_id()))
    some = rows.filter("n > 0")
    first = F.min(F.struct("id", "key", "hash", "signature"))
    nodes = stage(some.groupBy("n", "s1", "s2").agg(first.alias("f")).select(
        F.col("f.id").alias("node"), "n", "s1", "s2", "f.key", "f.hash", "f.signature"))

    index = stage(_index(nodes))
    hubs = lookup(index.groupBy("entry").agg(
        F.min("node").alias("hub"), F.max("node").alias("last"))
        .filter("hub < last").select("entry", "hub"))
    members = stage(index.join(hubs, "entry"))
    linked = stage(members.select("node").distinct().join(nodes, "node"))
    sets = stage(_full_sets(
        linked.select("node", "n", F.col("key").alias("k"), "hash").join(
            docs, F.col("k").eqNullSafe(docs["key"]) & (linked["hash"] == docs["hash"]))
        .select("node", "n", "body"), shingle))

    tries = members.filter("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("shared"))
    best = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("shared", "hub")))), 1, HUBS)
    tries = tries.groupBy("node").agg(best.alias("t")).select("node", F.explode("t").alias("t"))
    links = stage(_confirm(
        tries.select(F.col("node").alias("a"), F.col("t.hub").alias("b")), sets, percent))

    known = linked.select("node", "signature")

    def unsettled(links: DataFrame) -> DataFrame:
        """Members of the entries whose nodes belong to several classes."""
        entered = members.select("entry", "place", "node").join(
            components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = lookup(entered.groupBy("entry").agg(
            F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("entry"))
        return entered.join(mixed, "entry").join(known, "node")

    some_entries = unsettled(links).filter(F.col("place") < NEAREST_PLACES)
    pairs = _nearest(stage(_nearest_pairs(some_entries)))
    links = stage(links.unionByName(_confirm(pairs, sets, percent)))
    links = stage(links.unionByName(_all_links(unsettled(links), sets, percent)))

    roots = components(links)
    grouped = nodes.select("node", "n", "s1", "s2").join(roots, "node", "left").select(
        "n", "s1", "s2", F.coalesce("root", "node").alias("root"))
    some = stage(some.drop("signature").join(grouped, ["n", "s1", "s2"]).select(
        "id", "key", "hash", "n", "root"))
    order = F.struct(F.col("key").isNull(), "key", "id")
    least = lookup(some.groupBy("root").agg(F.min(order).alias("least")))
    some = some.join(least, "root").select(
        "key", "hash", F.col("n").alias("n_shingles"), F.col("least.key").alias("class_key"),
        (F.col("least.id") == F.col("id")).alias("kept"))
    none = rows.filter("n = 0").select(
        "key", "hash", F.col("n").alias("n_shingles"), F.col("key").alias("class_key"),
        F.lit(True).alias("kept"))
    return some.unionByName(none)


def near_unique(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with the columns of ``docs``.

    Texts without words have no class and all stay, but rows that repeat key and text are one.
    """
    classes = near_classes(docs, key=key, text=text, shingle=shingle, percent=percent)
    kept = stage(classes.filter("kept").select("key", "hash").distinct())
    rows = docs.select(
        F.struct("*").alias("row"), F.col(key).alias("k"), F.xxhash64(_body(text)).alias("h"))
    stay = rows.join(kept, F.col("k").eqNullSafe(F.col("key")) & (F.col("h") == F.col("hash")))
    # A kept key and text may stand in several rows, of which one stays.
    again = F.row_number().over(Window.partitionBy("k", "h").orderBy("k"))
    return stay.withColumn("again", again).filter("again = 1").select("row.*")
