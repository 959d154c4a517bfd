"""Packing token sequences: linear grouping of large pieces, configurations, then best fit.

A document's ids are cut into pieces only where they exceed the capacity. Large pieces, those above a
fixed share of it, are ranked by length and cut into groups of equal cardinality; each length is
rounded up to the largest of its group, so only a few sizes are left. For these the driver optimises
how often each configuration (sizes that share a sequence) is used, by column generation: a linear
program whose new columns come from a knapsack over the sizes. Small pieces take part in it as room
of one unit size, so that room is left over where small pieces can use it. What rounding down the
solution leaves over, a few sequences at most, is packed by best fit. Then the actual pieces take the places
of their group by rank, and small pieces go, longest first, to the sequences where least room is
left over.

Everything the driver holds depends on the capacity only: a count per length, a count per room that
is left, and rank ranges as the plan. Pieces find their places through their rank among the pieces
of equal length, which is their number within the task that cut them plus a prefix sum over tasks.
Cut pieces and places are written, so a lost executor repeats one step at most.

Cases: a null text is an empty one (end id only); null and repeated keys are documents of their own;
a document of any length is cut into full pieces, the last of which may be shorter; pieces of equal
length are interchangeable; an empty table gives an empty result. Further columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from consentry.llm.common import prepare
from consentry.llm.tokens import Encoder, _joined
from consentry.sources.staging import lookup, stage

CAPACITY = 2048
#: Groups of equal cardinality that large lengths are rounded up within.
GROUPS = 64
#: The share by which more sequences than the least may be used for the rounded sizes.
GAP = 1e-3
#: A piece of at most ``capacity / SMALL_SHARE`` tokens is small.
SMALL_SHARE = 4
#: Configurations keep room for the small pieces in units of ``capacity / GRAIN_SHARE`` tokens.
GRAIN_SHARE = 16

_PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


class _Numbers:
    """Numbers rows of equal value from 0 on, over the batches of a task."""

    def __init__(self, top: int) -> None:
        self.block, self.seen = TaskContext.get().partitionId(), np.zeros(top + 1, np.int64)

    def columns(self, values: np.ndarray) -> dict[str, pa.Array]:
        order = np.argsort(values, kind="stable")
        used, first, count = np.unique(values[order], return_index=True, return_counts=True)
        number = np.empty(len(values), np.int64)
        number[order] = np.arange(len(values)) + np.repeat(self.seen[used] - first, count)
        self.seen[used] += count
        return {"block": pa.array(np.full(len(values), self.block), pa.int32()),
                "number": pa.array(number)}


def cut(
    docs: DataFrame, vocabulary: str, *, key: str, text: str, end_id: int, capacity: int,
    word_level: bool, ids: bool,
) -> DataFrame:
    """The pieces of all documents, with ``block`` and ``number`` among equal lengths of a block."""
    from tokenizers import Tokenizer

    content = Path(vocabulary).read_text()
    top = max(end_id, Tokenizer.from_str(content).get_vocab_size(with_added_tokens=True) - 1)
    width = 2 if top < 1 << 16 else 4
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, numbers = None, _Numbers(capacity)
        for batch in _joined(batches):
            encode = encode or Encoder(shared.value, width, word_level)
            flat, size = encode(batch.column(1), end_id)
            count = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, size[doc] - start)
            at = (np.cumsum(size) - size)[doc] + start
            wide = memoryview(flat.astype("<u4").tobytes())
            sums = [zlib.crc32(wide[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            out = {
                "key": batch.column(0).take(pa.array(doc)), "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start), "length": pa.array(length),
                "ids_crc32": pa.array(sums, pa.int64())}
            if ids:
                bounds = np.append(at, len(flat))
                out["ids"] = pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()), pa.array(flat.astype("i4")))
            yield pa.RecordBatch.from_pydict(out | numbers.columns(length))

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    key_type = rows.schema["key"].dataType.simpleString()
    more = ", ids array<int>" if ids else ""
    return rows.mapInArrow(run, f"key {key_type}, {_PIECE}{more}, block int, number bigint")


def ranked(numbered: DataFrame, value: str) -> tuple[DataFrame, dict[int, int]]:
    """A written table with ``rank`` among the rows of equal ``value``, and how many each value has."""
    counts = stage(numbered.groupBy(value, "block").agg(F.count("*").alias("n")))
    before = Window.partitionBy(value).orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = lookup(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    rows = numbered.join(bases, [value, "block"]).withColumn("rank", F.col("base") + F.col("number"))
    totals = {r[0]: r[1] for r in counts.groupBy(value).agg(F.sum("n")).collect()}
    return rows.drop("base", "block", "number"), totals


def rounded(counts: dict[int, int], groups: int) -> dict[int, int]:
    """How many lengths are rounded up to each size: ranks in ``groups`` runs of equal cardinality,
    each rounded up to its largest length. Runs of equal size are one."""
    lengths = sorted(counts)
    ends = np.cumsum([counts[x] for x in lengths])
    total, out, done = int(ends[-1]) if lengths else 0, {}, 0
    for g in range(min(groups, total)):
        last = (g + 1) * total // min(groups, total)
        size = lengths[int(np.searchsorted(ends, last - 1, "right"))]
        out[size] = out.get(size, 0) + last - done
        done = last
    return out


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size fill one sequence at the greatest worth: an unbounded knapsack."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes[0]), capacity + 1):
        fit = int(np.searchsorted(sizes, room, "right"))
        gains = best[room - sizes[:fit]] + worth[:fit]
        k = int(gains.argmax())
        if gains[k] > best[room - 1]:
            best[room], chosen[room] = gains[k], k
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes)), capacity
    while room:
        k = chosen[room]
        if k < 0:
            room -= 1
        else:
            pattern[k] += 1
            room -= int(sizes[k])
    return pattern


def configurations(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations (size to how many) with how often each is used; together exactly ``demand``."""
    sizes = np.array(sorted(demand), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[s] for s in sizes.tolist()], float)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(50 * len(sizes) + 100):  # a bound for steps that gain nothing
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        pattern = _best_pattern(sizes, worth, capacity)
        # No solution uses fewer sequences than this one divided by the worth of the best pattern.
        if worth @ pattern <= 1 + GAP:
            break
        used = np.maximum(np.linalg.solve(basis, need), 0)
        change = np.linalg.solve(basis, pattern)
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    times = np.floor(np.maximum(np.linalg.solve(basis, need), 0) + 1e-7).astype(np.int64)
    columns = np.rint(basis).astype(np.int64)
    left = need.astype(np.int64) - columns @ times
    for k in range(len(times)):  # a solution rounded the wrong way gives some back
        while times[k] and (left[columns[:, k] > 0] < 0).any():
            times[k] -= 1
            left += columns[:, k]
    out = [
        ({int(s): int(n) for s, n in zip(sizes, columns[:, k]) if n}, int(times[k]))
        for k in range(len(times)) if times[k]]
    rest = {int(s): int(n) for s, n in zip(sizes, left) if n}
    return out + _best_fit_patterns(rest, capacity)


def _best_fit_patterns(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    steps, opened = best_fit(demand, {}, capacity)
    held: list[dict[int, int]] = [{} for _ in range(opened)]
    for s in steps:
        for k in range(s.times):
            held[s.first + k][s.length] = held[s.first + k].get(s.length, 0) + s.each
    return [(pattern, 1) for pattern in held]


@dataclass(frozen=True)
class Step:
    """``times * each`` pieces of ``length``, from rank ``rank`` on, go to ``times`` sequences that
    had ``room`` left at first, from the sequence ranked ``first`` on; ``each`` to one, at ``offset``."""

    length: int
    rank: int
    room: int
    first: int
    times: int
    each: int
    offset: int


def best_fit(
    pieces: dict[int, int], rooms: dict[int, int], capacity: int
) -> tuple[list[Step], int]:
    """Pieces, longest first, each to the sequence with the least room that holds it.

    Sequences of equal room are ranges of ranks that are dealt with at once, so the steps depend on
    the capacity and not on how many pieces there are. Also returns how many sequences are new;
    those have ``room`` = ``capacity`` and ranks of their own.
    """
    now: dict[int, list[tuple[int, int, int]]] = {}  # room left: (room at first, first rank, count)
    for room, n in rooms.items():
        if n:
            now.setdefault(room, []).append((room, 0, n))
    steps, opened = [], 0
    for length in sorted(pieces, reverse=True):
        rank, left = 0, pieces[length]
        while left:
            room = min((r for r in now if r >= length), default=None)
            if room is None:
                per = capacity // length
                n = -(-left // per)
                now[capacity] = [(capacity, opened, n)]
                opened, room = opened + n, capacity
            origin, first, n = now[room].pop()
            if not now[room]:
                del now[room]
            each = min(room // length, left)
            times = min(n, left // each)
            steps.append(Step(length, rank, origin, first, times, each, capacity - room))
            rank, left = rank + times * each, left - times * each
            now.setdefault(room - each * length, []).append((origin, first, times))
            if times < n:
                now.setdefault(room, []).append((origin, first + times, n - times))
    return steps, opened


def _large_plan(
    counts: dict[int, int], groups: int, capacity: int, small_tokens: int = 0
) -> tuple[np.ndarray, int]:
    """Rank ranges of the large pieces, ascending by length, and how many sequences they take.

    A range is (first rank, first sequence, pieces a sequence).
    """
    demand = rounded({n: c for n, c in counts.items() if n < capacity}, groups)
    total = sum(demand.values())
    start = dict(zip(sorted(demand), np.cumsum([0, *(demand[s] for s in sorted(demand))]).tolist()))
    grain = max(1, capacity // GRAIN_SHARE)
    if demand and small_tokens:
        demand[grain] = -(-small_tokens // grain)
    ranges, sequence = [], 0
    for pattern, times in configurations(demand, capacity):
        held = {size: each for size, each in pattern.items() if size in start}
        for size, each in held.items():
            ranges.append((start[size], sequence, each))
            start[size] += each * times
        sequence += times if held else 0
    full = counts.get(capacity, 0)
    if full:  # full pieces come last and are sequences of their own
        ranges.append((total, sequence, 1))
    return np.array(sorted(ranges), np.int64).reshape(-1, 3), sequence + full


def _bases(counts: dict[int, int], top: int) -> np.ndarray:
    """For each length how many pieces are shorter."""
    each = np.zeros(top + 2, np.int64)
    for length, n in counts.items():
        each[length + 1] = n
    return np.cumsum(each)


def _with(df: DataFrame, added: str, fn) -> DataFrame:
    """``df`` with further columns, made by ``fn`` from ``length`` and ``rank``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.schema.get_field_index(c) for c in ("length", "rank")]
            for name, values in fn(*[batch.column(k).to_numpy() for k in at]).items():
                batch = batch.append_column(name, pa.array(values, pa.int64()))
            yield batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, {added}")


def _placed_large(pieces: DataFrame, plan: np.ndarray, bases: np.ndarray) -> DataFrame:
    def sequences(length: np.ndarray, rank: np.ndarray) -> dict[str, np.ndarray]:
        at = bases[length] + rank
        first, sequence, each = plan[np.searchsorted(plan[:, 0], at, "right") - 1].T
        return {"sequence_id": sequence + (at - first) // each}

    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = _with(pieces, "sequence_id bigint", sequences)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))


def _rooms(large: DataFrame, capacity: int) -> tuple[DataFrame, dict[int, int]]:
    """Sequences with room left, ranked among those of equal room; how many each room has."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(capacity)
        for batch in batches:
            rooms = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_pydict(
                {"sequence_id": batch.column(0), "room": batch.column(1), **numbers.columns(rooms)})

    rooms = large.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room"))
    return ranked(stage(rooms.filter("room > 0").mapInArrow(
        number, "sequence_id bigint, room bigint, block int, number bigint")), "room")


def _placed_small(
    pieces: DataFrame, counts: dict[int, int], rooms: DataFrame, room_counts: dict[int, int],
    taken: int, capacity: int,
) -> DataFrame:
    bases = _bases(counts, capacity)
    steps = best_fit(counts, room_counts, capacity)[0]
    plan = np.array(sorted(
        (int(bases[s.length]) + s.rank, s.room, s.first, s.each, s.offset) for s in steps
    ), np.int64).reshape(-1, 5)

    def places(length: np.ndarray, rank: np.ndarray) -> dict[str, np.ndarray]:
        at = bases[length] + rank
        first_piece, room, first, each, offset = plan[
            np.searchsorted(plan[:, 0], at, "right") - 1].T
        nth = at - first_piece
        return {"room": room, "place": first + nth // each, "offset": offset + nth % each * length}

    placed = _with(pieces, "room bigint, place bigint, offset bigint", places).drop("rank")
    opened = F.col("room") == capacity
    new = placed.filter(opened).withColumn("sequence_id", F.col("place") + taken)
    old = placed.filter(~opened).join(rooms.withColumnRenamed("rank", "place"), ["room", "place"])
    return new.drop("room", "place").unionByName(old.drop("room", "place"))


def pack(
    docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0,
    capacity: int = CAPACITY, groups: int = GROUPS, word_level: bool = False, ids: bool = False,
) -> DataFrame:
    """Per piece: ``key``, ``piece``, ``start`` (ids of its document before it), ``length``,
    ``ids_crc32``, its ``sequence_id`` and the ``offset`` there; with ``ids`` also the ids."""
    prepare(docs.sparkSession)
    pieces, counts = ranked(stage(cut(
        docs, vocabulary, key=key, text=text, end_id=end_id, capacity=capacity,
        word_level=word_level, ids=ids)), "length")
    limit = capacity // SMALL_SHARE
    big = {n: c for n, c in counts.items() if n > limit}
    small = {n: c for n, c in counts.items() if n <= limit}
    plan, taken = _large_plan(big, groups, capacity, sum(n * c for n, c in small.items()))
    large = stage(_placed_large(pieces.filter(F.col("length") > limit), plan, _bases(big, capacity)))
    rooms, room_counts = _rooms(large, capacity)
    rest = _placed_small(
        pieces.filter(F.col("length") <= limit), small, rooms, room_counts, taken, capacity)
    return large.drop("rank").unionByName(rest)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id`` and its ``ids``, of what ``pack`` gave with ``ids``.

    A sequence has no more pieces than ids, so what comes together is bounded by the capacity.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
