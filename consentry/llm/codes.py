"""Vector code compression: product codes from exact integer k-means.

A vector's components become integers, the vector is cut into parts, and each part is named by its
nearest codebook entry. All distances are exact: integers are broken into limbs so small that a
float64 matrix product of limbs stays below 2^53 and is therefore exact, the products are put
together again in int64, and the first least distance wins. Integers that one limb holds need one
product, wider ones a product per pair of limbs. Vectors too large for int64 distances go through
Python's integers instead, with the same result.

The driver holds the codebooks, which are ``ENTRIES`` vectors at most whatever the input. Each round
reads the vectors once, and a task sends one row of sums per codebook entry. Sums are exact, so
neither the partitioning nor a repeated task changes a codebook.

Cases: a row whose vector is null or holds a null or non-finite component is left out; null keys
come after all others as first entries; rows that repeat a key are vectors of their own, ordered by
their components; a vector shorter than the longest, and a length that parts do not divide, counts
as ended by zeros; with fewer vectors than entries the codebooks are shorter; an error beyond 64
bits is null; an empty table gives an empty result. Further columns never clash, as a row is kept
whole inside ``row``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.llm.common import map_rows, prepare
from consentry.sources.staging import lookup

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Sums leave a task in limbs of so many bits, so that 2^23 tasks add up within 64 bits.
SUM_BITS = 40

_SUMS = "part int, entry int, limb int, n bigint, sums array<bigint>"


def usable(vector: str) -> Column:
    """The vector is there, and all of its components are finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))
    return F.coalesce(F.col(vector).isNotNull() & finite, F.lit(False))


def narrow(size: int) -> int:
    """The largest integer for which distances of parts of ``size`` components fit in 62 bits."""
    return int(2**30 / math.sqrt(max(1, size)))


def _floor_scaled(x: float) -> int:
    top, bottom = float(x).as_integer_ratio()
    return top * SCALE // bottom


def integers(vectors: pa.Array, size: int) -> np.ndarray:
    """floor(1024 x) of all components, a row per vector; Python integers if any exceeds ``narrow``."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(vectors)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    width = PARTS * size
    if len(flat) and np.abs(flat).max() > narrow(size) / SCALE - 1:
        out = np.zeros((len(vectors), width), object)
        out[row, at] = [_floor_scaled(x) for x in flat]
        return out
    out = np.zeros((len(vectors), width), np.int64)
    out[row, at] = np.floor(flat * SCALE)
    return out


def limb_bits(size: int) -> int:
    """Bits of a limb, sign included: ``size`` products of two limbs add up to less than 2^53."""
    return (52 - math.ceil(math.log2(max(1, size)))) // 2 + 1


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """``x`` as float64 digits to the base 2^bits, lowest first; each from -2^(bits-1) below 2^(bits-1)."""
    half, out = 1 << (bits - 1), []
    while True:
        low = ((x + half) & ((1 << bits) - 1)) - half
        out.append(low.astype(np.float64))
        x = (x - low) >> bits
        if not x.any():
            return out


def products(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """x @ y.T in int64. Sums may pass 64 bits on the way; the result is exact if it fits itself."""
    out = np.zeros((len(x), len(y)), np.int64)
    right = limbs(y, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            out += (a @ b.T).astype(np.int64) << min(63, bits * (i + j))
    return out


def nearest(x: np.ndarray, entries: np.ndarray, bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first nearest entry and the squared distance to it.

    ``bits`` sets the width of a limb, for tests; left out, it is the widest that is exact.
    """
    if x.dtype == object or entries.dtype == object:
        far = np.empty((len(x), len(entries)), object)
        for k, entry in enumerate(entries.astype(object)):
            far[:, k] = ((x.astype(object) - entry) ** 2).sum(axis=1)
        best = np.array([min(range(len(r)), key=r.__getitem__) for r in far], np.int64)
        return best, far[np.arange(len(x)), best]
    cross = products(x, entries, bits or limb_bits(x.shape[1]))
    score = (entries * entries).sum(axis=1) - 2 * cross
    best = score.argmin(axis=1)
    return best, (x * x).sum(axis=1) + score[np.arange(len(x)), best]


@dataclass
class Codebooks:
    """Per part the entries, as integers, and how many components a part has."""

    parts: list[np.ndarray]
    size: int

    def split(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for p, entries in enumerate(self.parts):
            yield x[:, p * self.size:(p + 1) * self.size], entries

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        text = ",".join(str(int(v)) for entries in self.parts for v in entries.ravel())
        return hashlib.sha256(text.encode()).hexdigest()


def _array(rows: list[list[int]], size: int) -> np.ndarray:
    fits = all(abs(v) <= narrow(size) for r in rows for v in r)
    return np.array(rows, np.int64 if fits else object).reshape(len(rows), size)


class _Sums:
    """Counts and sums of the parts dealt to each entry, over the batches of a task."""

    def __init__(self, books: Codebooks) -> None:
        self.books = books
        shape = (PARTS, len(books.parts[0]))
        self.counts = np.zeros(shape, np.int64)
        self.sums = np.zeros((*shape, books.size), np.int64)

    def add(self, x: np.ndarray) -> None:
        if x.dtype == object and self.sums.dtype != object:
            self.sums = self.sums.astype(object)
        for p, (part, entries) in enumerate(self.books.split(x)):
            code = nearest(part, entries)[0]
            order = np.argsort(code, kind="stable")
            used, first, count = np.unique(code[order], return_index=True, return_counts=True)
            self.counts[p, used] += count
            if part.shape[1]:
                self.sums[p, used] += np.add.reduceat(part[order], first, axis=0)

    def batches(self) -> Iterator[pa.RecordBatch]:
        part, entry = np.nonzero(self.counts)
        left, limb = self.sums[part, entry], 0
        n = self.counts[part, entry]
        while len(part):
            size = abs(left)
            low = size & ((1 << SUM_BITS) - 1)
            sign = np.where(left < 0, -1, 1)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()),
                "limb": pa.array(np.full(len(part), limb), pa.int32()), "n": pa.array(n),
                "sums": pa.array((sign * low).astype(np.int64).tolist(), pa.list_(pa.int64()))})
            left, n, limb = sign * (size >> SUM_BITS), np.zeros_like(n), limb + 1
            if not left.any():
                return


def _refined(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round: each entry the floor of the mean of the parts nearest to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(books)
        for batch in batches:
            if batch.num_rows:
                sums.add(integers(batch.column(0), books.size))
        yield from sums.batches()

    totals = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(books.size)]
    rows = (
        vectors.mapInArrow(run, _SUMS).groupBy("part", "entry", "limb")
        .agg(F.sum("n").alias("n"), *totals).collect()
    )
    counts: dict[tuple[int, int], int] = {}
    sums: dict[tuple[int, int], list[int]] = {}
    for r in rows:
        at = (r.part, r.entry)
        counts[at] = counts.get(at, 0) + r.n
        held = sums.setdefault(at, [0] * books.size)
        for i in range(books.size):
            held[i] += r[f"s{i}"] << (SUM_BITS * r.limb)
    new = []
    for p, entries in enumerate(books.parts):
        means = [list(map(int, e)) for e in entries]
        for k in range(len(means)):
            if (p, k) in counts:
                means[k] = [s // counts[p, k] for s in sums[p, k]]
        new.append(_array(means, books.size))
    return Codebooks(new, books.size)


def fit(
    df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS
) -> Codebooks | None:
    """Codebooks of ``rounds`` rounds from the vectors of the smallest keys; none without vectors.

    ``df`` is read once a round: stage it first if it is dear to compute.
    """
    prepare(df.sparkSession)
    kept = df.filter(usable(vector)).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    size = -(-longest // PARTS)
    first = kept.orderBy(F.col("key").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    rows = [[*map(_floor_scaled, r.vector), *[0] * (PARTS * size - len(r.vector))] for r in first]
    books = Codebooks(
        [_array([r[p * size:(p + 1) * size] for r in rows], size) for p in range(PARTS)], size)
    for _ in range(rounds):
        books = _refined(kept.select("vector"), books)
    return books


def _long(value: int) -> int | None:
    return int(value) if value < 1 << 63 else None


def encode(
    df: DataFrame, books: Codebooks, *, vector: str = "embedding", keep: Sequence[str] | None = None
) -> DataFrame:
    """``row``, its ``code`` (two hex digits a part) and ``error``, the squared distance to what the
    code stands for."""

    def run(rows: pa.StructArray) -> dict[str, pa.Array]:
        x = integers(rows.field(vector), books.size)
        codes = np.zeros((len(x), PARTS), np.uint8)
        error = np.zeros(len(x), object)
        for p, (part, entries) in enumerate(books.split(x)):
            codes[:, p], far = nearest(part, entries)
            error += far
        text = codes.tobytes().hex()
        return {
            "code": pa.array([text[a:a + 2 * PARTS] for a in range(0, len(text), 2 * PARTS)],
                             pa.string()),
            "error": pa.array([_long(e) for e in error], pa.int64())}

    prepare(df.sparkSession)
    return map_rows(df.filter(usable(vector)), run, "code string, error bigint", keep)


def decode(df: DataFrame, books: Codebooks, *, code: str = "code") -> DataFrame:
    """``df`` with ``decoded``: the vector that a code stands for, padded as when it was coded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                None if text is None else [
                    float(v) / SCALE for p, k in enumerate(bytes.fromhex(text))
                    for v in books.parts[p][k]]
                for text in batch.column(batch.schema.get_field_index(code)).to_pylist()]
            yield batch.append_column("decoded", pa.array(rows, pa.list_(pa.float64())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, decoded array<double>")


def with_label_error(encoded: DataFrame, label: str) -> DataFrame:
    """``encoded`` (``label`` and ``error``) with the errors of its label added up; null labels are one.

    Labels may be many, or one label may hold a third of all rows: sums are formed before the
    shuffle and written, so that the join is broadcast by their size or else can be split.
    """
    known = F.count("error") == F.count(F.lit(1))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = lookup(
        encoded.groupBy(F.col(label).alias("_label")).agg(
            F.when(known, total.try_cast("bigint")).alias("label_error")))
    return encoded.join(sums, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
