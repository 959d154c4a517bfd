"""Language identification by nearest centroid over TF-IDF vectors of byte n-grams.

A text becomes lower-case letters with single spaces; its two- and three-byte grams are counted in
``BINS`` hashed bins, weighted by log frequency and inverse document frequency, and the vector is
normalised. Document frequencies are counted over *all* training rows. Per language, spherical
k-means places ``CENTROIDS`` centroids, fitted on ``SAMPLE`` distinct texts a language in
expectation (those with the smallest hash), or all if there are fewer, one group per language. A text gets the language of the
centroid with the greatest cosine. It is *rejected* when that cosine is below what nearly all
training texts of the language's sample reach (``QUANTILE``, less ``MARGIN``).

Cases: null texts and texts without a letter are ``und`` with score 0 and rejected; without
training rows every text is; rows with a null language are not learned from; a language with fewer
texts than centroids gets as many as it has; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consentry.llm.common import map_rows, prepare, utf8

BINS = 1 << 12
CENTROIDS = 3
SAMPLE = 400
ROUNDS = 12
QUANTILE = 0.005
MARGIN = 0.1
UNKNOWN = "und"

#: Letters in lower case; bytes beyond ASCII stay; the rest becomes a space.
_LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
#: Bytes whose grams are counted at once; a long text is counted piece by piece, whole.
_PIECE = 1 << 20


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    plain = text.translate(_LETTERS)
    if any(0x61 <= c <= 0x7A for c in plain[:64]) or plain.translate(
            None, bytes(c for c in range(256) if not 0x61 <= c <= 0x7A)):
        return True
    return any(c.isalpha() for c in text.decode())


def counts(text: bytes | None) -> np.ndarray:
    """How often the grams of each bin occur."""
    out = np.zeros(BINS, np.float64)
    if not text:
        return out
    plain = b" " + b" ".join(text.translate(_LETTERS).split()) + b" "
    for at in range(0, len(plain), _PIECE):
        b = np.frombuffer(plain[at:at + _PIECE + 2], np.uint8).astype(np.uint32)
        two = b[:-1] << np.uint32(8) | b[1:]
        three = two[:-1] << np.uint32(8) | b[2:]
        # The last gram of a piece starts the next one.
        more = at + _PIECE < len(plain)
        two = two[:_PIECE] if more else two
        for grams, salt in ((two, 0x9E3779B1), (three[:_PIECE] if more else three, 0x85EBCA6B)):
            bins = (grams + np.uint32(salt >> 7)) * np.uint32(salt) >> np.uint32(20)
            out += np.bincount(bins, minlength=BINS)
    return out


def vectors(texts: Sequence[bytes | None], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors, a row per text; empty texts are zero."""
    x = np.array([np.log1p(counts(t)) for t in texts], np.float32).reshape(-1, BINS) * idf
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def clustered(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids by spherical k-means, started at texts far from each other."""
    centres = [x.mean(0)]
    while len(centres) <= k:
        near = (x @ np.array(centres).T).max(1)
        centres.append(x[near.argmin()])
    c = np.array(centres[1:])
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        for j in range(k):
            if (own == j).any():
                c[j] = x[own == j].mean(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass(frozen=True)
class Model:
    """Inverse document frequencies; centroids with their languages; least cosines."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: tuple[str, ...]
    least: dict[str, float]

    def predict(self, texts: Sequence[bytes | None]) -> list[tuple[str, float, bool]]:
        if not self.languages:
            return [(UNKNOWN, 0.0, True)] * len(texts)
        cosines = vectors(texts, self.idf) @ self.centroids.T
        out = []
        for text, row in zip(texts, cosines):
            best = int(row.argmax())
            lang, score = self.languages[best], float(np.clip(row[best], 0, 1))
            known = has_letter(text)
            out.append((lang, score, score < self.least[lang]) if known else (UNKNOWN, 0.0, True))
        return out


def _frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each bin occurs, over all rows; and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BINS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                seen += counts(t) > 0
                n += 1
        yield pa.RecordBatch.from_pydict({
            "bin": pa.array(np.arange(-1, BINS, dtype=np.int32)),
            "n": pa.array(np.concatenate([[n], seen]))})

    found = docs.select(text).mapInArrow(run, "bin int, n bigint").groupBy("bin").agg(
        F.sum("n").alias("n")).collect()
    by_bin = {r.bin: r.n for r in found}
    return np.array([by_bin.get(k, 0) for k in range(BINS)]), by_bin.get(-1, 0)


def fit(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", centroids: int = CENTROIDS,
    sample: int = SAMPLE,
) -> Model:
    """Learn from all rows with a language; centroids from at most about ``sample`` of each."""
    spark = prepare(docs.sparkSession)
    docs = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"))
    seen, n = _frequencies(docs, "text")
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    shared = spark.sparkContext.broadcast(idf)
    # Copies of a text share its hash, so the share is one of the distinct texts.
    share = {r.lang: min(1.0, sample / r.n) for r in docs.groupBy("lang").agg(
        F.count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not share:
        return Model(idf, np.zeros((0, BINS)), (), {})
    keep = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    u = (F.xxhash64("text", F.lit("language")).bitwiseAND(F.lit((1 << 52) - 1))) / (1 << 52)
    # One copy of a text is enough, and keeps a group's size bounded.
    chosen = docs.filter(u < keep[F.col("lang")]).distinct()

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        x = vectors([t.encode() for t in group["text"]], shared.value)
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "least": [], "centroid": []})
        c = clustered(x, min(centroids, len(x)))
        least = float(np.quantile((x @ c.T).max(1), QUANTILE)) - MARGIN
        return pd.DataFrame({
            "lang": group["lang"].iloc[0], "least": least, "centroid": [v.tolist() for v in c]})

    found = sorted(chosen.groupBy("lang").applyInPandas(
        cluster, "lang string, least double, centroid array<float>").collect(),
        key=lambda r: (r.lang, r.centroid))
    return Model(
        idf, np.array([r.centroid for r in found], np.float32).reshape(-1, BINS),
        tuple(r.lang for r in found), {r.lang: r.least for r in found})


def predict(
    docs: DataFrame, model: Model, *, text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """``row`` (or its columns ``keep``), ``lang_pred``, ``score`` (a cosine) and ``rejected``."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(rows: pa.StructArray) -> dict[str, pa.Array]:
        found = shared.value.predict(utf8(rows, text))
        lang, score, rejected = zip(*found) if found else ((), (), ())
        return {
            "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()),
            "rejected": pa.array(rejected, pa.bool_())}

    return map_rows(docs, run, "lang_pred string, score double, rejected boolean", keep)
