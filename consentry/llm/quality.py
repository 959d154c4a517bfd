"""Quality by regularised quadratic discriminant analysis over statistics of the text.

Each text becomes ``FEATURES``, transformed towards normality. Per class, the mean and the
covariance come from sums over *all* labelled training rows, added up by Spark (a few hundred
numbers reach the driver, however many rows there are). A class covariance is shrunk towards the
pooled one and then towards a multiple of the identity. Its Cholesky factor is inverted once and
kept in the model; a score is the logistic of the difference of the classes' log densities, each a
Mahalanobis distance by that factor plus its log determinant and log prior.

Cases: null and empty texts score on the statistics of an empty text; rows without a label (or with
one other than 0 and 1) are not learned from; a row labelled twice counts twice; if a class has no
training row, every score is 0.5, so that nothing is rejected; extra columns are kept.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.llm.common import map_rows, prepare, utf8

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "beyond_ascii", "mark", "bar",
    "bang", "other_punctuation", "line_break", "distinct_words", "repeated_words",
    "bare_marks", "distinct_lines",
)
#: Share of the pooled covariance in a class covariance, and of the identity in the result.
POOLED = 0.3
IDENTITY = 0.02

_MARKS = [ord(c) for c in "#$%&*~^_=+<>@\\"]
_PUNCTUATION = [ord(c) for c in ".,;:?'\"()[]{}/-`"]


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of one text, in the order of ``FEATURES``."""
    text = text or b""
    words = text.split()
    # Added sizes keep a single mark or repeated word of a short text from weighing much.
    n, w = len(text) + 60, len(words) + 12
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x]
    repeats = sum(map(operator.eq, words, words[1:]))
    bare = sum(1 for x in words if len(x) == 1 and not (x.isalnum() or x > b"\x7f"))
    shares = (
        counts[65:91].sum() / n, counts[48:58].sum() / n, counts[128:].sum() / n,
        counts[_MARKS].sum() / n, counts[124] / n, counts[33] / n, counts[_PUNCTUATION].sum() / n,
        counts[10] / n, (len(words) - len(set(words))) / w, repeats / w, bare / w,
        (len(lines) - len(set(lines))) / (len(lines) + 4),
    )
    sizes = [np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(text) / max(1, len(words)))]
    return [*map(float, sizes), *(float(np.sqrt(s)) for s in shares)]


def _matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(FEATURES))


def _list(x: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(x) + 1, dtype="i4") * len(FEATURES)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))


def features(
    docs: DataFrame, *, text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """``row`` (the document, or its columns ``keep``) and ``features``."""
    prepare(docs.sparkSession)

    def run(rows: pa.StructArray) -> dict[str, pa.Array]:
        return {"features": _list(_matrix(utf8(rows, text)))}

    return map_rows(docs, run, "features array<double>", keep)


@dataclass(frozen=True)
class Model:
    """Per class (0, then 1): mean, inverse Cholesky factor and constant. Empty: no model."""

    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()
    constants: tuple[float, ...] = ()

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), 0.5)
        density = [
            c - 0.5 * (((x - m) @ f.T) ** 2).sum(1)
            for m, f, c in zip(self.means, self.factors, self.constants)
        ]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(
    labelled: DataFrame, *, label: str = "label", pooled: float = POOLED,
    identity: float = IDENTITY,
) -> Model:
    """Learn from ``features`` and ``label``, over all rows."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col("features")[i] for i in range(d)]
    sums = labelled.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)],
        *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs])
    found = {int(r.label): r for r in sums.collect()}
    if set(found) != {0, 1}:
        return Model()
    count, mean, scatter = {}, {}, {}
    for k, r in found.items():
        count[k], mean[k] = r.n, np.array([r[f"s{i}"] for i in range(d)]) / r.n
        product = np.zeros((d, d))
        for i, j in pairs:
            product[i, j] = product[j, i] = r[f"p{i}_{j}"]
        scatter[k] = product - r.n * np.outer(mean[k], mean[k])
    total = count[0] + count[1]
    common = (scatter[0] + scatter[1]) / total
    # In units of the pooled deviation, so that the identity treats all statistics alike.
    unit = np.sqrt(np.maximum(np.diag(common), 1e-9))
    common = common / np.outer(unit, unit)
    factors, constants = [], []
    for k in (0, 1):
        own = scatter[k] / count[k] / np.outer(unit, unit)
        cov = (1 - pooled) * own + pooled * common
        scale = max(float(np.trace(cov)) / d, 1e-6)
        cov = (1 - identity) * cov + identity * scale * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower) / unit)
        constants.append(float(-np.log(np.diag(lower)).sum() + np.log(count[k] / total)))
    return Model((mean[0], mean[1]), tuple(factors), tuple(constants))


def score(
    df: DataFrame, model: Model, *, text: str | None = None, keep: Sequence[str] | None = None
) -> DataFrame:
    """``row`` and ``score``, of a text column or else of a column ``features``."""

    def run(rows: pa.StructArray) -> dict[str, pa.Array]:
        if text is not None:
            x = _matrix(utf8(rows, text))
        else:
            flat = rows.field("features").flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(-1, len(FEATURES))
        return {"score": pa.array(model.scores(x))}

    return map_rows(df, run, "score double", keep)


def accepted(score_column: str = "score") -> Column:
    return F.col(score_column) >= 0.5
