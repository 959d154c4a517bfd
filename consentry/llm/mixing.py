"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). A cell's token weight starts as its tokens and
is raked: in turn, the weights are scaled so that their sums by source, by language and by topic
meet the target shares, until no sum is off by more than ``TOLERANCE``. Targets need not name every
value: a marginal is given as an exponent of the available share (1 keeps it, 0 makes all values
equal) with optional factors for single values.

Raked weights become keep probabilities: ``min(1, scale * weight / tokens)``, with one scale
calibrated so that the expected tokens are ``budget`` of those available. A document stays if a
keyed hash of its id and text, uniform on [0, 1), is below its cell's probability; so the choice is
the same whenever and wherever it is made.

Everything is DataFrame operations. Only cells are iterated over; texts are looked at once. The
cell table joins by its key: Spark broadcasts it if it is small and splits hot cells if not.

Cases: nulls of source and language are values of their own; a null or empty text has no tokens,
and a cell without tokens is kept whole, as it costs nothing; repeated rows share their hash and
stay or go together; marginals that contradict each other end after ``ROUNDS`` rounds at the
last weights, with the error reported; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.llm.common import WORD, prepare
from consentry.sources.staging import lookup, stage

TOLERANCE = 1e-4
ROUNDS = 40
#: The share of the budget that the expected tokens may be off.
EXACT = 1e-12

CELL = ("source", "lang", "topic")

#: Topics by the form of a text; the first that fits counts.
TOPICS = (
    ("licence", r"(?i)\blicen[cs]e|\bcopyright\b|all rights reserved"),
    ("contact", r"\w@[\w-]+\.\w|\+\d[\d ()-]{7,}|\b\d{1,3}(\.\d{1,3}){3}\b"),
    ("table", r"\S \| \S"),
    ("list", r"(?m)^\s*([-*]|\d+\.)\s"),
)
OTHER = "prose"


def topic(text: str) -> Column:
    out = None
    for name, pattern in TOPICS:
        hit = F.col(text).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(OTHER)


def tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


@dataclass(frozen=True)
class Target:
    """Target shares of a marginal: available share to ``power``, times a value's factor."""

    power: float = 1.0
    factors: Mapping[str, float] = field(default_factory=dict)

    def share(self, column: str, available: Column) -> Column:
        value = F.pow(available, F.lit(self.power))
        for name, factor in self.factors.items():
            value = F.when(F.col(column) == name, value * factor).otherwise(value)
        return F.when(available > 0, value).otherwise(0.0)


#: Sources and languages nearer to each other than they come; less boilerplate.
TARGETS = {
    "source": Target(0.5),
    "lang": Target(0.7),
    "topic": Target(1.0, {"licence": 0.5, "contact": 0.7}),
}


def cells(docs: DataFrame) -> DataFrame:
    """Rows and tokens of every cell of ``source``, ``lang``, ``topic``, ``n``."""
    return docs.groupBy(*CELL).agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))


def rake(counted: DataFrame, targets: Mapping[str, Target]) -> DataFrame:
    """``counted`` with ``weight``, a share of the mix, and ``error``, the last round's worst.

    Each step is one aggregation by a marginal and a join back, written, so that neither a hot
    value nor the number of cells meets in one task and the plan does not grow.
    """
    total = counted.agg(F.sum("tokens")).first()[0] or 1
    goals = {}
    for c in CELL:
        shares = counted.groupBy(c).agg(F.sum("tokens").cast("double").alias("t"))
        shares = shares.withColumn("t", targets[c].share(c, F.col("t")))
        whole = shares.agg(F.sum("t")).first()[0] or 1.0
        goals[c] = lookup(shares.select(F.col(c).alias("value"), (F.col("t") / whole).alias("goal")))
    fitted = counted.withColumn("weight", F.col("tokens").cast("double") / total)
    worst = 0.0
    for _ in range(ROUNDS):
        worst = 0.0
        for c in CELL:
            now = fitted.groupBy(F.col(c).alias("at")).agg(F.sum("weight").alias("now"))
            scales = goals[c].join(now, F.col("at").eqNullSafe(F.col("value"))).select(
                "value", F.abs(F.col("now") - F.col("goal")).alias("off"),
                F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("by"))
            fitted = stage(
                fitted.drop("off").join(scales, F.col(c).eqNullSafe(F.col("value")))
                .withColumn("weight", F.col("weight") * F.col("by")).drop("value", "by"))
            worst = max(worst, fitted.agg(F.max("off")).first()[0] or 0.0)
        if worst <= TOLERANCE:
            break
    return fitted.drop("off").withColumn("error", F.lit(worst))


def calibrated(fitted: DataFrame, budget: float) -> DataFrame:
    """``fitted`` with ``probability``: how likely a document of the cell stays."""
    ratio = F.col("weight") / F.col("tokens")
    some = fitted.filter((F.col("tokens") > 0) & (F.col("weight") > 0))
    goal = budget * (some.agg(F.sum("tokens")).first()[0] or 0)
    # The expected tokens are a concave function of the scale, linear between the scales at which a
    # cell is used up. So a step along its slope never goes too far, and ends exact.
    scale, left = 0.0, goal
    while left > goal * EXACT:
        had, full = F.col("tokens").cast("double"), F.col("weight") * scale
        got = some.agg(
            F.sum(F.least(had, full)).alias("tokens"),
            F.sum(F.when(had > full, F.col("weight"))).alias("slope")).first()
        left, before = goal - got.tokens, scale
        scale += max(0.0, left) / got.slope if got.slope else 0.0
        if scale == before:
            break
    probability = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), scale * ratio)).otherwise(1.0)
    return fitted.withColumn("probability", probability)


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the seed and the columns only."""
    bits = F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 52) - 1))
    return bits / F.lit(float(1 << 52))


def mix(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
    lang: str = "lang", targets: Mapping[str, Target] = TARGETS, budget: float = 0.8, seed: int = 1,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``row`` (the document, or its columns ``keep``), its cell, ``n`` (tokens), ``weight``,
    ``probability``, ``u`` and ``kept``."""
    prepare(docs.sparkSession)
    # Written once, so that the patterns and counts over the texts are not computed again.
    named = stage(docs.select(
        F.struct(*(keep or docs.columns)).alias("row"), F.col(source).alias("source"),
        F.col(lang).alias("lang"), topic(text).alias("topic"), tokens(text).alias("n"),
        uniform(seed, key, text).alias("u")))
    counted = stage(cells(named))
    chances = lookup(calibrated(rake(counted, targets), budget)).select(
        *[F.col(c).alias(f"c_{c}") for c in CELL], "weight", "probability")
    same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in CELL]
    return named.join(chances, same).drop(*[f"c_{c}" for c in CELL]).withColumn(
        "kept", F.col("u") < F.col("probability"))
