"""Isolation forest (Liu, Ting and Zhou, ICDM 2008) as Spark jobs.

Training draws one sample per tree by hash, so only ``trees * sample`` rows or so are shuffled and
the model does not depend on how the data is partitioned. Each tree is grown in its own small
group. Scoring is a map over Arrow batches with the broadcast trees.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from consentry.sources.staging import lookup, stage

# Executors need not have this package installed to run the functions below.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODES_SCHEMA = "tree int, node int, feature int, threshold double, path double"
_EULER = 0.5772156649015329
_MARGIN = 1.75
_LAST_VALUES = 4096


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of ``n`` keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


def grow(points: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """One tree as ``(node, feature, threshold, path)``; node i has children 2i+1 and 2i+2.

    Leaves have feature -1 and the path length a point ending there is given.
    """
    rows, todo = [], [(0, 0, points)]
    while todo:
        node, depth, part = todo.pop()
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (None, None)
        splittable = np.flatnonzero(low < high) if len(part) > 1 else np.empty(0, dtype=int)
        if depth == max_depth or not len(splittable):
            rows.append((node, -1, 0.0, depth + average_path(len(part))))
            continue
        f = int(rng.choice(splittable))
        cut = float(rng.uniform(low[f], high[f]))
        rows.append((node, f, cut, 0.0))
        left = part[:, f] <= cut
        todo += [(2 * node + 2, depth + 1, part[~left]), (2 * node + 1, depth + 1, part[left])]
    return rows


def path_lengths(points: np.ndarray, trees: dict[str, np.ndarray], max_depth: int) -> np.ndarray:
    """Mean path length of each point over all trees."""
    total = np.zeros(len(points))
    row = np.arange(len(points))
    for feature, threshold, path in zip(trees["feature"], trees["threshold"], trees["path"]):
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(max_depth):
            f = feature[node]
            right = points[row, np.maximum(f, 0)] > threshold[node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        total += path[node]
    return total / len(trees["path"])


@dataclass
class IsolationForest:
    """A fitted forest. ``nodes`` has at most ``trees * 2 * sample`` rows, whatever the data."""

    features: tuple[str, ...]
    nodes: pd.DataFrame
    sample: int
    max_depth: int
    threshold: float = float("nan")
    trained_on: int = 0
    _shared: dict = field(default_factory=dict, repr=False)

    def _trees(self) -> dict[str, np.ndarray]:
        shape = (int(self.nodes["tree"].max()) + 1, 2 ** (self.max_depth + 1) - 1)
        out = {
            "feature": np.full(shape, -1, dtype=np.int64),
            "threshold": np.zeros(shape),
            "path": np.zeros(shape),
        }
        at = (self.nodes["tree"].to_numpy(), self.nodes["node"].to_numpy())
        for name, values in out.items():
            values[at] = self.nodes[name].to_numpy()
        return out

    def _broadcast(self, spark: SparkSession):
        app = spark.sparkContext.applicationId
        if app not in self._shared:
            self._shared = {app: spark.sparkContext.broadcast(self._trees())}
        return self._shared[app]

    def score(self, df: DataFrame, into: str = "score") -> DataFrame:
        """Adds the score of each row: in [-1, 0), the lower the more isolated. A narrow map."""
        trees = self._broadcast(df.sparkSession)
        features, depth, norm = list(self.features), self.max_depth, average_path(self.sample)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                points = batch[features].to_numpy(dtype=np.float64)
                mean = path_lengths(points, trees.value, depth)
                yield batch.assign(**{into: -np.power(2.0, -mean / max(norm, 1e-12))})

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInPandas(run, f"{fields}, `{into}` double")

    def flag(self, df: DataFrame) -> DataFrame:
        """Adds ``is_anomaly`` to every row of ``df``.

        Each distinct feature vector is scored once and joined back; the Python work does not grow
        with repeated vectors, and counting them first keeps a frequent one from being hot.
        """
        keys = list(self.features)
        verdicts = self.score(df.select(*keys).distinct()).select(
            *keys, F.when(F.col("score") < self.threshold, 1).otherwise(0).alias("is_anomaly")
        )
        return df.join(lookup(verdicts), keys, "left")

    def flag_rows(self, df: DataFrame) -> DataFrame:
        """``flag`` without any shuffle, for streams and micro-batches."""
        return self.score(df, "_score").withColumn(
            "is_anomaly", F.when(F.col("_score") < self.threshold, 1).otherwise(0)
        ).drop("_score")

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODES_SCHEMA)


def fit(
    df: DataFrame,
    features: tuple[str, ...],
    row_id: str,
    trees: int = 100,
    sample: int = 256,
    contamination: float = 0.05,
    seed: int = 42,
) -> IsolationForest:
    """Fit on all rows of ``df``; ``row_id`` is unique.

    One pass counts the distinct feature vectors and a second draws the samples: every tree draws
    its own from all rows, by a hash threshold of its own, at any table size. The threshold is the
    exact ``contamination`` percentile of all training scores, taken over distinct vectors
    weighted by their counts.
    """
    keys = list(features)
    vectors = stage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    total = vectors.agg(F.sum("_n")).first()[0] or 0
    if total == 0:
        raise ValueError("no rows to fit on")
    size = min(sample, total)
    depth = int(np.ceil(np.log2(max(size, 2))))

    # Rows below a tree's threshold are somewhat more than its sample; the group takes the least.
    share, grid = min(1.0, _MARGIN * size / total), 1 << 40

    def drawn(tree: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(row_id), tree, F.lit(seed)), F.lit(grid))

    mine = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: drawn(tree) < int(share * grid))
    draws = (
        df.select(row_id, *keys, F.explode(mine).alias("tree"))
        .select("tree", drawn(F.col("tree")).alias("_h"), *keys)
    )

    def grow_tree(group: pd.DataFrame) -> pd.DataFrame:
        chosen = group.sort_values("_h").head(size)
        tree = int(group["tree"].iloc[0])
        rows = grow(chosen[keys].to_numpy(dtype=np.float64),
                    np.random.default_rng([seed, tree]), depth)
        out = pd.DataFrame(rows, columns=["node", "feature", "threshold", "path"])
        return out.assign(tree=tree)[["tree", "node", "feature", "threshold", "path"]]

    nodes = draws.groupBy("tree").applyInPandas(grow_tree, NODES_SCHEMA).toPandas()
    nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
    model = IsolationForest(tuple(features), nodes, size, depth, trained_on=total)
    model.threshold = weighted_percentile(model.score(vectors), "score", "_n", contamination)
    return model


def weighted_percentile(df: DataFrame, value: str, weight: str, share: float) -> float:
    """The interpolated percentile of ``value``, each counted ``weight`` times, as one job per
    narrowing of the range; only the last few values reach the driver."""
    scored = stage(df.groupBy(value).agg(F.sum(weight).alias("n")))
    ends = scored.agg(F.min(value), F.max(value), F.sum("n")).first()
    low, high, total = ends
    place = share * (total - 1)

    def at(rank: int) -> float:
        """The value with at most ``rank`` counts below it."""
        a, b = low, high
        while scored.filter(F.col(value).between(a, b)).count() > _LAST_VALUES:
            cuts = sorted({a + (b - a) * k / 32 for k in range(1, 33)} | {b})
            got = scored.agg(*[
                F.sum(F.when(F.col(value) <= c, F.col("n"))).alias(f"c{k}")
                for k, c in enumerate(cuts)]).first()
            k = next(k for k in range(len(cuts)) if (got[k] or 0) > rank)
            a, b = (cuts[k - 1] if k else a), cuts[k]
        below = scored.filter(F.col(value) < a).agg(F.sum("n")).first()[0] or 0
        for r in sorted(scored.filter(F.col(value).between(a, b)).collect()):
            below += r.n
            if below > rank:
                return float(r[value])
        return float(high)

    lower = at(int(place))
    part = place - int(place)
    return lower + part * (at(int(place) + 1) - lower) if part else lower
