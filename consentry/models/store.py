"""Fitted access models that outlive their session.

``<root>/nodes/w…`` holds a model's trees as Parquet; ``<root>/model/N.json`` says which trees, and all
else there is to a model: the order of its features, the sample and depth, the threshold, and how
many rows it was trained on. That file is written last and renamed to its number, which fails if
somebody else published that number, so a version is there as a whole or not at all. Readers take
the newest, or any version they name; versions are kept until ``drop``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from consentry.models.forest import NODES_SCHEMA, IsolationForest
from consentry.sources.manifest import Files

FORMAT = 1


def _name(version: int) -> str:
    return f"model/{version:010d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(
        int(n.removesuffix(".json")) for n in Files(spark, root).names("model")
        if n.endswith(".json") and n[0].isdigit())


def publish(spark: SparkSession, model: IsolationForest, root: str) -> int:
    """Keep a fitted model as the next version, and return that."""
    files, folder = Files(spark, root), f"nodes/w{uuid.uuid4().hex}"
    model.to_frame(spark).coalesce(1).write.parquet(f"{root}/{folder}")
    text = json.dumps({
        "format": FORMAT, "features": list(model.features), "sample": model.sample,
        "max_depth": model.max_depth, "threshold": model.threshold, "trained_on": model.trained_on,
        "nodes": folder})
    while True:
        version = max(versions(spark, root), default=0) + 1
        passing = f"model/.{uuid.uuid4().hex}"
        files.write(passing, text)
        if files.rename(passing, _name(version)):
            return version
        files.delete(passing)


def load(spark: SparkSession, root: str, version: int | None = None) -> IsolationForest | None:
    """A published model, the newest by default; none before the first."""
    known = versions(spark, root)
    if version is None and not known:
        return None
    if version is not None and version not in known:
        raise ValueError(f"there is no version {version} of the model, only {known}")
    held = json.loads(Files(spark, root).read(_name(version or known[-1])))
    if held["format"] != FORMAT:
        raise ValueError(f"a model of format {held['format']}; this library reads {FORMAT}")
    nodes = spark.read.schema(NODES_SCHEMA).parquet(f"{root}/{held['nodes']}").toPandas()
    return IsolationForest(
        tuple(held["features"]), nodes.sort_values(["tree", "node"], ignore_index=True),
        held["sample"], held["max_depth"], held["threshold"], held["trained_on"])


def drop(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Delete all versions but the newest ``keep``."""
    files = Files(spark, root)
    for version in versions(spark, root)[:-keep]:
        nodes = json.loads(files.read(_name(version)))["nodes"]
        files.delete(_name(version))
        files.delete(nodes)


class Newest:
    """The newest version at each call; a version is read once."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._spark, self._root = spark, root
        self.version, self._model = 0, None

    def __call__(self) -> IsolationForest | None:
        newest = max(versions(self._spark, self._root), default=0)
        if newest != self.version:
            self.version, self._model = newest, load(self._spark, self._root, newest)
        return self._model
