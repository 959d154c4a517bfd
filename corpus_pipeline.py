"""From raw documents to token files: every stage is one operator, and its decisions take effect.

Each stage takes the documents its predecessor kept. ``run`` writes the rows between stages to the
shared folder, so a lost executor costs a re-read and not the stages before.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from consentry.llm import decontaminate, mixing, neardup, quality, tokens
from consentry.llm.common import prepare, table
from consentry.llm.queries import trained_quality
from consentry.sources.staging import shared_dir, stage

#: Fixed id that ends a document in the token files.
END_ID = 1


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts. It learns from the labelled rows of ``docs``."""
    prepare(spark)
    features = stage(quality.features(docs, keep=["doc_id"]))
    model = trained_quality(spark, sf_dir, features)
    scored = quality.score(docs, model, text="text")
    return scored.filter(quality.accepted()).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five-word shingles, similarity 0.8)."""
    return neardup.near_unique(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty is in a benchmark passage."""
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate.find_items(docs, items)
    return found.filter(~decontaminate.contaminated()).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens meet the target shares."""
    return mixing.mix(docs).filter("kept").select("row.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids are in the files written, and their checksum, read back."""
    path = shared_dir(spark)
    tokens.write_tokens(
        docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=END_ID, word_level=True)
    key_type = docs.schema["doc_id"].dataType.simpleString()
    read = tokens.read_tokens(spark, path, key_type, checksum=True)
    return read.withColumnRenamed("key", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("tokens", token_files),
]

#: SQL cannot express the model, the signatures, the raking or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
