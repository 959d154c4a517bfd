"""The registered queries of the training-data operators: each derives its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consentry.llm import (
    codes, decontaminate, exact, language, mixing, neardup, packing, quality, substring, surrogates,
    tokens, trie, warc,
)
from consentry.llm.common import fold, table
from consentry.sources.staging import shared_dir, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        table(spark, sf_dir, "benchmark", "item_id", "text"), keep=["doc_id"])
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "row.doc_id", "n_words", decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"))


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    tokens.write_tokens(
        table(spark, sf_dir, "documents", "doc_id", "text"), path,
        public_tokenizers.path("word_bpe_49k.json"), word_level=True)
    return tokens.read_tokens(spark, path, checksum=True).withColumnRenamed("key", "doc_id")


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    warc.write_warc(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return warc.read_warc(spark, path, payload=False).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        "refers_to", "url")


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(table(spark, sf_dir, "documents", "doc_id", "text"))
    return groups.select(
        F.col("key").alias("doc_id"), F.col("keep_key").alias("keep_id"), "group_size", "kept",
        F.col("sha256").alias("text_sha256"))


def trained_quality(spark: SparkSession, sf_dir: str, features: DataFrame) -> quality.Model:
    """The model of the labelled rows outside the held-out fold."""
    labels = table(spark, sf_dir, "labels", "doc_id", F.col("quality").alias("label"))
    learned = features.select("row.doc_id", "features").filter(fold("doc_id", 3) != 1)
    return quality.fit(learned.join(labels, "doc_id"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    features = stage(quality.features(docs, keep=["doc_id"]))
    model = trained_quality(spark, sf_dir, features)
    held = features.select("row.doc_id", "features")
    return quality.score(held, model, keep=["doc_id"]).select(
        "row.doc_id", (fold("row.doc_id", 3) == 1).alias("held_out"), "score",
        quality.accepted().cast("int").alias("predicted"))


@query
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = neardup.near_classes(
        table(spark, sf_dir, "documents", "doc_id", "text"), shingle=2, percent=80)
    return classes.select(
        F.col("key").alias("doc_id"), "n_shingles", F.col("class_key").alias("component_id"),
        F.col("key").eqNullSafe(F.col("class_key")).alias("kept"))


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.fit(docs.filter(fold("doc_id", 4) != 2))
    return language.predict(docs.drop("lang"), model, keep=["doc_id"]).select(
        "row.doc_id", (fold("row.doc_id", 4) == 2).alias("held_out"), "lang_pred", "score",
        "rejected")


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return mixing.mix(docs, keep=["doc_id"]).select(
        "row.doc_id", "source", "lang", "topic", F.col("n").alias("n_tokens"), "weight",
        "probability", "kept")


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.remove_repeated(table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate(
        "removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return left.select(
        F.col("key").alias("doc_id"), "n_words", removed.alias("n_removed"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return surrogates.replace(docs, key="registered query").select(
        "row.doc_id", "n_entities", F.col("clean").alias("text"))


@query
def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    books = codes.fit(vectors)
    if books is None:
        return vectors.limit(0).select(
            "vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"),
            F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = stage(codes.encode(vectors, books, keep=["vec_id", "label"]).select(
        "row.vec_id", "row.label", "code", "error"))
    return codes.with_label_error(coded, "label").drop("label").withColumn(
        "codebooks_sha256", F.lit(books.sha256()))


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        public_tokenizers.path("word_bpe_49k.json"), word_level=True,
    ).withColumnRenamed("key", "doc_id")


@query
def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(
        table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
