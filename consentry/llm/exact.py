"""Exact dedup by naming blocks: texts get integer identities that are equal only for equal texts.

A text is cut into blocks of fixed size. Distinct blocks are sorted and numbered; then adjacent
pairs of numbers are sorted and numbered, and so on until one number is left. Two texts of equal
length have the same last number exactly if they are equal, as every step maps different contents
to different numbers; no hash decides.

A text needs this only while others may equal it: its length and the name of its first, short block
settle every text that is alone with them. The rest, and no other text, goes through all levels.
The first blocks of hot groups are counted before the shuffle, the joins are ones whose hot keys
adaptive execution splits, and every level is written, so a lost executor repeats one level at most.

Cases: a null text is an empty one; empty texts equal each other; null keys come after all others;
of rows with equal key and text one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.llm.common import BLANKS, prepare
from consentry.sources.staging import lookup, stage

#: Bytes of the first block, which settles most texts, and of the blocks that are named.
LEAD_BYTES = 96
BLOCK_BYTES = 8192


def normalised(text: str | Column) -> Column:
    """Every run of white space as one space; null as the empty text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """``distinct`` with integers ``name`` that ascend in sort order, written once.

    The order is by hash first, so that ranges are even and their bounds, which the driver holds,
    are single numbers; the contents themselves decide between equal hashes.
    """
    hashed = distinct.withColumn("hash", F.xxhash64(*order))
    ordered = hashed.repartitionByRange("hash").sortWithinPartitions("hash", *order).drop("hash")
    return stage(ordered.withColumn("name", F.monotonically_increasing_id()))


def name_texts(texts: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id``, ``n_bytes`` and ``body`` (binary) to ``id``, ``n_bytes`` and ``name``.

    Equal (``n_bytes``, ``name``) means equal bodies, and the other way round.
    """
    count = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / block_bytes)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda k: F.substring(F.col("body"), k * block_bytes + 1, F.lit(block_bytes)))
    blocks = texts.select("id", "n_bytes", F.posexplode(cut).alias("at", "block"))
    names = numbered(blocks.select("block").distinct(), "block")
    level = stage(blocks.join(names, "block").select("id", "n_bytes", "at", "name"))
    size, done = block_bytes, []
    while True:
        # A text of one block at this level has its identity; its length says at which level.
        done.append(level.filter(F.col("n_bytes") <= size).select("id", "n_bytes", "name"))
        level = level.filter(F.col("n_bytes") > size)
        if level.isEmpty():
            break
        left = F.max(F.when(F.col("at") % 2 == 0, F.col("name")))
        right = F.max(F.when(F.col("at") % 2 == 1, F.col("name")))
        pairs = stage(
            level.groupBy("id", "n_bytes", F.floor(F.col("at") / 2).cast("int").alias("at"))
            .agg(left.alias("left"), F.coalesce(right, F.lit(-1)).alias("right")))
        names = numbered(pairs.select("left", "right").distinct(), "left", "right")
        level = stage(pairs.join(names, ["left", "right"]).select("id", "n_bytes", "at", "name"))
        size *= 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``keep_key`` (of the row that stays), ``group_size``, ``kept``, ``sha256``.
    """
    prepare(docs.sparkSession)
    body = normalised(text).cast("binary")
    rows = docs.select(F.col(key).alias("key"), body.alias("body")).select(
        "key", "body", F.octet_length("body").alias("n_bytes"),
        F.substring("body", F.lit(1), F.lit(LEAD_BYTES)).alias("lead"))
    shared = lookup(
        rows.groupBy("n_bytes", "lead").count().filter("count > 1").select("n_bytes", "lead")
        .withColumn("shared", F.lit(True)))
    # The table of shared beginnings grows with the input, so it is never broadcast.
    rows = stage(
        rows.join(shared.hint("merge"), ["n_bytes", "lead"], "left").select(
            F.monotonically_increasing_id().alias("id"), "key", "n_bytes",
            F.sha2("body", 256).alias("sha256"), F.when(F.col("shared"), F.col("body")).alias("body")))
    named = stage(name_texts(rows.filter("body IS NOT NULL").select("id", "n_bytes", "body")))
    open_rows = rows.filter("body IS NOT NULL").drop("body", "n_bytes").join(named, "id")
    first = F.struct(F.col("key").isNull(), "key", "id")
    groups = lookup(
        open_rows.groupBy("n_bytes", "name").agg(
            F.min(first).alias("first"), F.count("*").alias("group_size")))
    grouped = open_rows.join(groups, ["n_bytes", "name"]).select(
        "key", F.col("first.key").alias("keep_key"), "group_size",
        (F.col("first.id") == F.col("id")).alias("kept"), "sha256")
    alone = rows.filter("body IS NULL").select(
        "key", F.col("key").alias("keep_key"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "sha256")
    return alone.unionByName(grouped)
