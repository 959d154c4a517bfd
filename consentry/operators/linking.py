"""Linking free text to registry records.

A message refers to a record when one of the record's keys (id, first name, national id, phone)
occurs in it; of several records the first in registry order wins. Each distinct key is first
reduced to its one winning record, so the join that follows is a lookup of at most one row per
piece of text and cannot multiply, however many people share a first name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.functions.text import squeeze, strip
from consentry.operators.access import linkable
from consentry.operators.state import grouped
from consentry.sources.staging import lookup
from consentry.spec import DEFAULT_SPEC, KEY, RegistrySpec

NARROW = ("id", "first_name")
WIDE = NARROW + ("national_id", "phone")

_TOKEN = r"([\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*)"
_PIECE = 512
_SLOTS = 1 << 18


def link_keys(
    registry: DataFrame, kinds: tuple[str, ...] = WIDE, spec: RegistrySpec = DEFAULT_SPEC
) -> DataFrame:
    """Distinct ``(plus, key)`` with the first record that has the key. ``plus`` is false for phone
    keys, which are compared without plus signs."""
    first_name = F.substring_index(F.lower(squeeze(F.col("full_name"))), " ", 1)
    keys = {
        "id": (True, F.lower(F.col(KEY))),
        "first_name": (True, F.nullif(first_name, F.lit(""))),
        "national_id": (True, F.col("national_id")),
        "phone": (False, F.replace(F.col("phone"), F.lit("+"), F.lit(""))),
    }
    listed = F.array(
        *[F.struct(F.lit(keys[k][0]).alias("plus"), keys[k][1].alias("key")) for k in kinds]
    )
    record = F.struct(F.col("row_order"), F.col(KEY))
    entries = (
        linkable(registry, spec)
        .select(record.alias("record"), F.inline(listed))
        .filter(F.col("key").isNotNull())
    )
    return grouped(entries, "plus", "key").agg(F.min("record").alias("record")).drop("_hash")


def _slot(key: str) -> Column:
    start = F.substring(key, 1, 3)
    return F.pmod(F.xxhash64("plus", F.length(key), start), F.lit(_SLOTS))


def _starts(keys: DataFrame) -> Column:
    """A bitmap of how keys start: one bit per hash of (plus, length, first three characters), as a
    scalar array of ``_SLOTS / 64`` longs whatever the number of keys."""
    words = keys.select(_slot("key").alias("_s")).groupBy(F.expr("_s div 64").alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(_s % 64 as int)))").alias("bits")
    )
    dense = F.expr(
        f"transform(sequence(0, {_SLOTS // 64 - 1}), "
        "i -> coalesce(try_element_at(_m, cast(i as bigint)), 0L))"
    )
    return (
        words.agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("_m"))
        .select(dense).scalar()
    )


def _may_be_key(bitmap: Column) -> Column:
    word = F.get(bitmap, F.expr("cast(_s div 64 as int)"))
    return F.bit_get(word, F.expr("cast(_s % 64 as int)")) == 1


def _first_record(hits: DataFrame) -> DataFrame:
    return hits.groupBy("msg_id").agg(F.min("record").alias("record")).select(
        "msg_id", f"record.{KEY}"
    )


def link_messages(
    messages: DataFrame,
    registry: DataFrame,
    kinds: tuple[str, ...] = WIDE,
    spec: RegistrySpec = DEFAULT_SPEC,
) -> DataFrame:
    """``(msg_id, beneficiary_id)`` by substring: ``ali`` also matches inside ``alice``.

    Exact without comparing every message with every record: keys have few distinct lengths, so
    all substrings of those lengths are looked up in an equi-join. Long texts are cut into pieces
    that overlap by the longest key, which keeps the work linear in the text. A small bitmap of key
    beginnings drops most substrings inside the map task, so few reach the shuffle.
    """
    keys = lookup(link_keys(registry, kinds, spec))
    lengths = keys.agg(F.collect_set(F.struct("plus", F.length("key").alias("n"))))
    body = F.lower(strip(F.col("text")))
    bodies = [F.struct(F.lit(True).alias("plus"), body.alias("body"))]
    if "phone" in kinds:
        bare = F.replace(body, F.lit("+"), F.lit(""))
        bodies.append(F.struct(F.lit(False).alias("plus"), bare.alias("body")))
    texts = (
        messages.select("msg_id", F.inline(F.array(*bodies)))
        .withColumn("_all", lengths.scalar())
        .withColumn("lengths", F.expr("transform(filter(_all, e -> e.plus = plus), e -> e.n)"))
    )
    pieces = texts.select(
        "msg_id", "plus", "lengths",
        F.explode(
            F.expr(
                f"transform(sequence(0, greatest(length(body) - 1, 0) div {_PIECE}), "
                f"p -> substr(body, cast(p * {_PIECE} + 1 as int), "
                f"{_PIECE} + greatest(array_max(lengths), 1) - 1))"
            )
        ).alias("piece"),
    )
    substrings = pieces.select(
        "msg_id", "plus",
        F.explode(
            F.expr(
                "array_distinct(flatten(transform(lengths, n -> transform(sequence(1, greatest(1, "
                f"least({_PIECE}, length(piece) - n + 1))), i -> substr(piece, i, n)))))"
            )
        ).alias("key"),
    )
    likely = substrings.withColumn("_s", _slot("key")).filter(_may_be_key(_starts(keys))).drop("_s")
    return _first_record(likely.join(keys, ["plus", "key"]))


def link_messages_tokens(
    messages: DataFrame,
    registry: DataFrame,
    kinds: tuple[str, ...] = WIDE,
    spec: RegistrySpec = DEFAULT_SPEC,
) -> DataFrame:
    """``(msg_id, beneficiary_id)`` by whole words: ``ali`` does not match ``alice``. Cheaper than
    substrings, as each word is looked up once."""
    either = grouped(link_keys(registry, kinds, spec), "key").agg(F.min("record").alias("record"))
    keys = lookup(either.drop("_hash"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_TOKEN), F.lit(1)))
    tokens = messages.select("msg_id", F.explode(words).alias("key"))
    return _first_record(tokens.join(keys, "key"))
