"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of the items: 13 consecutive words, or all words of a shorter item. Per
window length there is a shift table over blocks of two words, which says how far the search may
jump because no window can end sooner; where it may not jump, the block picks the windows that end
with it, those are narrowed by their first block, and the rest is compared word by word.

The tables are broadcast. Items are taken in groups of at most ``max_bytes`` of text each; a
larger benchmark takes several passes over the documents, each with bounded tables.

Cases: a null or wordless text has no words and is never hit; a null or wordless item has no
window; an item that is repeated counts once by its id; windows of an item without an id mark hits
but the item is not listed; extra columns are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from consentry.llm.common import map_rows, prepare, utf8
from consentry.sources.staging import stage

WINDOW = 13
#: Bytes of item text whose tables one pass broadcasts.
MAX_BYTES = 4 << 20

#: The tables a worker made last, by the tag of their pass.
_READY: dict[str, Search] = {}

#: A-Z become a-z; what is neither letter, digit nor beyond ASCII becomes a space.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80
    else 0x20 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _search(tag: str, shared, window: int) -> Search:
    if tag not in _READY:
        _READY.clear()
        _READY[tag] = Search(shared.value, window)
    return _READY[tag]


def _block(words: list[bytes], last: int, length: int) -> tuple[bytes, ...]:
    """The block that ends at ``last``: two words, or one for windows of a single word."""
    return (words[last],) if length == 1 else (words[last - 1], words[last])


@dataclass
class Tables:
    """Shift and bucket tables of all windows of one length."""

    length: int
    shift: dict[tuple, int] = field(default_factory=dict)
    buckets: dict[tuple, dict[tuple, list[tuple[int, int]]]] = field(default_factory=dict)

    def add(self, item: int, words: list[bytes]) -> None:
        n = self.length
        for last in range(min(1, n - 1), len(words)):
            block, jump = _block(words, last, n), max(0, n - 1 - last)
            self.shift[block] = min(jump, self.shift.get(block, n))
            if not jump:
                first = _block(words, last - n + min(2, n), n)
                self.buckets.setdefault(block, {}).setdefault(first, []).append((item, last))


class Search:
    def __init__(self, items: list[tuple[object, bytes]], window: int) -> None:
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        by_length: dict[int, Tables] = {}
        for k, words in enumerate(self.words):
            if words:
                n = min(window, len(words))
                by_length.setdefault(n, Tables(n)).add(k, words)
        self.tables = list(by_length.values())

    def __call__(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of hit words, and the ids of items with a window here."""
        spans, found = [], set()
        for t in self.tables:
            n, last, most = t.length, t.length - 1, max(1, t.length - 1)
            while last < len(words):
                block = _block(words, last, n)
                jump = t.shift.get(block, most)
                if jump:
                    last += jump
                    continue
                start = last - n + 1
                first = _block(words, start + min(2, n) - 1, n)
                here = [
                    k for k, end in t.buckets[block].get(first, ())
                    if self.words[k][end - n + 1:end + 1] == words[start:last + 1]
                ]
                if here:
                    spans.append((start, last + 1))
                    found.update(here)
                last += 1
        return merge(spans), {self.ids[k] for k in found} - {None}


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_items(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id",
    item_text: str = "text", window: int = WINDOW, max_bytes: int = MAX_BYTES,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``row`` (the document, or its columns ``keep``), ``n_words``, ``hits`` (spans of words) and
    ``items`` (ids of the items with a window in the document, ascending).
    """
    spark = prepare(docs.sparkSession)
    items = items.select(F.col(item_key).alias("id"), F.col(item_text).cast("binary").alias("body"))
    # Repeats would all fall into one pass; one of them says the same.
    items = items.distinct()
    id_type = items.schema["id"].dataType.simpleString()
    arrow_id = to_arrow_type(items.schema["id"].dataType)
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    groups = max(1, -(-size // max_bytes))
    group = F.pmod(F.xxhash64("id", "body"), F.lit(groups))
    spans = "array<struct<start:int,end:int>>"
    out = None
    for g in range(groups):
        mine = items.filter(F.col("body").isNotNull() & (group == g)).collect()
        shared = spark.sparkContext.broadcast([(r.id, bytes(r.body)) for r in mine])
        tag, outer = uuid.uuid4().hex, out is not None

        def run(rows, shared=shared, tag=tag, outer=outer):
            search = _search(tag, shared, window)
            texts = utf8(rows.field("row") if outer else rows, text)
            words = [words_of(t) for t in texts]
            results = [search(w) for w in words]
            if outer:
                before_hits = rows.field("hits").to_pylist()
                before_items = rows.field("items").to_pylist()
                results = [
                    (merge(s + [(x["start"], x["end"]) for x in h]), f | set(i))
                    for (s, f), h, i in zip(results, before_hits, before_items)
                ]
            hit = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            return {
                "n_words": pa.array([len(w) for w in words], pa.int64()),
                "hits": pa.array([[{"start": a, "end": b} for a, b in s] for s, _ in results], hit),
                "items": pa.array([sorted(f) for _, f in results], pa.list_(arrow_id)),
            }

        added = f"n_words bigint, hits {spans}, items array<{id_type}>"
        if outer:
            out = map_rows(stage(out), run, added).select("row.row", "n_words", "hits", "items")
        else:
            out = map_rows(docs, run, added, keep if groups == 1 else None)
    names = keep or docs.columns
    return out.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in names]))


def n_hit() -> Column:
    """Hit words of a result of ``find_items``."""
    return F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def contaminated() -> Column:
    """At least one word in twenty is hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))
