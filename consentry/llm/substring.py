"""Substring dedup: passages of at least ``LENGTH`` words that occur elsewhere are removed.

A window is ``LENGTH`` consecutive words of a document; its words go if the same window starts
anywhere else. Suffix automata of reference shards decide that: a shard's passages are put into an
automaton that counts where every sequence ends, and documents are streamed through it for their
matching statistics; where the match is as long as a window and ends in more than one place, the
window repeats.

The reference is the corpus itself, which no automaton of bounded size can hold and which must not
be broadcast whole. So shards are made such that equal windows always meet in one shard:

* A window belongs to its *anchor*, the least of its ``GRAM``-word sequences by hash. Consecutive
  windows with the same anchor are one *stretch*; stretches, not windows, are shuffled.
* A stretch whose anchor stands nowhere else has no repeated window. If all stretches of an anchor
  are equal (128 bits), all their windows repeat. Only anchors whose stretches differ are left.
* Of those, one copy of each different stretch goes to its anchor's shard, as word numbers. Shards
  of at most about ``SHARD_WORDS`` words are held at a time, a task works through many.
* An anchor with more than ``VARIANTS`` different stretches (a passage very many documents share)
  has no bounded shard. Its stretches are cut again, by a second anchor under another hash, which
  for most windows lies in the text around the passage, and go through the same steps. What is
  then still too much for a shard has its windows counted by their own 128 bits, combined before
  the shuffle. All ways give the same windows.

Words are compared as 64-bit numbers. Windows are judged on the input, not on what is left.

Cases: null and empty texts have no words; texts shorter than a window lose nothing; rows that
repeat a text lose all windows of it; words repeated within one document count like others; extra
columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from consentry.llm import words as W
from consentry.llm.common import map_rows, prepare, utf8
from consentry.llm.decontaminate import merge
from consentry.sources.staging import lookup, stage

LENGTH = 35
GRAM = 8
SHARD_WORDS = 60_000
VARIANTS = 400

#: Bits of a position within a batch, below the hash that orders anchors.
_AT = 28
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Orders second anchors.
_SECOND = 0x2545F4914F6CDD1D


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by where they start."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    more = width - have
    return np.minimum(out[:len(out) - more], out[more:]) if more else out


class Hashes:
    """Hashes of any run of words of a batch, by prefix sums; equal runs hash alike anywhere."""

    def __init__(self, words: np.ndarray) -> None:
        powers = np.full(len(words) + 1, _BASE, np.uint64)
        powers[0] = 1
        back = np.full(len(words) + 1, _INVERSE, np.uint64)
        back[0] = 1
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(W.mix(words) * np.cumprod(powers)[:-1], out=self.sums[1:])
        self.back = np.cumprod(back)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        run = (self.sums[end] - self.sums[start]) * self.back[start]
        return W.mix(run ^ (end - start).astype(np.uint64))


def stretches(
    words: np.ndarray, starts: np.ndarray, length: int, gram: int, seed: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, document, first window and number of windows of every stretch of a batch."""
    width = length - gram + 1
    n = np.maximum(np.diff(starts) - length + 1, 0)
    if not n.sum():
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    grams = W.sequences(words, gram)
    grams = W.mix(grams ^ np.uint64(seed)) if seed else grams
    if len(grams) >= 1 << _AT:
        raise ValueError("a batch has too many words; lower the rows per Arrow batch")
    ordered = (grams >> np.uint64(_AT) << np.uint64(_AT)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_min(ordered, width) & np.uint64((1 << _AT) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[:-1], n)
    at = anchor[window]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(first)
    count = np.diff(np.append(begin, len(at)))
    return grams[at[begin]], doc[begin], window[begin], count


class Automaton:
    """A suffix automaton of sequences, with the number of places where each state's words end."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [0]
        last = 0
        for k, sequence in enumerate(sequences):
            for symbol in sequence:
                last = self._add(last, symbol)
            last = self._add(last, -1 - k)  # a separator no other sequence has
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] += self.ends[state]

    def _new(self, length: int, link: int, ends: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(ends)
        return len(self.link) - 1

    def _add(self, last: int, symbol: int) -> int:
        new = self._new(self.length[last] + 1, 0, 1, {})
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][symbol]
            if self.length[target] == self.length[at] + 1:
                self.link[new] = target
            else:
                copy = self._new(
                    self.length[at] + 1, self.link[target], 0, dict(self.next[target]))
                while at >= 0 and self.next[at].get(symbol) == target:
                    self.next[at][symbol] = copy
                    at = self.link[at]
                self.link[target] = self.link[new] = copy
        return new

    def repeated(self, sequence: list[int], length: int) -> list[int]:
        """Starts of the windows of ``sequence`` that end in more than one place.

        Streams the sequence and keeps the match no longer than the state that holds the last
        ``length`` words.
        """
        out, state, matched = [], 0, 0
        for k, symbol in enumerate(sequence):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol not in self.next[state]:
                matched = 0
                continue
            state, matched = self.next[state][symbol], matched + 1
            while self.length[self.link[state]] >= length:
                state = self.link[state]
                matched = self.length[state]
            if matched >= length and self.ends[state] > 1:
                out.append(k - length + 1)
        return out


def _stretches(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``anchor``, ``content``, ``key``, ``hash``, ``start``, ``count`` of all stretches."""
    key_type = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [(t or b"").split() for t in batch.column(2).to_pylist()]
            words, starts = W.numbers(split)
            anchor, doc, window, count = stretches(words, starts, length, gram)
            content = Hashes(words)(window, window + count + length - 1)
            yield pa.RecordBatch.from_pydict({
                "anchor": pa.array(anchor.view(np.int64)),
                "content": pa.array(content.view(np.int64)),
                "key": batch.column(0).take(pa.array(doc)),
                "hash": batch.column(1).take(pa.array(doc)),
                "start": pa.array((window - starts[doc]).astype(np.int32)),
                "count": pa.array(count.astype(np.int32))})

    return docs.select("key", "hash", "body").mapInArrow(
        run, f"anchor bigint, content bigint, key {key_type}, hash bigint, start int, count int")


def _of_rows(docs: DataFrame, other: DataFrame) -> DataFrame:
    """``docs`` joined to ``other``, one row for each key and text."""
    named = other.withColumnsRenamed({"key": "k", "hash": "h"})
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h"))
    return docs.join(named, same, "inner").drop("k", "h")


def _passages(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` stretches with their ``words``."""
    asked = wanted.groupBy("key", "hash").agg(F.collect_list(
        F.struct("anchor", "n", "variants", "start", "count")).alias("asked"))
    key_type = docs.schema["key"].dataType.simpleString()
    arrow_key = to_arrow_type(docs.schema["key"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [t.split() for t in batch.column(2).to_pylist()]
            words, starts = W.numbers(split)
            numbers = words.view(np.int64)
            out, cuts = [], []
            keys, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, h, base, asked in zip(keys, hashes, starts, batch.column(3).to_pylist()):
                for a in asked:
                    begin = base + a["start"]
                    cuts.append(numbers[begin:begin + a["count"] + length - 1])
                    out.append((a["anchor"], a["n"], a["variants"], key, h, a["start"]))
            columns = list(zip(*out)) if out else [()] * 6
            ends = np.cumsum([0, *map(len, cuts)], dtype=np.int32)
            flat = np.concatenate(cuts) if cuts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({
                "anchor": pa.array(columns[0], pa.int64()), "n": pa.array(columns[1], pa.int64()),
                "variants": pa.array(columns[2], pa.int64()),
                "key": pa.array(columns[3], arrow_key), "hash": pa.array(columns[4], pa.int64()),
                "start": pa.array(columns[5], pa.int32()),
                "words": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})

    found = _of_rows(docs, asked).select("key", "hash", "body", "asked").mapInArrow(
        run, "anchor bigint, n bigint, variants bigint, "
        f"key {key_type}, hash bigint, start int, words array<bigint>")
    return found


def _refined(passages: DataFrame, length: int, gram: int) -> DataFrame:
    """``passages`` cut into stretches of a second anchor: ``anchor`` (both in one number),
    ``content``, ``n``, ``key``, ``hash``, ``start``, ``words``."""
    key_type = passages.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(5)
            starts = lists.offsets.to_numpy().astype(np.int64)
            starts = starts - starts[0]
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            second, row, window, count = stretches(
                flat.view(np.uint64), starts, length, gram, _SECOND)
            end = window + count + length - 1
            first = batch.column(0).to_numpy()[row].view(np.uint64)
            ends = np.cumsum(np.concatenate([[0], end - window]))
            pick = np.repeat(window - ends[:-1], end - window) + np.arange(ends[-1])
            at = batch.column(4).to_numpy()[row] + window - starts[row]
            content = Hashes(flat.view(np.uint64))(window, end)
            taken = pa.array(row)
            yield pa.RecordBatch.from_pydict({
                "anchor": pa.array(W.mix(first ^ W.mix(second)).view(np.int64)),
                "content": pa.array(content.view(np.int64)), "n": batch.column(1).take(taken),
                "key": batch.column(2).take(taken), "hash": batch.column(3).take(taken),
                "start": pa.array(at.astype(np.int32)),
                "words": pa.ListArray.from_arrays(
                    pa.array(ends.astype(np.int32)), pa.array(flat[pick]))})

    return passages.select("anchor", "n", "key", "hash", "start", "words").mapInArrow(
        run, f"anchor bigint, content bigint, n bigint, key {key_type}, hash bigint, start int, "
        "words array<bigint>")


def _by_second_anchor(passages: DataFrame, length: int, gram: int) -> DataFrame:
    """``key``, ``hash``, ``start``, ``end`` of words in repeated windows of single stretches whose
    anchors have many variants."""
    found = stage(_refined(passages, length, gram))
    shared = lookup(found.groupBy("anchor").agg(
        F.sum("n").alias("times"), F.min("content").alias("a"), F.max("content").alias("b"))
        .filter("times > 1").select("anchor", (F.col("a") == F.col("b")).alias("same")))
    hits = stage(found.join(shared, "anchor"))
    end = (F.col("start") + F.size("words")).alias("end")
    whole = hits.filter("same AND n = 1").select("key", "hash", "start", end)

    open_hits = hits.filter("NOT same").drop("same")
    # Equal stretches are counted and one of them is chosen by where it stands; words follow.
    where = F.struct("key", "hash", "start")
    counted = lookup(open_hits.groupBy("anchor", "content").agg(
        F.sum("n").alias("times"), F.min(where).alias("one")))
    many = lookup(counted.groupBy("anchor").agg(F.count("*").alias("variants")))
    known = stage(open_hits.join(counted, ["anchor", "content"]).join(many, "anchor"))
    whole_too = known.filter("times > 1 AND n = 1").select("key", "hash", "start", end)
    chosen = known.filter(where.eqNullSafe(F.col("one"))).withColumn("n", F.col("times"))
    few = _by_automata(chosen.filter(F.col("variants") <= VARIANTS), length)
    lots = _by_windows(chosen.filter(F.col("variants") > VARIANTS), length)
    return whole.unionByName(whole_too).unionByName(few).unionByName(lots)


def _by_automata(passages: DataFrame, length: int) -> DataFrame:
    """``key``, ``hash``, ``start``, ``end`` of words in repeated windows of single stretches."""
    sorted_passages = passages.select("anchor", "n", "key", "hash", "start", "words").repartition(
        "anchor").sortWithinPartitions("anchor")
    key_type = passages.schema["key"].dataType.simpleString()
    arrow_key = to_arrow_type(passages.schema["key"].dataType)

    def spans(shard: list[tuple]) -> Iterator[tuple]:
        if len(shard) < 2 or all(n > 1 for _, n, *_ in shard):
            return
        automaton = Automaton([words for *_, words in shard])
        for _, n, key, h, start, words in shard:
            if n == 1:
                windows = automaton.repeated(words, length)
                for a, b in merge((w, w + length) for w in windows):
                    yield key, h, start + a, start + b

    def table(found: list[tuple]) -> pa.RecordBatch:
        key, h, a, b = zip(*found) if found else ((), (), (), ())
        return pa.RecordBatch.from_pydict({
            "key": pa.array(key, arrow_key), "hash": pa.array(h, pa.int64()),
            "start": pa.array(a, pa.int32()), "end": pa.array(b, pa.int32())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = [], 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for row in zip(*columns):
                if size >= SHARD_WORDS and row[0] != shard[-1][0]:
                    yield table(list(spans(shard)))
                    shard, size = [], 0
                shard.append(row)
                size += len(row[5])
        if shard:
            yield table(list(spans(shard)))

    return sorted_passages.mapInArrow(run, f"key {key_type}, hash bigint, start int, end int")


def _by_windows(passages: DataFrame, length: int) -> DataFrame:
    """The same for anchors with many variants, by counting every window."""
    key_type = passages.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(5)
            bounds = words.offsets.to_numpy().astype(np.int64)
            bounds = bounds - bounds[0]
            n = np.diff(bounds) - length + 1
            row = np.repeat(np.arange(len(n)), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = bounds[row] + within
            flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            hashes = Hashes(flat)(begin, begin + length)
            pick = pa.array(row)
            start = batch.column(4).to_numpy()[row] + within
            yield pa.RecordBatch.from_pydict({
                "anchor": batch.column(0).take(pick), "n": batch.column(1).take(pick),
                "window": pa.array(hashes.view(np.int64)), "key": batch.column(2).take(pick),
                "hash": batch.column(3).take(pick), "start": pa.array(start.astype(np.int32))})

    windows = passages.select("anchor", "n", "key", "hash", "start", "words").mapInArrow(
        run, f"anchor bigint, n bigint, window bigint, key {key_type}, hash bigint, start int")
    often = lookup(windows.groupBy("anchor", "window").agg(F.sum("n").alias("times")).filter(
        "times > 1").select("anchor", "window"))
    return windows.filter("n = 1").join(often, ["anchor", "window"]).select(
        "key", "hash", "start", (F.col("start") + length).alias("end"))


def _body(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``key``, ``hash`` and ``spans`` of words to remove, for documents that have any.

    ``docs`` has ``key``, ``hash`` (of the text) and ``body`` (the text in UTF-8).
    """
    found = stage(_stretches(docs, length, gram))
    shared = lookup(found.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("content").alias("a"), F.max("content").alias("b"))
        .filter("n > 1").select("anchor", (F.col("a") == F.col("b")).alias("same")))
    hits = stage(found.join(shared, "anchor"))
    end = F.col("start") + F.col("count") + (length - 1)
    whole = hits.filter("same").select("key", "hash", "start", end.alias("end"))

    open_hits = hits.filter("NOT same").drop("same")
    one = F.min(F.struct("key", "hash", "start", "count")).alias("one")
    variants = stage(open_hits.groupBy("anchor", "content").agg(F.count("*").alias("n"), one))
    often = lookup(variants.filter("n > 1").select("anchor", "content"))
    whole_too = open_hits.join(often, ["anchor", "content"]).select(
        "key", "hash", "start", end.alias("end"))

    many = lookup(variants.groupBy("anchor").agg(F.count("*").alias("variants")))
    wanted = variants.join(many, "anchor").select("anchor", "n", "variants", "one.*")
    passages = stage(_passages(docs, wanted, length))
    few = _by_automata(passages.filter(F.col("variants") <= VARIANTS), length)
    lots = _by_second_anchor(passages.filter(F.col("variants") > VARIANTS), length, gram)

    spans = whole.unionByName(whole_too).unionByName(few).unionByName(lots)
    return spans.groupBy("key", "hash").agg(
        F.collect_set(F.struct("start", "end")).alias("spans"))


def remove_repeated(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH,
    gram: int = GRAM,
) -> DataFrame:
    """Per row: ``key``, ``n_words``, ``removed`` (spans of words) and ``kept`` (the words left,
    joined by one space).
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(key).alias("key"), _body(text).alias("body")).withColumn(
        "hash", F.xxhash64("body"))
    spans = stage(repeated_spans(docs, length=length, gram=gram))
    named = spans.withColumnsRenamed({"key": "k", "hash": "h"})
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h"))
    rows = docs.join(named, same, "left").select("key", "body", "spans")

    def run(rows: pa.StructArray) -> dict[str, pa.Array]:
        n, removed, kept = [], [], []
        for body, spans in zip(utf8(rows, "body"), rows.field("spans").to_pylist()):
            words = body.split()
            cut = merge((s["start"], s["end"]) for s in spans or ())
            left, at = [], 0
            for a, b in cut:
                left += words[at:a]
                at = b
            n.append(len(words))
            removed.append([{"start": a, "end": b} for a, b in cut])
            kept.append(b" ".join(left + words[at:]).decode())
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return {
            "n_words": pa.array(n, pa.int64()), "removed": pa.array(removed, span),
            "kept": pa.array(kept, pa.string())}

    added = "n_words bigint, removed array<struct<start:int,end:int>>, kept string"
    return map_rows(rows, run, added, ["key"]).select("row.key", "n_words", "removed", "kept")
