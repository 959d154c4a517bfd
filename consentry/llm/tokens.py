"""Token ids in flat binary files with 64-bit document offsets, read back by memory map.

A folder holds, for each part in key order, ``part-N.bin`` (unsigned little-endian ids, 16 bits
wide if all ids fit and 32 otherwise), ``part-N.off`` (signed 64-bit: where each document starts in
the part, and its end) and ``part-N.key.arrow`` (the documents' keys). ``manifest`` is a Parquet
table with a row per part. A part's base, the number of ids in all parts before it, is a prefix sum
over that table, so nothing but the row per part is ever brought together.

Parts are ranges of the key. Files are written under a passing name and renamed, and a repeated
task makes the same bytes, so a task that runs twice or is lost does no harm; what counts is the
manifest, written last.

Cases: a null text is an empty one (end id only); null keys sort first; rows that repeat a key are
documents of their own, ordered by text; an empty table makes an empty manifest.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from consentry.llm.common import prepare

#: Ids a reader holds at once, unless one document has more.
READ_IDS = 1 << 20
#: Distinct words whose ids a worker remembers.
REMEMBERED = 600_000
#: Bytes of text encoded at once, unless a batch has more.
BATCH_BYTES = 8 << 20
#: Stands between words that are encoded as one text; a control character that joins with nothing.
MARK = "\x01"

_MANIFEST = "part int, n_docs bigint, n_ids bigint, width int"
_WORDS: dict[int, _Remembered] = {}


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _Remembered:
    """Words and their id bytes; of more than ``2 * half`` words, those not used lately are lost."""

    def __init__(self, half: int) -> None:
        self.half, self.young, self.old = half, {}, {}

    def get(self, word: str) -> bytes | None:
        ids = self.young.get(word)
        if ids is None and (ids := self.old.get(word)) is not None:
            self.put(word, ids)
        return ids

    def put(self, word: str, ids: bytes) -> None:
        if len(self.young) >= self.half:
            self.young, self.old = {}, self.young
        self.young[word] = ids


class Encoder:
    """Texts to ids.

    ``word_level`` says that the vocabulary folds case and splits at ASCII white space, and between
    letters and marks, before it looks for tokens. Such a vocabulary gives the same ids for a text
    as for its words one by one, so every distinct word of a batch is encoded once, and frequent
    words are remembered between batches.
    """

    def __init__(self, vocabulary: str, width: int, word_level: bool) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.type = np.dtype(f"<u{width}")
        self.word_level = word_level
        at = zlib.crc32(f"{width}{vocabulary}".encode())
        self.known = _WORDS.setdefault(at, _Remembered(REMEMBERED // 2))
        self.mark = self._ids([MARK])[0]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.type) for e in done]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words, many of them encoded as one text with marks between them.

        A word with a mark in it, of which there are next to none, is encoded alone.
        """
        if len(self.mark) != 1 or any(MARK in w for w in words):
            return [ids.tobytes() for ids in self._ids(words)]
        rows = [words[a:a + 128] for a in range(0, len(words), 128)]
        out, size = [], self.type.itemsize
        for ids, row in zip(self._ids([f" {MARK} ".join(r) for r in rows]), rows):
            ends = np.flatnonzero(ids == self.mark[0]) * size
            data, at = ids.tobytes(), 0
            for end in [*ends.tolist(), len(data)]:
                out.append(data[at:end])
                at = end + size
        return out

    def _pool(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        out = [self.known.get(w) for w in words]
        new = [k for k, ids in enumerate(out) if ids is None]
        for a in range(0, len(new), 8192):
            some = new[a:a + 8192]
            for k, ids in zip(some, self._words([words[k] for k in some])):
                self.known.put(words[k], ids)
                out[k] = ids
        return out

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each ended by ``end_id``; how many each text has."""
        if not self.word_level:
            made = [self._ids([t])[0] for t in texts.to_pylist()]
            size = np.array([len(m) for m in made], np.int64)
            flat = np.concatenate(made) if made else np.zeros(0, self.type)
        else:
            # Special tokens are looked for before case is folded, so their texts stay as they are.
            if not pc.any(pc.match_substring(texts, "<|")).as_py():
                texts = pc.replace_substring_regex(
                    pc.ascii_lower(texts), r"([a-z])([.,;:!?]+)(\s|$)", r"\1 \2\3")
            lists = pc.ascii_split_whitespace(texts)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            at = coded.indices.to_numpy(zero_copy_only=False)
            pool = self._pool(coded.dictionary.to_pylist())
            lengths = np.array([len(p) for p in pool], np.int64) // self.type.itemsize
            starts = np.cumsum(lengths) - lengths
            per_word = lengths[at]
            before = np.concatenate([[0], np.cumsum(per_word)])
            pick = np.repeat(starts[at] - before[:-1], per_word) + np.arange(before[-1])
            flat = np.frombuffer(b"".join(pool), self.type)[pick]
            size = np.diff(before[bounds - bounds[0]])
        return np.insert(flat, np.cumsum(size), np.array(end_id, self.type)), size + 1


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``BATCH_BYTES``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= BATCH_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


class _Part:
    """The files of one part while they are written."""

    def __init__(self, path: str, part: int, key_type: pa.DataType) -> None:
        self.fs, at = _open(path)
        self.names = {s: f"{at}/part-{part:06d}.{s}" for s in ("bin", "off", "key.arrow")}
        self.tag = uuid.uuid4().hex
        self.fs.create_dir(at, recursive=True)
        self.out = {s: self.fs.open_output_stream(f"{n}.{self.tag}") for s, n in self.names.items()}
        self.keys = pa.ipc.new_file(self.out["key.arrow"], pa.schema([("key", key_type)]))
        self.out["off"].write(np.zeros(1, "<i8").tobytes())
        self.docs = self.ids = 0

    def add(self, keys: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        ends = self.ids + np.cumsum(sizes, dtype="<i8")
        self.out["bin"].write(ids.tobytes())
        self.out["off"].write(ends.tobytes())
        self.keys.write(pa.record_batch([keys], names=["key"]))
        self.docs, self.ids = self.docs + len(sizes), int(ends[-1])

    def close(self) -> None:
        self.keys.close()
        for s, name in self.names.items():
            self.out[s].close()
            self.fs.move(f"{name}.{self.tag}", name)


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, *, key: str = "doc_id", text: str = "text",
    end_id: int = 1, word_level: bool = False,
) -> None:
    """Write the ids of every document, each ended by ``end_id``, in ascending order of ``key``.

    ``vocabulary`` names a file of the tokenizers library on the driver; executors get its content.
    """
    from tokenizers import Tokenizer

    spark = prepare(docs.sparkSession)
    content = Path(vocabulary).read_text()
    top = max(end_id, Tokenizer.from_str(content).get_vocab_size(with_added_tokens=True) - 1)
    width = 2 if top < 1 << 16 else 4
    shared = spark.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = None, None
        number = TaskContext.get().partitionId()
        for batch in _joined(batches):
            encode = encode or Encoder(shared.value, width, word_level)
            part = part or _Part(path, number, batch.schema.field(0).type)
            part.add(batch.column(0), *encode(batch.column(1), end_id))
        if part:
            part.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([number], pa.int32()), "n_docs": [part.docs],
                "n_ids": [part.ids], "width": pa.array([width], pa.int32())})

    body = F.coalesce(F.col(text), F.lit(""))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("body"), F.col("body")]
    ordered = (
        docs.select(F.col(key).alias("key"), body.alias("body"))
        .repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    )
    ordered.mapInArrow(run, _MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The parts with their bases: how many ids all parts before hold."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    return parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class _Ids:
    """The ids of a part: a memory map of a local file, ranged reads of a remote one."""

    def __init__(self, fs: pafs.FileSystem, name: str, width: int) -> None:
        self.type, self.width = np.dtype(f"<u{width}"), width
        local = isinstance(fs, pafs.LocalFileSystem)
        self.map = np.memmap(name, self.type, "r") if local else None
        self.file = None if local else fs.open_input_file(name)

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.map is not None:
            return self.map[at]
        size = (at.stop - at.start) * self.width
        return np.frombuffer(self.file.read_at(size, at.start * self.width), self.type)


def read_tokens(
    spark: SparkSession, path: str, key_type: str = "bigint", *, checksum: bool = False
) -> DataFrame:
    """Per document: key, start (ids of all documents before it), n_tokens, and its ids.

    ``checksum`` gives, instead of the ids, the crc32 of the ids as unsigned 32-bit integers.
    """
    prepare(spark)
    last = "ids_crc32 bigint" if checksum else "ids array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from read(row)

    def read(row: dict) -> Iterator[pa.RecordBatch]:
        fs, at = _open(path)
        name = f"{at}/part-{row['part']:06d}"
        offsets = np.frombuffer(fs.open_input_stream(f"{name}.off").read(), "<i8")
        source = fs.open_input_file(f"{name}.key.arrow")
        keys = pa.ipc.open_file(source).read_all().column(0).combine_chunks()
        if len(keys) != row["n_docs"] or offsets[-1] != row["n_ids"]:
            raise ValueError(f"{name}: the files do not match the manifest")
        ids = _Ids(fs, f"{name}.bin", row["width"])
        a = 0
        while a < len(keys):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + READ_IDS, "right")) - 1)
            b = min(b, len(keys))
            block, own = ids[int(offsets[a]):int(offsets[b])], offsets[a:b + 1] - offsets[a]
            if checksum:
                wide = memoryview(block.astype("<u4").tobytes())
                sums = [zlib.crc32(wide[4 * s:4 * e]) for s, e in zip(own[:-1], own[1:])]
                value = pa.array(sums, pa.int64())
            else:
                value = pa.ListArray.from_arrays(
                    pa.array(own, pa.int32()), pa.array(block.astype("i8")))
            yield pa.RecordBatch.from_pydict({
                "key": keys[a:b], "start": pa.array(offsets[a:b] + row["base"]),
                "n_tokens": pa.array(np.diff(own)), last.split()[0]: value})
            a = b

    parts = manifest(spark, path)
    parts = parts.repartition(max(1, parts.count()))
    return parts.mapInArrow(run, f"key {key_type}, start bigint, n_tokens bigint, {last}")
