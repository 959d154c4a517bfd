"""WARC archives of individually compressed records that share a Zstandard dictionary.

A file starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record is a
frame of its own, so a reader can start at any record's offset. The dictionary is trained on a
bounded sample of the records themselves (in expectation ``SAMPLE_ROWS`` payloads, of each at most
``SAMPLE_BYTES``, chosen by hash); it only affects size. With too few records for training, the
sample itself is the dictionary; without records there are no files.

Records with equal payloads of at least ``least`` bytes are stored once: the one with the smallest
key is a response, the others are revisits that refer to it. Equal means equal SHA-256.

Files are written under a passing name and renamed; a table of files, written last, says which ones
count, so a task that runs twice or is lost does no harm.

Cases: a null payload is an empty one; a null URL has no target line; control characters of a URL
are percent-encoded; rows that repeat key and payload of a response are responses too; a null key
sorts last and is read back as null.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consentry.llm.common import prepare
from consentry.sources.staging import lookup

LEAST_BYTES = 100
DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS = 1000
SAMPLE_BYTES = 8 << 10
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"

_MAGIC = 0x184D2A5D
_CHUNK = 1 << 20
_FILES = "file string, n_records bigint, n_bytes bigint"


def dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def dictionary_frame(content: bytes) -> bytes:
    return struct.pack("<II", _MAGIC, len(content)) + content


def _as_dictionary(content: bytes) -> zstd.ZstdCompressionDict:
    return zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_AUTO)


def _record_id(key: object) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, str(key)).urn}>"


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(
    key: object, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: object
) -> bytes:
    """One WARC record. ``payload`` is None for a revisit, whose block has the HTTP header only."""
    revisit = payload is None
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {size}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(key),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else _clean(url),
        "X-Record-Key": None if key is None else _clean(str(key)),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Refers-To": _record_id(refers_to) if revisit else None,
        "X-Refers-To-Key": _clean(str(refers_to)) if revisit and refers_to is not None else None,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items() if v is not None), "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode().split(":", 1) for line in lines)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def parse(data: bytes) -> dict:
    """A record's key, url, type, payload (None of a revisit), full size, digest and reference."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _headers(head.split(b"\r\n")[1:])
    block = rest[:int(warc["content-length"])]
    if len(block) != int(warc["content-length"]) or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_headers(http.split(b"\r\n")[1:])["content-length"])
    digest = warc["warc-payload-digest"].removeprefix("sha256:")
    revisit = warc["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a WARC payload does not match its digest")
    return {
        "key": warc.get("x-record-key"), "url": warc.get("warc-target-uri"),
        "record_type": warc["warc-type"], "refers_to": warc.get("x-refers-to-key"),
        "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest,
    }


def read_file(stream) -> Iterator[bytes]:
    """The records of one archive, one frame at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != _MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    shared = _as_dictionary(stream.read(size))
    context, data = zstd.ZstdDecompressor(dict_data=shared), b""
    while True:
        data = data or stream.read(_CHUNK)
        if not data:
            return
        frame, parts = context.decompressobj(), []
        while not frame.eof:
            data = data or stream.read(_CHUNK)
            if not data:
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def write_warc(
    pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html",
    least: int = LEAST_BYTES,
) -> None:
    """Write a record per row of ``pages`` to archives under ``path``."""
    spark = prepare(pages.sparkSession)
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"),
        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("size", F.octet_length("payload").cast("bigint"))
    long = rows.filter(F.col("size") >= least)
    first = lookup(
        long.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n"))
        .filter("n > 1").select("digest", "first", F.lit(True).alias("again")))
    # Short payloads cannot match: their join key is null.
    match = F.when(F.col("size") >= least, F.col("digest"))
    rows = rows.withColumn("match", match).join(
        first.withColumnRenamed("digest", "match"), "match", "left")
    revisit = F.coalesce(F.col("again") & ~F.col("key").eqNullSafe(F.col("first")), F.lit(False))
    rows = rows.select(
        "key", "url", "digest", "size", "first", F.when(~revisit, F.col("payload")).alias("payload"))

    # Rows are sampled one by one by a hash of payload and key, so copies weigh as in the archive.
    n = pages.count()
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    u = F.xxhash64(body, F.col(key)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    head = F.substring(body, F.lit(1), F.lit(SAMPLE_BYTES))
    sample = pages.filter((u < SAMPLE_ROWS / max(n, 1)) & (F.octet_length(body) > 0)).select(
        u.alias("u"), head.alias("s")).orderBy("u", "s")
    content = dictionary([bytes(r.s) for r in sample.collect()])
    shared = spark.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, fs, final = None, 0, None, ""
        context = zstd.ZstdCompressor(level=LEVEL, dict_data=_as_dictionary(shared.value))
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    fs, at = pafs.FileSystem.from_uri(path)
                    fs.create_dir(at, recursive=True)
                    name = f"archive-{TaskContext.get().partitionId():06d}.warc.zst"
                    final, passing = f"{at}/{name}", f"{at}/{name}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(passing, compression=None)
                    out.write(dictionary_frame(shared.value))
                data = record(r["key"], r["url"], r["payload"], r["size"], r["digest"], r["first"])
                out.write(context.compress(data))
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            fs.move(passing, final)
            yield pa.RecordBatch.from_pydict({
                "file": [final.rsplit("/", 1)[1]], "n_records": [n], "n_bytes": [size]})

    rows.mapInArrow(run, _FILES).write.mode("overwrite").parquet(f"{path}/files")


def read_warc(
    spark: SparkSession, path: str, key_type: str = "bigint", *, payload: bool = True
) -> DataFrame:
    """A row per record: key, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Payloads are checked against their digests; without ``payload`` they are not handed out.
    """
    prepare(spark)
    columns = ["key", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    types = {c: pa.string() for c in columns} | {"payload_bytes": pa.int64()}
    types |= {"payload": pa.binary()} if payload else {}
    schema = pa.schema(list(types.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                held, size, n = [], 0, 0
                name = f"{at}/{row['file']}"
                with fs.open_input_stream(name, compression=None) as stream:
                    for data in read_file(stream):
                        held.append(parse(data))
                        size, n = size + len(data), n + 1
                        if size > 8 * _CHUNK:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if n != row["n_records"]:
                    raise ValueError(f"{row['file']}: {n} records, {row['n_records']} written")
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    names = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}
    ddl = ", ".join(f"{c} {names[t]}" for c, t in types.items())
    files = spark.read.schema(_FILES).parquet(f"{path}/files")
    files = files.repartition(max(1, files.count()))
    return files.mapInArrow(run, ddl).withColumns(
        {c: F.col(c).cast(key_type) for c in ("key", "refers_to")})
