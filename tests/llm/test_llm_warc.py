import hashlib
import struct
from pathlib import Path

import zstandard

from consentry.llm import warc

SCHEMA = "page_id bigint, url string, html string, digest string, first bigint"


def archived(spark, folder, rows):
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    warc.write_warc(pages, folder)
    return warc.read_warc(spark, folder).collect()


ROWS = [
    (4, "http://a/4", "é" * 60), (2, "http://a/2", "é" * 60), (9, None, "é" * 60),
    (1, "http://a/1", "short"), (3, "http://a/3", "short"), (5, "http://a/\r\nX: 1", None),
    (6, "http://a/6", ""), (7, "http://a/7", "z" * 100), (8, "http://a/8", "z" * 100),
    (10, "http://a/10", "z" * 99), (11, "http://a/11", "z" * 99), (None, "u", "z" * 100),
    (2, "http://a/2", "é" * 60),
]


def test_round_trip(spark, folder):
    got = {(r.key, r.url): r for r in archived(spark, folder, ROWS)}
    full = {k: (h or "").encode() for k, _, h in ROWS}
    for (key, url), r in got.items():
        body = full[key]
        assert r.payload_bytes == len(body)
        assert r.payload_digest == hashlib.sha256(body).hexdigest()
        assert r.payload == (None if r.record_type == "revisit" else body)
    refers = {k: r.refers_to for (k, _), r in got.items()}
    assert {k: v for k, v in refers.items() if v is not None} == {4: 2, 9: 2, 8: 7, None: 7}
    assert got[5, "http://a/%0D%0AX:%201"].payload == b""
    assert (9, None) in got


def test_repeated_smallest_rows_are_both_responses(spark, folder):
    got = [r for r in archived(spark, folder, ROWS) if r.key == 2]
    assert [r.record_type for r in got] == ["response", "response"]


def test_file_layout(spark, folder, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    warc.write_warc(pages, folder)
    files = list(Path(folder).glob("*.warc.zst"))
    plain = packed = 0
    for f in files:
        data = f.read_bytes()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D and 0 < size <= warc.DICTIONARY_BYTES
        shared = zstandard.ZstdCompressionDict(data[8:8 + size])
        assert shared.dict_id()  # trained, not raw
        rest, n = data[8 + size:], 0
        while rest:
            one = zstandard.ZstdDecompressor(dict_data=shared).decompressobj()
            assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
            packed += len(rest) - len(one.unused_data)
            rest, n = one.unused_data, n + 1
        assert n
    plain = sum(len(r.html.encode()) for r in pages.collect())
    assert packed < 0.5 * plain


def test_no_pages(spark, folder):
    assert archived(spark, folder, []) == []


def test_cut_archives_are_refused():
    data = warc.record(1, "u", b"body", 4, hashlib.sha256(b"body").hexdigest(), None)
    assert warc.parse(data)["payload"] == b"body"
    for broken in (data[:-1], data.replace(b"body", b"bodx")):
        try:
            warc.parse(broken)
        except ValueError:
            continue
        raise AssertionError("accepted")
