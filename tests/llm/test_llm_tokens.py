import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from consentry.llm import tokens
from consentry.llm.queries import QUERIES

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
VOCABULARY, WHOLE = Path(WORD).read_text(), Tokenizer.from_file(WORD)
TEXTS = ["Hello, World! it's", None, "", " \t\n", "a b c d\x1ce", "é ế ΣΑΣ Σ",
         "x\x01 \x01y THE. don't. Don'T; «Σ». e\u0301. E\u0301! a.b c..",
         "I'm 12 3/4 ''ll", "word " * 3000, "Hello, World! it's"]


def expected(path, texts, end):
    t = Tokenizer.from_file(path)
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


@pytest.mark.parametrize("path, end, word_level, width", [
    (WORD, 1, True, 2), (WORD, 1, False, 2), (BYTE, 50256, False, 2), (WORD, 70000, True, 4)])
def test_round_trip(spark, folder, path, end, word_level, width):
    keys = [7, 3, None, 5, 4, 9, 1, 8, 2, 6]
    docs = spark.createDataFrame(
        [(k, t, 1, 2) for k, t in zip(keys, TEXTS)], "doc_id bigint, text string, key int, part int")
    tokens.write_tokens(docs.repartition(3), folder, path, end_id=end, word_level=word_level)
    ids = dict(zip(keys, expected(path, TEXTS, end)))
    got = tokens.read_tokens(spark, folder).orderBy("start").collect()
    order = sorted(keys, key=lambda k: (k is not None, k))
    assert [r.key for r in got] == order
    base = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids) == (base, len(ids[r.key]), ids[r.key])
        base += r.n_tokens
    size = sum(f.stat().st_size for f in Path(folder).glob("*.bin"))
    assert size == base * width
    assert not [f for f in Path(folder).iterdir() if len(f.suffix) > 20]  # no passing names left


def test_query_equals_encoding_whole_texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    base = 0
    got = {r.doc_id: r for r in QUERIES["op7_token_files"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for row, ids in zip(rows, expected(WORD, [r.text for r in rows], 1)):
        r = got[row.doc_id]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (r.start, r.n_tokens, r.ids_crc32) == (base, len(ids), crc)
        base += len(ids)


def test_words_beyond_the_remembered(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "_WORDS", {})
    monkeypatch.setattr(tokens, "REMEMBERED", 4)
    encode = tokens.Encoder(Path(WORD).read_text(), 2, True)
    texts = ["one two three", "four five six one two", "seven one", "two two one"]
    for text in texts:
        ids, size = encode(pa.array([text, ""]), 1)
        assert ids.tolist() == [*expected(WORD, [text], 1)[0], 1] and size[1] == 1


def test_repeated_keys_and_many_parts(spark, folder):
    docs = spark.range(200).select(
        (F.col("id") % 5).alias("doc_id"), F.concat(F.lit("t "), F.col("id")).alias("text"))
    tokens.write_tokens(docs, folder, WORD)
    got = tokens.read_tokens(spark, folder, checksum=True).orderBy("start").collect()
    assert [r.key for r in got] == sorted(r.key for r in got) and len(got) == 200
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_special_tokens_in_texts():
    import pyarrow as pa

    encode = tokens.Encoder(Path(WORD).read_text(), 2, True)
    texts = ["<|endoftext|> X.", "<|ENDOFTEXT|> x, y."]
    ids, _ = encode(pa.array(texts), 1)
    assert ids.tolist() == sum(expected(WORD, texts, 1), [])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30) | st.sampled_from(
    ["it's.", "'S,", "a,b.", "x!?", "I.", "ΑΣ.", "9.", "é,", "\x01.", "e\u0301."]), max_size=6))
def test_words_are_encoded_as_in_the_whole_text(parts):
    import pyarrow as pa

    text = " ".join(parts)
    ids, _ = tokens.Encoder(VOCABULARY, 2, True)(pa.array([text]), 1)
    assert ids[:-1].tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_no_documents(spark, folder):
    tokens.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), folder, WORD)
    assert tokens.read_tokens(spark, folder).collect() == []
