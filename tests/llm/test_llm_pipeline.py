"""The corpus pipeline, stage by stage against plain versions, each on its own input."""

import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from test_llm_decontaminate import brute as contamination
from test_llm_mixing import plain as raked
from test_llm_models import crc, plain_scores
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from consentry.llm import mixing
from consentry.sources.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows before the first and after every stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for _, step in pipeline.STAGES:
        docs = stage(step(spark, docs, sf_dir))
        out.append(docs.collect())
    assert all(list(r.asDict()) == COLUMNS for rows in out[:-1] for r in rows[:1])
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_stages_are_named_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    assert pipeline.ORACLE_SQL is None


def test_quality(spark, sf_dir, stages):
    docs = {r.doc_id: r.text.encode() for r in stages[0]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    train = [k for k in labels if crc(k) % 3 != 1]
    keys = sorted(docs)
    score = plain_scores([docs[k] for k in train], [labels[k] for k in train], [docs[k] for k in keys])
    assert ids(stages[1]) == [k for k, s in zip(keys, score) if s >= 0.5]
    assert 0 < len(stages[1]) < len(keys)


def test_near_dedup(stages):
    rows = sorted(stages[1], key=lambda r: r.doc_id)
    classes = brute.near_classes([r.text for r in rows], 5)
    assert ids(stages[2]) == [rows[k].doc_id for k, (_, c) in enumerate(classes) if c == k]


def test_decontaminate(spark, sf_dir, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {}
    for _, text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text))
        n = min(13, len(w))
        windows.setdefault(n, set()).update(tuple(w[k:k + n]) for k in range(len(w) - n + 1))
    keep = []
    for r in stages[2]:
        w, hit = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(r.text)), set()
        for n, found in windows.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in found:
                    hit.update(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            keep.append(r.doc_id)
    assert ids(stages[3]) == sorted(keep)
    assert contamination(items[0][1], items, 13)[2] >= {items[0][0]}


def test_mix(spark, stages):
    docs = spark.createDataFrame(stages[3])
    rows = mixing.mix(docs).collect()
    cells = {}
    for r in rows:
        at = (r.source, r.lang, r.topic)
        cells[at] = cells.get(at, 0) + len(brute.BLANK_WORD.findall(r.row.text))
    _, p = raked(cells, mixing.TARGETS, 0.8)
    sure = {r.row.doc_id: r.u < p[r.source, r.lang, r.topic] for r in rows
            if abs(r.u - p[r.source, r.lang, r.topic]) > 0.01}
    kept = set(ids(stages[4]))
    assert {k for k, keep in sure.items() if keep} <= kept
    assert not {k for k, keep in sure.items() if not keep} & kept
    assert len(sure) > 0.9 * len(rows)


def test_tokens(stages):
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    base = 0
    got = {r.doc_id: r for r in stages[5]}
    for r in sorted(stages[4], key=lambda r: r.doc_id):
        found = [*encode(r.text, add_special_tokens=False).ids, 1]
        mine = got.pop(r.doc_id)
        crc32 = zlib.crc32(np.array(found, "<u4").tobytes())
        assert (mine.start, mine.n_tokens, mine.ids_crc32) == (base, len(found), crc32)
        base += len(found)
    assert not got


def test_run_is_its_stages(spark, sf_dir, stages):
    assert sorted(pipeline.run(spark, sf_dir).collect()) == sorted(stages[-1])


def test_awkward_rows(spark, sf_dir):
    """Every stage takes nulls, empty and long texts, repeated rows, further columns and no rows."""
    rows = [(None, None, None, None, None, 1.0), (1, "", "en", "s", 0, 1.0),
            (2, "plain words in a clean sentence " * 4000, "en", None, 9, 2.0),
            (3, "another clean sentence of plain words", None, "s", 9, None),
            (3, "another clean sentence of plain words", None, "s", 9, None)]
    schema = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
              "score double")
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, step in pipeline.STAGES:
            out = stage(step(spark, docs, sf_dir))
            if name != "tokens":
                assert out.columns == docs.columns
            out.collect()
            step(spark, docs.limit(0), sf_dir).collect()
