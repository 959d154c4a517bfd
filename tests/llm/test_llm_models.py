"""Language and quality: held-out accuracy, agreement with plain versions, and edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from consentry.llm import language, quality
from consentry.llm.common import fold
from consentry.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def crc(key):
    return zlib.crc32(str(key).encode())


def test_fold(spark):
    rows = spark.range(200).select("id", fold("id", 4).alias("f")).collect()
    assert all(r.f == crc(r.id) % 4 for r in rows)
    assert spark.sql("SELECT CAST(null AS bigint) AS id").select(fold("id", 3)).first()[0] == 0


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op4_language"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(truth)
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.rejected for r in held]) < 0.05


def test_language_vectors_of_long_texts_are_whole(monkeypatch):
    text = ("Der Hund läuft. " * 50).encode()
    whole = language.counts(text)
    monkeypatch.setattr(language, "_PIECE", 37)
    assert (language.counts(text) == whole).all()
    grams = len(b" ".join(text.translate(language._LETTERS).split())) + 2
    assert whole.sum() == 2 * grams - 3


TEXTS = ["the cat sat on the mat and the dog", "der hund und die katze sind nicht da"]


def test_language_edge_cases(spark):
    rows = [(k, TEXTS[k % 2] + f" {'xy'[k % 2]}" * (k // 2), "ed"[k % 2] + "n", "s", 0.5)
            for k in range(20)] + [(90, "no language", None, "s", 0.5), (91, None, "en", "s", 0.5)]
    schema = "doc_id int, text string, lang string, row string, score double"
    model = language.fit(spark.createDataFrame(rows, schema))
    assert set(model.languages) == {"en", "dn"}
    odd = [(1, None), (2, ""), (3, "12 34 !?"), (4, TEXTS[0]), (5, TEXTS[1].upper()), (6, "é"),
           (7, "zzqq xxqq " * 30), (8, "語")]
    got = language.predict(spark.createDataFrame(
        [(k, t, "en", "s", 0.5) for k, t in odd], schema), model).select(
        "row.doc_id", "lang_pred", F.col("score").alias("p"), "rejected").collect()
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in range(1, 6)] == ["und", "und", "und", "en", "dn"]
    assert all(by[k].p == 0 and by[k].rejected for k in (1, 2, 3))
    assert by[6].lang_pred != "und" and by[8].lang_pred != "und" and by[7].rejected
    assert not by[4].rejected


def test_language_that_is_mostly_copies_is_learned(spark):
    """20,000 copies of one text leave the other texts of the language in the model."""
    words = "und der hund die katze sind nicht da wir gehen heute nach haus".split()
    other = [" ".join(words[(k * j) % len(words)] for j in range(1, 9)) for k in range(1, 31)]
    rows = spark.createDataFrame(
        [(t, "dn") for t in other] + [(TEXTS[0] + " x" * k, "en") for k in range(30)],
        "text string, lang string")
    copies = spark.range(20_000).select(F.lit("ein text der oft da ist").alias("text"),
                                        F.lit("dn").alias("lang"))
    plain, skewed = (language.fit(df, sample=40) for df in (rows, rows.union(copies)))
    assert plain.languages.count("dn") == skewed.languages.count("dn") == language.CENTROIDS
    got = language.predict(rows, skewed).select("row.lang", "lang_pred").collect()
    assert all(r.lang == r.lang_pred for r in got)


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id int, text string, lang string")
    model = language.fit(docs)
    got = language.predict(docs, model).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert language.predict(docs.limit(0), model).collect() == []


def plain_scores(train, labels, texts):
    """Quadratic discriminant with explicit covariances, inverses and determinants."""
    x, y = np.array([quality.statistics(t) for t in train]), np.array(labels)
    t = np.array([quality.statistics(t) for t in texts])
    d, n = x.shape[1], len(x)
    centred = {k: x[y == k] - x[y == k].mean(0) for k in (0, 1)}
    pooled = sum(c.T @ c for c in centred.values()) / n
    unit = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    logs = []
    for k in (0, 1):
        own = centred[k].T @ centred[k] / len(centred[k])
        cov = ((1 - quality.POOLED) * own + quality.POOLED * pooled) / np.outer(unit, unit)
        cov = (1 - quality.IDENTITY) * cov + quality.IDENTITY * np.trace(cov) / d * np.eye(d)
        z = (t - x[y == k].mean(0)) / unit
        far = np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)
        logs.append(-0.5 * far - 0.5 * np.linalg.slogdet(cov)[1] + np.log((y == k).mean()))
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def test_quality_equals_plain_version_and_holds_out(spark):
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    train = [k for k in labels if crc(k) % 3 != 1]
    keys = sorted(docs)
    want = plain_scores([docs[k] for k in train], [labels[k] for k in train], [docs[k] for k in keys])
    got = {r.doc_id: r for r in QUERIES["op10_quality"](spark, SF).collect()}
    assert sorted(got) == keys
    assert np.allclose([got[k].score for k in keys], want, atol=1e-6)
    assert all(r.held_out == (crc(k) % 3 == 1) and r.predicted == (r.score >= 0.5)
               for k, r in got.items())
    held = [k for k in labels if crc(k) % 3 == 1]
    assert np.mean([got[k].predicted == labels[k] for k in held]) > 0.97


def test_quality_edge_cases(spark):
    rows = [(k, "clean words in a plain line", 1) for k in range(5)] + [(9, "### $$$ !!!", 0)] + [
        (10, None, 0), (11, "", None), (12, "x", 7)]
    df = spark.createDataFrame(rows, "score int, text string, label int")
    model = quality.fit(quality.features(df).select("features", "row.label"))
    got = quality.score(df, model, text="text").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    one_class = df.filter("label = 1")
    model = quality.fit(quality.features(one_class).select("features", "row.label"))
    assert {r.score for r in quality.score(df, model, text="text").collect()} == {0.5}
    assert quality.score(df.limit(0), model, text="text").collect() == []


@pytest.mark.parametrize("text", [None, b"", b"\n \t", b"a" * 200_000, "é".encode()])
def test_statistics_are_finite(text):
    assert np.isfinite(quality.statistics(text)).all()
