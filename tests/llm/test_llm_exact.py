import re

import pytest

from consentry.llm import exact

SCHEMA = "doc_id bigint, text string, kept string, id int"


def brute(rows):
    groups = {}
    for key, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(key)
    out = []
    for key, text, *_ in rows:
        keys = groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")]
        known = [k for k in keys if k is not None]
        out.append((key, min(known) if known else None, len(keys)))
    return sorted(out, key=repr)


def found(spark, rows):
    df = exact.exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    return df, sorted(((r.key, r.keep_key, r.group_size) for r in df), key=repr)


def test_nulls_blanks_ties_and_clashing_columns(spark):
    rows = [(3, "a  b", "x", 1), (1, "a\tb", "y", 2), (2, None, None, None), (5, "", "", 0),
            (None, "a\nb", "z", 3), (7, " ", "", 1), (8, "c", "", 1), (8, "c", "", 1),
            (9, " ", "", 1), (10, "\t \n", "", 1)]
    df, got = found(spark, rows)
    assert got == brute(rows)
    # One row of each group stays, also if its id is repeated.
    kept = [r for r in df if r.kept]
    assert len(kept) == len({r.sha256 for r in df}) == 5
    assert all(r.key == r.keep_key for r in kept)


def test_texts_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact, "LEAD_BYTES", 4)
    long = "".join(chr(97 + (i * i) % 26) for i in range(5000))
    rows = [(k, t, "", 0) for k, t in enumerate(
        [long, long[:-1] + "!", long, "!" + long[1:], long[:2500] + "!" + long[2501:],
         long + "a", long[:100], long[:100], long[:99] + "é", "", "abcd", "abcd"])]
    name = exact.name_texts
    monkeypatch.setattr(exact, "name_texts", lambda t: name(t, block_bytes=16))
    assert found(spark, rows)[1] == brute(rows)


def test_equal_length_and_beginning_but_different(spark):
    rows = [(k, "x" * 200 + str(k % 3) + "y" * 9000, "", 0) for k in range(30)]
    assert found(spark, rows)[1] == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)]])
def test_empty(spark, rows):
    assert found(spark, rows)[1] == brute(rows)
