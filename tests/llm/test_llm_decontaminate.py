import re

from hypothesis import given, settings
from hypothesis import strategies as st

from consentry.llm import decontaminate as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORDS.findall(lower)


def brute(text, items, window):
    doc, hit, found = words(text), set(), set()
    for key, item in items:
        w = words(item)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            for b in range(len(doc) - n + 1):
                if doc[b:b + n] == w[a:a + n]:
                    hit.update(range(b, b + n))
                    found.add(key)
    return len(doc), len(hit), found


tokens = st.lists(st.sampled_from("a b c A é 1".split()), max_size=40).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(tokens, st.lists(tokens, max_size=5), st.integers(1, 6))
def test_search_equals_brute_force(text, items, window):
    items = list(enumerate(items))
    search = D.Search([(k, t.encode()) for k, t in items], window)
    found = D.words_of(text.encode())
    spans, ids = search(found)
    assert (len(found), sum(b - a for a, b in spans), ids) == brute(text, items, window)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words(text):
    assert [w.decode() for w in D.words_of(text.encode())] == words(text)


SCHEMA = "doc_id bigint, text string, items string, n_words int"
ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
         (2, "Short item"), (2, "short ITEM"), (3, None), (4, "..."), (None, "nameless item here")]
DOCS = [(1, "x ONE two three four five six seven-eight nine ten eleven twelve thirteen y", "c", 1),
        (2, "a short item, a short item", "c", 1), (3, None, None, None), (4, "", "c", 1),
        (5, "two three four five six seven eight nine ten eleven twelve thirteen", "c", 1),
        (6, "w " * 60 + "short item", "c", 1), (None, "the nameless item here", "c", 1),
        (6, "w " * 60 + "short item", "c", 1)]


def check(spark, **options):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    out = D.find_items(docs, items, **options).select(
        "row.*", "hits", D.contaminated().alias("bad"), D.n_hit().alias("n_hit"),
        "n_words", "items").collect()
    assert len(out) == len(DOCS)
    for r in out:
        n, hit, found = brute(r.text, ITEMS, 13)
        assert (r[-2], r.n_hit, set(r[-1])) == (n, hit, found - {None})
        assert r.bad == (hit > 0 and 20 * hit >= n)
        assert r[2] == (None if r.text is None else "c")


def test_rows_keep_their_columns(spark):
    check(spark)


def test_items_in_several_passes(spark):
    check(spark, max_bytes=20)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert all(r.hits == [] for r in D.find_items(docs, items).collect())
    assert D.find_items(docs.limit(0), items).collect() == []


def test_repeated_items_are_broadcast_once(spark, monkeypatch):
    context, sent = type(spark.sparkContext), []
    broadcast = context.broadcast

    def record(self, value):
        sent.append(value)
        return broadcast(self, value)

    monkeypatch.setattr(context, "broadcast", record)
    docs = spark.createDataFrame(DOCS, SCHEMA)
    items = spark.createDataFrame(ITEMS * 50, "item_id bigint, text string")
    out = D.find_items(docs, items, max_bytes=200).select("row.*", "items").collect()
    assert len(sent) == 1 and sum(len(body) for _, body in sent[0]) <= 200
    assert len(sent[0]) == 5
    assert all(set(r[-1]) == brute(r.text, ITEMS, 13)[2] - {None} for r in out)
