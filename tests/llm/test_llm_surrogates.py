import re

import pytest
from pyspark.sql import functions as F

from consentry.llm import surrogates
from consentry.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, clean string, id int"


def cleaned(spark, texts, key="k"):
    rows = [(k, t, "c", 1) for k, t in enumerate(texts)]
    got = surrogates.replace(spark.createDataFrame(rows, SCHEMA), key=key).collect()
    assert sorted(r.row.doc_id for r in got) == list(range(len(texts)))
    assert all(r.row.clean == "c" and r.row.text == texts[r.row.doc_id] for r in got)
    return [r.clean for r in sorted(got, key=lambda r: r.row.doc_id)]


#: Where entities stand, by a Python pattern of its own for the kinds that the tables hold.
TABLE_ENTITY = re.compile(
    r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\bAKIA[0-9A-Z]{16}\b|(?<=password=)\w+|(?<=token = \")\w+"
    r"|\+\d \(\d{3}\) \d{3}-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{16}\b")


def shape(text):
    text = re.sub(r"[a-zà-öø-ÿ]", "a", text)
    return re.sub(r"\d", "9", re.sub(r"[A-ZÀ-ÖØ-Þ]", "A", text))


def test_query_replaces_all_and_nothing_else(spark):
    sf = "/root/testdata/sf0.01"
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    new = {r.doc_id: r for r in QUERIES["op9_surrogates"](spark, sf).collect()}
    assert set(new) == set(old)
    to, back = {}, {}
    for key, text in old.items():
        was, now = TABLE_ENTITY.findall(text), new[key].text
        assert new[key].n_entities == len(was)
        others = TABLE_ENTITY.findall(now)
        assert TABLE_ENTITY.split(now) == TABLE_ENTITY.split(text)
        for a, b in zip(was, others):
            assert a != b
            if "." not in a or "@" in a:
                assert len(a) == len(b)
            if "@" not in a and not re.fullmatch(r"[0-9a-f]+|[\d.]+", a):
                assert shape(a) == shape(b)
            assert to.setdefault(a, b) == b and back.setdefault(b, a) == a
    originals = set(to)
    assert len(originals) > 20 and not originals & set(back)


def test_coreference_formats_and_names(spark):
    one, two, three, four = cleaned(spark, [
        "Mr. John Smith (john.smith@mail.example.com); Smith called +1 (017) 555-7713, +1-017-555-7713.",
        "Mr Smith, MR X, JOHN.SMITH@MAIL.EXAMPLE.COM, 4111 1111 1111 1111 or 4111-1111-1111-1111",
        "Frau Anna Smith. ANNA! Annas", "Госпожа Анна Петрова; г-н Иванов; Κύριος Νίκος"])
    given, surname = re.match(r"Mr\. (\w+) (\w+) \(", one).groups()
    assert f"{surname} called" in one and "Smith" not in one and "John" not in one
    assert given.lower().endswith(tuple(surrogates.ENDINGS["Latin", "m"].split()))
    assert f"Mr {surname}," in two
    mail = re.search(r"\((\S+@\S+)\)", one)[1]
    assert mail.upper() in two
    numbers = [re.sub(r"\D", "", m) for m in re.findall(r"\+1[\d ()-]+\d", one)]
    assert numbers[0] == numbers[1] != "10175557713" and "+1-" in one
    cards = [re.sub(r"\D", "", m) for m in re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", two)]
    assert cards[0] == cards[1] != "4111111111111111" and cards[0][0] == "4"
    digits = [int(c) for c in cards[0]][::-1]
    assert sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    anna = re.match(r"Frau (\w+) (\w+)\.", three)
    assert anna[2] == surname and "Anna" not in three.replace("Annas", "")
    assert anna[1].lower().endswith(tuple(surrogates.ENDINGS["Latin", "f"].split()))
    assert re.fullmatch(r"Госпожа [А-Я][а-я]+ [А-Я][а-я]+; г-н [А-Я][а-я]+; Κύριος [Α-Ω][α-ως]+", four)
    assert "Петрова" not in four and "Νίκος" not in four


def test_collisions_are_drawn_anew(spark, monkeypatch):
    """So few names are possible that first draws collide; all stay apart in the end."""
    monkeypatch.setattr(surrogates, "SYLLABLES", dict.fromkeys(surrogates.SYLLABLES, "ba be"))
    names = [f"Mr {a}{b}son" for a in "ABCDE" for b in "aei"]
    got = cleaned(spark, names)
    assert len(set(got)) == len(names) and not set(got) & set(names)


def test_a_space_that_is_too_small_is_refused(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "SYLLABLES", dict.fromkeys(surrogates.SYLLABLES, "ba"))
    monkeypatch.setattr(surrogates, "ENDINGS", dict.fromkeys(surrogates.ENDINGS, "x"))
    monkeypatch.setattr(surrogates, "DRAWS", 3)
    with pytest.raises(ValueError, match="collide"):
        cleaned(spark, [f"Mr {a}son" for a in "ABCDEF"])


def test_more_names_than_short_surrogates(spark, monkeypatch):
    """Names of two or three syllables are 24 here; 60 names are kept apart by longer ones."""
    monkeypatch.setattr(surrogates, "SYLLABLES", dict.fromkeys(surrogates.SYLLABLES, "ba be"))
    monkeypatch.setattr(surrogates, "ENDINGS", dict.fromkeys(surrogates.ENDINGS, "x z"))
    names = [f"Mr {a}{b}{c}son" for a in "ABCDEF" for b in "aeiou" for c in "lm"]
    got = cleaned(spark, names)
    assert len(set(got)) == len(names) and not set(got) & set(names)


def test_key_matters(spark):
    texts = ["mail a.b@c.example.com now"]
    assert cleaned(spark, texts) == cleaned(spark, texts) != cleaned(spark, texts, key="other")


def test_clean_texts_stay(spark):
    texts = [None, "", " ", "version 4.0, 3.14 and 2024-12-03", "1.2.3", "a@b", "x" * 100_000,
             "12 of 15; 1,000,000.00", "the Mr is a title"]
    assert cleaned(spark, texts) == texts


@pytest.mark.parametrize("prefix", [
    "password=", "passwd=", "secret=", "api_key=", "token=", "password: ", 'token = "'])
def test_a_secret_alone_without_digits_is_found(spark, prefix):
    text = prefix + "correct-horse-battery"
    rows = spark.createDataFrame([(1, text, "", 1)], SCHEMA)
    got = surrogates.replace(rows, key="k").first()
    assert got.n_entities == 1 and got.clean.startswith(prefix)
    assert "correct" not in got.clean and len(got.clean) == len(text)


@pytest.mark.parametrize("entity", ["AKIA" + "QWERTYUIOPASDFGH", "abcdefab" * 4])
def test_a_key_alone_without_digits_is_found(spark, entity):
    got = surrogates.replace(
        spark.createDataFrame([(1, f"the {entity} one", "", 1)], SCHEMA), key="k").first()
    assert got.n_entities == 1 and entity not in got.clean


def test_no_part_of_an_entity_stays_in_any_script(spark):
    """Also secrets that have nothing but separators, and shapes with few choices."""
    words = ["パスワード鍵語", "密码安全登录", "비밀번호열쇠말", "كلمةالسروقت", "סיסמאחדשה", "रहस्यमयकुंजी",
             "สวัสดีชาวโลก", "١٢٣٤٥٦٧٨", "ᏣᎳᎩᏗᏍᎦᏃ", "Ⅳ²³ⅧⅨⅩ"]
    marks = ["password=........", "secret=________", "token=-/-/-/"]
    few = [f"secret=.....{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    texts = [f"password={w}" for w in words] + [f"to {w}@{w}.com now" for w in words] + marks + few
    got = cleaned(spark, texts)
    for word, secret, mail in zip(words, got, got[len(words):]):
        new = secret.removeprefix("password=")
        local, domain = re.fullmatch(r"to ([^@ ]+)@([^@ ]+)\.\w+ now", mail).groups()
        for other in (new, local, domain):
            # A character may stand for itself by chance; no part does.
            assert len(other) == len(word) and sum(a == b for a, b in zip(word, other)) <= 3
    assert len(set(got)) == len(texts) and not set(got) & set(texts)
    assert all(re.search(r"=[a-z0-9]+$", t) for t in got[2 * len(words):2 * len(words) + 3])


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a.b@c.example.com", "", 1), (1, "a.b@c.example.com", "", 2),
            (None, "at 10.1.2.3", "", 1), (1, "10.1.2.3 again", "", 1)]
    got = surrogates.replace(spark.createDataFrame(rows, SCHEMA), key="k").collect()
    assert len(got) == 4 and all(r.n_entities == 1 for r in got)
    mails = {r.clean for r in got if "@" in r.clean}
    assert len(mails) == 1
    ips = {re.search(r"[\d.]{7,}", r.clean)[0] for r in got if "@" not in r.clean}
    assert len(ips) == 1 and "10.1.2.3" not in ips


def test_empty_table(spark):
    assert cleaned(spark, []) == []


def test_plan_has_no_python(spark):
    docs = spark.range(3).select("id", F.lit("a.b@c.example.com").alias("text"))
    plan = surrogates.replace(docs, key="k", doc_key="id")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
