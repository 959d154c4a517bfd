"""Text linking: expected links written out."""

import pytest

from consentry.operators import linking
from consentry.spec import KEY, REDACTED

SCHEMA = ("beneficiary_id string, full_name string, national_id string, phone string, "
          "row_order bigint")


#: Registry order is the last number, not the order here.
PEOPLE = [
    ("REG-0001", "Ali Otieno", "00000017", "+254700000001", 50),
    ("REG-0002", "Alice  Njeri", "00000034", "+254700000002", 20),
    ("REG-0003", "Élan", "00000051", "+254700000003", 40),
    ("REG-0004", "O'Neil Kamau", "00000068", "+254700000004", 10),
    ("REG-0005", "Anne-Marie Achieng", "00000085", "+254700000005", 30),
    ("REG-0006", REDACTED, "00000102", "+254700000006", 1),
    ("REG-0007", "", "00000119", "+254700000007", 60),
]
LONG = "kindly show those records " * 40
#: Text, record by id and first name alone, record by all keys.
LINKS = [
    ("", None, None),
    ("nobody here", None, None),
    ("show ALICE please", "REG-0002", "REG-0002"),
    ("for ali", "REG-0001", "REG-0001"),
    ("an italian dish", "REG-0001", "REG-0001"),
    ("reg-0003 or reg-0005", "REG-0005", "REG-0005"),
    ("REG-0001 and o'neil", "REG-0004", "REG-0004"),
    ("ask élan!", "REG-0003", "REG-0003"),
    ("anne-marie, or Anne", "REG-0005", "REG-0005"),
    ("REG-0006", None, None),
    ("[redacted", None, None),
    ("my id is 00000051", None, "REG-0003"),
    ("00000102", None, None),
    ("call 254700000005", None, "REG-0005"),
    ("+2547+00000001", None, "REG-0001"),
    ("+254700000007", None, "REG-0007"),
    (LONG + "reg-0003 " + LONG, "REG-0003", "REG-0003"),
    (LONG + "00000068" + LONG, None, "REG-0004"),
] + [("." * (512 + shift) + "reg-0005" + "." * 700, "REG-0005", "REG-0005")
     for shift in range(-9, 3)]  # across the border of two pieces


@pytest.mark.parametrize("kinds, place", [(linking.NARROW, 1), (linking.WIDE, 2)])
def test_substring_links(spark, kinds, place):
    got = {r.msg_id: r[KEY] for r in linking.link_messages(
        spark.createDataFrame([(n, m[0]) for n, m in enumerate(LINKS)], "msg_id bigint, text string"),
        spark.createDataFrame(PEOPLE, SCHEMA).repartition(3), kinds).collect()}
    for n, link in enumerate(LINKS):
        assert got.get(n) == link[place], link[0][:40]


def test_whole_words_only(spark):
    rows = [("REG-1", "Ali", "00000017", "+254711", 5), ("REG-2", "Alice X", "00000034", "+254722", 9)]
    messages = ["for alice", "alicex", "ali.", "call 254722!", "+254711", "nobody"]
    got = {r.msg_id: r[KEY] for r in linking.link_messages_tokens(
        spark.createDataFrame(list(enumerate(messages)), "msg_id bigint, text string"),
        spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: "REG-2", 2: "REG-1", 3: "REG-2", 4: "REG-1"}


def test_a_shared_name_yields_one_key(spark):
    rows = [(f"REG-{k}", "Jane X", f"{k:08d}", f"+{k}", 1000 - k) for k in range(500)]
    keys = linking.link_keys(spark.createDataFrame(rows, SCHEMA), ("first_name",)).collect()
    assert [(r.key, r.record[KEY]) for r in keys] == [("jane", "REG-499")]


def test_empty_registry_links_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    messages = spark.createDataFrame([(1, "jane")], "msg_id bigint, text string")
    assert linking.link_messages(messages, none).count() == 0


def test_keys_are_sorted_by_a_hash(spark):
    keys = linking.link_keys(spark.createDataFrame(PEOPLE, SCHEMA))
    assert keys.columns == ["plus", "key", "record"]
    assert "SortAggregate(key=[_groupingexpression" in keys._jdf.queryExecution().executedPlan().toString()
