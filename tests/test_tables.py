"""The adapters keep what the tables hold."""

import datetime as dt

from consentry.sources import tables


def test_messages_hold_the_whole_text_of_every_user_turn(spark, sf_dir):
    turns = tables.load(spark, sf_dir, "conversations").filter("role = 'user'").collect()
    texts = {r.msg_id: r.text for r in tables.read(spark, sf_dir, "messages").collect()}
    assert len(texts) == len(turns)
    for r in turns:
        assert texts[r.conv_id * 1000 + r.turn].startswith(r.text or "")


def _orders(spark):
    day = dt.datetime(1995, 3, 5)
    rows = [(1, 7, "F", day), (1, 7, "O", day), (2, 7, "O", day + dt.timedelta(3)), (3, 8, "P", day),
            (4, None, "O", day), (5, 8, "O", None), (None, 7, "O", day), (6, 9, "O", day)]
    return spark.createDataFrame(
        rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz")


def test_attendance_counts_lines_before_the_join(spark):
    lines = spark.createDataFrame(
        [(1, "R"), (1, "A"), (1, None), (2, "N"), (3, "R"), (4, "A"), (5, "A"), (5, "R"),
         (None, "A"), (99, "A")], "l_orderkey bigint, l_returnflag string")
    orders = _orders(spark)
    got = tables.attendance(spark, orders, lines)
    want = tables.adapt(spark, "attendance", {"orders": orders, "lineitem": lines})
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [l_orderkey" in plan[plan.index("Join"):]


def test_registrations_are_dealt_out_before_their_text_is_built(spark, folder):
    _orders(spark).coalesce(1).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(
        [(7, 1, "BUILDING"), (8, 2, "OTHER")], "c_custkey bigint, c_nationkey int, c_mktsegment string"
    ).coalesce(1).write.parquet(f"{folder}/customer.parquet")
    got = tables.read(spark, folder, "registrations")
    want = tables.adapt(spark, "registrations", {
        t: tables.load(spark, folder, t) for t in ("orders", "customer")})
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "RepartitionByExpression" in got._jdf.queryExecution().optimizedPlan().toString()
