"""The registry's inputs, derived from the general-purpose test tables.

Each adapter is a list of ``(column, SQL expression)``; the expressions read the same in Spark and
in DuckDB, so both sides of a check start from equal rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIRST = "'Jane,Asha,Joseph,GRACE,kevin,Halima,Moses,Ruth,Élan,Ali,Alice,Mercy'"
_LAST = "'achieng,o''brien,Anne-Marie,KIPROP,mohamed 3rd,Wambui,Otieno'"
_FIRST_NAME = f"split_part({_FIRST}, ',', cast(o.o_custkey % 12 as int) + 1)"
_LAST_NAME = f"split_part({_LAST}, ',', cast(o.o_custkey % 7 as int) + 1)"
_PERSON = "'REG-' || lpad(cast(o.o_custkey as string), 8, '0')"


@dataclass(frozen=True)
class Adapter:
    source: str
    columns: tuple[tuple[str, str], ...]
    tail: str = ""

    @property
    def sql(self) -> str:
        items = ", ".join(f"{expr} AS {name}" for name, expr in self.columns)
        return f"SELECT {items} FROM {self.source} {self.tail}"


ADAPTERS: dict[str, Adapter] = {
    "registrations": Adapter(
        "orders o JOIN customer c ON c.c_custkey = o.o_custkey",
        (
            ("event_seq", "o.o_orderkey"),
            ("arrived_at", "o.o_orderdate"),
            ("beneficiary_id", _PERSON),
            ("full_name",
             f"case when o.o_orderkey % 37 = 0 then '  ' when o.o_custkey % 29 = 0 then {_FIRST_NAME} "
             f"else '  ' || {_FIRST_NAME} || '   ' || {_LAST_NAME} || ' ' end"),
            ("national_id",
             "case when o.o_orderkey % 53 = 0 then null "
             "else lpad(cast((o.o_custkey * 17) % 100000000 as string), 8, '0') end"),
            ("email",
             "case when o.o_orderkey % 41 = 0 then 'not_an_email_address' "
             "else ' USER' || cast(o.o_custkey as string) || '@Example.ORG ' end"),
            ("phone",
             "case o.o_custkey % 5 when 0 then '07' || lpad(cast(o.o_custkey as string), 8, '1') "
             "when 1 then '01 ' || lpad(cast(o.o_custkey as string), 8, '2') "
             "when 2 then '7' || lpad(cast(o.o_custkey as string), 8, '3') "
             "when 3 then '+254 7' || lpad(cast(o.o_custkey as string), 8, '4') "
             "else '254' || lpad(cast(o.o_custkey as string), 9, '5') end"),
            ("pillar",
             "case c.c_mktsegment when 'AUTOMOBILE' then ' scholarship' when 'BUILDING' then 'PLUS' "
             "when 'FURNITURE' then 'Vocational ' when 'HOUSEHOLD' then 'tech' "
             "else case when o.o_orderkey % 5 = 0 then 'Corporate' else 'Tech' end end"),
            ("region",
             "case c.c_nationkey % 9 when 0 then 'nyanza' when 1 then 'north-eastern' "
             "when 2 then 'RIFTVALLEY' when 3 then 'Central' when 4 then 'nairobi ' "
             "when 5 then 'Coastal' when 6 then 'western' when 7 then 'eastern' "
             "else case when o.o_orderkey % 7 = 0 then 'Kampala' else 'rift valley' end end"),
            ("consent_status",
             "case o.o_orderstatus when 'O' then 'Consented' when 'P' then 'Pending' "
             "else 'Withdrawn' end"),
            ("consent_type",
             "case o.o_orderstatus when 'P' then 'None' else case o.o_orderkey % 3 "
             "when 0 then 'Digital Signature' when 1 then 'SMS OTP' else 'Physical Form' end end"),
            ("consent_date",
             "case o.o_orderstatus when 'P' then '' "
             "else cast(cast(o.o_orderdate as date) as string) || ' 12:00:00' end"),
            ("status", "case when o.o_orderkey % 11 = 0 then '' else 'Active' end"),
        ),
    ),
    "access_requests": Adapter(
        "events",
        (
            ("request_id", "event_id"),
            ("ts", "ts"),
            ("operator", "'op_' || cast(user_id as string)"),
            ("role",
             "case user_id % 6 when 0 then 'hq_admin' when 1 then 'pillar_coord' "
             "when 2 then 'field_officer' when 3 then 'compliance_auditor' "
             "when 4 then 'beneficiary' else 'unknown' end"),
            ("region_scope",
             "case when user_id % 6 = 2 then split_part('Nyanza,Nairobi,Coastal', ',', "
             "cast(floor(user_id / 6) as int) % 3 + 1) else 'All' end"),
            ("pillar_scope",
             "case when user_id % 6 = 1 then split_part('Scholarship,Tech', ',', "
             "cast(floor(user_id / 6) as int) % 2 + 1) else 'All' end"),
            ("region",
             "case event_type when 'view' then 'Nyanza' when 'click' then 'Coastal' else 'All' end"),
            ("pillar",
             "case event_type when 'purchase' then 'Tech' when 'click' then 'Scholarship' "
             "else 'All' end"),
            ("purpose",
             "case event_id % 5 when 0 then 'data_sharing' when 1 then 'photo_use' "
             "when 2 then 'sms_contact' when 3 then 'external_reporting' else 'All' end"),
            ("force_anonymize", "event_type = 'error'"),
        ),
    ),
    "consent_changes": Adapter(
        "events",
        (
            ("seq", "event_id"),
            ("beneficiary_id",
             "case when event_id % 19 = 0 then 'REG-99' || lpad(cast(user_id as string), 6, '0') "
             "else 'REG-' || lpad(cast(user_id as string), 8, '0') end"),
            ("op",
             "case event_type when 'signup' then 'consent_update' "
             "when 'purchase' then 'consent_text_update' when 'view' then 'consent_self_update' "
             "when 'click' then 'consent_self_update' else case when event_id % 17 = 0 "
             "then 'erase_subject' else 'consent_update' end end"),
            ("new_status",
             "case cast(floor(value) as int) % 3 when 0 then 'Consented' when 1 then 'Pending' "
             "else 'Withdrawn' end"),
            ("consent_type", "case when event_id % 2 = 0 then null else 'SMS OTP' end"),
            ("f_sharing", "cast(event_id % 2 as int)"),
            ("f_photo", "cast(event_id % 3 % 2 as int)"),
            ("f_sms", "cast(event_id % 5 % 2 as int)"),
            ("f_report", "cast(event_id % 7 % 2 as int)"),
            ("as_of", "ts"),
            ("operator",
             "case when event_id % 4 = 0 then null when event_id % 13 = 0 then 'chatbot_interface' "
             "else 'op_' || cast(user_id as string) end"),
        ),
    ),
    "messages": Adapter(
        "conversations",
        (
            ("msg_id", "conv_id * 1000 + turn"),
            # The message as it is; to most, a request is added so that links and intents occur.
            ("text",
             "coalesce(text, '') || "
             "case conv_id % 10 when 0 then ' show profile for jane' "
             "when 1 then ' withdraw consent for REG-' || lpad(cast(conv_id as string), 8, '0') "
             "when 2 then ' futa data yangu ' || 'reg-' || lpad(cast(conv_id as string), 8, '0') "
             "when 3 then ' ripoti ya nyanza' when 4 then ' report on the tech pillar' "
             "when 5 then ' how do you protect my privacy?' "
             "when 6 then ' angalia data ' || "
             "lpad(cast((conv_id * 17) % 100000000 as string), 8, '0') "
             "when 7 then ' opt in for alice' when 8 then ' generate report' else '' end"),
        ),
        "WHERE role = 'user'",
    ),
    "attendance": Adapter(
        "orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey",
        (
            ("beneficiary_id", _PERSON),
            ("month", "cast(date_trunc('month', o.o_orderdate) as timestamp{ntz})"),
            ("sessions_held", "count(*)"),
            ("sessions_attended", "sum(case when l.l_returnflag <> 'R' then 1 else 0 end)"),
        ),
        "GROUP BY 1, 2",
    ),
    "disbursements": Adapter(
        "orders o",
        (
            ("beneficiary_id", _PERSON),
            ("month", "cast(date_trunc('month', o.o_orderdate) as timestamp{ntz})"),
            ("amount", "cast(max(case when o.o_orderstatus = 'F' then 0 else 5000 end) as bigint)"),
        ),
        "GROUP BY 1, 2",
    ),
}


# Attendance over lines that are counted per order already: what Spark joins is one row an order.
_COUNTED = replace(
    ADAPTERS["attendance"],
    columns=(
        *ADAPTERS["attendance"].columns[:2],
        ("sessions_held", "sum(l.n_lines)"),
        ("sessions_attended", "sum(l.n_kept)"),
    ),
)


def adapter_sql(name: str, spark: bool) -> str:
    """The adapter as a query; the two engines differ only in the name of the zone-less timestamp."""
    return ADAPTERS[name].sql.replace("{ntz}", "_ntz" if spark else "")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tables_of(name: str) -> list[str]:
    known = ("orders", "customer", "lineitem", "events", "conversations")
    return [t for t in known if t in ADAPTERS[name].source.split()]


def adapt(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """An adapter over the given frames, which may be streams."""
    adapter = ADAPTERS[name]
    source = " ".join(f"{{{w}}}" if w in tables else w for w in adapter.source.split())
    return spark.sql(
        adapter_sql(name, spark=True).replace(adapter.source, source, 1), **tables
    )


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: load(spark, sf_dir, t) for t in _tables_of(name)}
    if name == "registrations":
        # The narrow rows are dealt out before the text of events is built and cleansed: a file
        # has few splits for that work, and a compact one only as many as it has row groups.
        tables["orders"] = tables["orders"].repartition("o_orderkey", "o_custkey", "o_orderdate")
    if name == "attendance":
        return attendance(spark, tables["orders"], tables["lineitem"])
    return adapt(spark, name, tables)


def attendance(spark: SparkSession, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The rows of the attendance adapter. Lines are counted per order before the join, in the map
    tasks already, so the lines are neither shuffled nor sorted, nor is a person's key built for
    each of them."""
    kept = F.when(F.col("l_returnflag") != "R", 1).otherwise(0)
    lines = lineitem.filter(F.col("l_orderkey").isNotNull()).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(kept).alias("n_kept"))
    source = _COUNTED.source.replace("orders", "{orders}", 1).replace("lineitem", "{lineitem}", 1)
    query = replace(_COUNTED, source=source).sql.replace("{ntz}", "_ntz")
    return spark.sql(query, orders=orders, lineitem=lines)
