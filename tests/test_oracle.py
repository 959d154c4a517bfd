"""Every registered query that SQL can express equals its SQL on the same tables."""

import pytest
from compare import connect, difference

from consentry.plans.oracle import ORACLE_SQL
from consentry.plans.queries import QUERIES

ROWS_ONLY = {
    "access_alerts_scored", "intent_fit", "intent_predict", "isolation_forest_fit",
    "isolation_forest_score", "message_actions", "stream_access_alerts",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_is_checked_or_listed():
    assert set(QUERIES) - set(ORACLE_SQL) == ROWS_ONLY
    assert not set(ORACLE_SQL) - set(QUERIES)


@pytest.mark.parametrize("name", [q for q in QUERIES if q in ORACLE_SQL])
def test_equals_sql(spark, sf_dir, duck, name):
    assert difference(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name]) == ""


def test_entry(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    rows = {(r.scope, r.name): r.asDict() for r in df.collect()}
    total = rows[("global", "All")]["total"]
    assert total > 0
    assert total == sum(r["total"] for (s, _), r in rows.items() if s == "pillar")
    assert total == sum(r["total"] for (s, _), r in rows.items() if s == "region")


@pytest.mark.parametrize("missing, warns", [("zstandard", True), ("consentry.llm", False)])
def test_other_queries_stay_without_the_training_data_ones(missing, warns):
    import subprocess
    import sys

    code = f"""
import sys, warnings
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[:{missing.count(".") + 1}] == {missing.split(".")!r}:
            raise ModuleNotFoundError("blocked", name=name)
sys.meta_path.insert(0, Block())
with warnings.catch_warnings(record=True) as seen:
    warnings.simplefilter("always")
    import __spark_entry__ as e
told = any("no training-data queries" in str(w.message) for w in seen)
assert told == {warns}, seen
assert "report_all" in e.queries() and not any(q.startswith("op1") for q in e.queries())
assert "pipeline" not in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=100)
