"""The registered training-data queries: all there, and equal to their SQL where SQL can say it."""

import pytest
from compare import connect, difference

from consentry.llm.queries import QUERIES
from consentry.llm.sql import ORACLE_SQL

#: Checked by brute force, a round trip or held-out accuracy instead.
NO_SQL = {
    "op4_language", "op5_mixing", "op7_token_files", "op9_surrogates", "op10_quality", "op12_packing",
}


def test_all_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert set(QUERIES) - set(ORACLE_SQL) == NO_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name]) == ""
