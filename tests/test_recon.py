"""The sides of the reconciliation, with cells that are missing, repeated or null."""

import datetime as dt

from consentry.operators import recon
from consentry.spec import KEY

M1, M2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def test_sides_meet_without_a_sort_and_nulls_match_nothing(spark):
    held = spark.createDataFrame(
        [("A", M1, 4, 4), ("A", M1, 4, 0), ("B", M1, 4, 4), (None, M1, 2, 2), ("C", None, 1, 1)],
        f"{KEY} string, month timestamp_ntz, sessions_held bigint, sessions_attended bigint")
    paid = spark.createDataFrame(
        [("A", M1, 3), ("A", M1, 4), ("A", M2, 5), (None, M1, 6), (None, M1, 1), ("C", None, 8),
         ("B", M1, None)], f"{KEY} string, month timestamp_ntz, amount bigint")
    registry = spark.createDataFrame(
        [("A", 1), ("B", 0), (None, 1)], f"{KEY} string, consent_data_sharing int")
    joined = recon.recon_join(recon.attendance_rate(held), paid, registry)
    assert {tuple(r) for r in joined.collect()} == {
        ("A", M1, 8, 4, False, True, 7), ("A", M2, None, None, False, True, 5),
        ("B", M1, 4, 4, True, False, 0), (None, M1, 2, 2, True, False, 0),
        (None, M1, None, None, False, False, 7), ("C", None, 1, 1, True, False, 0),
        ("C", None, None, None, False, False, 8),
    }
    assert joined.count() == 7
    assert "FullOuter" not in joined._jdf.queryExecution().optimizedPlan().toString()
