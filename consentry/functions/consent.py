"""What a consent status implies for enrolment and for the purpose flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from consentry.spec import FLAGS


def enrollment_on_ingest(status: Column) -> Column:
    return (
        F.when(status == "Consented", "Enrolled")
        .when(status == "Pending", "Pending Review")
        .otherwise("On Hold")
    )


def enrollment_on_update(status: Column) -> Column:
    """Unlike at ingest, a status that is not Consented puts the account on hold."""
    return F.when(status == "Consented", "Enrolled").otherwise("On Hold")


def all_or_none(status: Column) -> dict[str, Column]:
    granted = F.when(status == "Consented", 1).otherwise(0)
    return {flag: granted for flag in FLAGS}
