"""Cleansing of registration events and of registry batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consentry.functions import consent, text
from consentry.spec import DEFAULT_SPEC, EVENT_COLUMNS, FLAGS, REGISTRY_COLUMNS, RegistrySpec


#: Where a row stood in its file, if the reader says so.
FILE_ORDER = "_file_order"


def _present(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def cleanse_events(
    events: DataFrame, spec: RegistrySpec = DEFAULT_SPEC, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The event columns cleansed, ``keep`` unchanged. Blank values count as missing.

    Done in three projections, blanks first, then case, then names: a regular expression stands
    once in the plan and runs once per row, however often its result is used.
    """
    stripped = {
        "full_name": _present(text.squeeze(F.col("full_name"))),
        "email": _present(text.email(F.col("email"))),
        "phone": _present(text.compact(F.col("phone"))),
        "region": _present(text.strip(F.col("region"))),
        "_pillar": F.lower(text.strip(F.col("pillar"))),
    }
    first = events.select(
        *keep,
        *[c.alias(name) for name, c in stripped.items()],
        *[text.blank_to_null(F.col(c)).alias(c) for c in EVENT_COLUMNS if c not in stripped],
    )
    titled = first.select(
        *[c for c in first.columns if c not in ("full_name", "region")],
        text.title(F.col("full_name")).alias("full_name"),
        text.title(F.col("region")).alias("region"),
    )
    values = {
        "phone": text.international(F.col("phone")),
        "pillar": text.matched_name(F.col("_pillar"), F.col("pillar"), spec.pillars),
        "region": text.aliased(F.col("region"), spec.region_aliases),
        "status": F.coalesce(F.col("status"), F.lit("Active")),
        "consent_date": F.col("consent_date").try_cast("timestamp_ntz"),
    }
    return titled.select(
        *keep, *[values.get(c, F.col(c)).alias(c) for c in EVENT_COLUMNS]
    )


def standardise_events(
    events: DataFrame, spec: RegistrySpec = DEFAULT_SPEC, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Raw registration events to the 16 registry columns, plus ``keep`` unchanged.

    Projections only, so it costs no shuffle in a batch or in a stream. Enrolment and the purpose
    flags follow from the consent status; what the payload says about them is ignored.
    """
    status = F.col("consent_status")
    return cleanse_events(events, spec, keep).select(
        *keep,
        *EVENT_COLUMNS,
        consent.enrollment_on_ingest(status).alias("enrollment_status"),
        *[c.alias(flag) for flag, c in consent.all_or_none(status).items()],
    )


def type_registry(csv_rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Registry rows read as text to registry types, plus ``keep`` unchanged; the sentinels for
    "nothing" become null."""
    return csv_rows.select(
        *keep,
        *[
            F.nullif(F.col(c), F.lit("None")).alias(c) if c == "consent_type"
            else F.nullif(F.col(c), F.lit("")).try_cast("timestamp_ntz").alias(c)
            if c == "consent_date"
            else F.col(c).cast("int").alias(c) if c in FLAGS
            else F.col(c)
            for c in REGISTRY_COLUMNS
        ]
    )


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def strip_strings(df: DataFrame) -> DataFrame:
    return df.withColumns({c: text.strip(F.col(c)) for c in string_columns(df)})


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Drop rows equal in every column, as they came: copies that differ in blanks both stay.

    Spark drops copies inside each map task before the shuffle, so a row that makes up a third
    of the table reaches the reducers once per task. Of copies, the first in the file stays.
    """
    if FILE_ORDER not in df.columns:
        return df.dropDuplicates()
    values = [c for c in df.columns if c != FILE_ORDER]
    return df.groupBy(*values).agg(F.min(FILE_ORDER).alias(FILE_ORDER))


def clean_batch(batch: DataFrame) -> DataFrame:
    """Batch clean-up: drop copies, strip text, then names and phones. E-mail, pillar and region
    stay as they came; the gate rejects what is not canonical."""
    return strip_strings(dedupe_rows(batch)).withColumns(
        {"full_name": text.title_name(F.col("full_name")), "phone": text.phone_e164(F.col("phone"))}
    )
