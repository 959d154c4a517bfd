"""Governed reads: who sees which rows, and which columns are masked.

Requests with the same effective region, pillar, purpose and masking see the same rows. The
directory is therefore built per *view*, not per request, and only for views asked for: at most
``(regions + 1) * (pillars + 1) * (purposes + 1) * 2`` exist, each record is in at most 40 of
them, and the work grows with the registry plus the requests, never with their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from consentry.functions.masks import MASKS
from consentry.sources.staging import lookup
from consentry.spec import (
    ACCESS_DETAILS, ALERT_PREFIX, ALERT_SUFFIX, ALL, DEFAULT_SPEC, KEY, REGISTRY_COLUMNS,
    UNKNOWN_ROLE_CODE, RegistrySpec,
)

VIEW = ("region_filter", "pillar_filter", "purpose")


POLICY_SCHEMA = "operator string, role string, region_scope string, pillar_scope string"


def no_policy(spark: SparkSession) -> DataFrame:
    """A policy without accounts."""
    return spark.createDataFrame([], POLICY_SCHEMA)


def people_policy(registry: DataFrame) -> DataFrame:
    """Registered people as operators under their own id."""
    return registry.select(
        F.col(KEY).alias("operator"), F.lit("beneficiary").alias("role"),
        F.col("region").alias("region_scope"), F.col("pillar").alias("pillar_scope"),
    )


def policy_of(requests: DataFrame) -> DataFrame:
    """The scope table ``(operator, role, region_scope, pillar_scope)`` behind a request log."""
    return requests.select("operator", "role", "region_scope", "pillar_scope").distinct()


def policy_join(
    requests: DataFrame, policy: DataFrame, spec: RegistrySpec = DEFAULT_SPEC
) -> DataFrame:
    """Requests with the role and scope on record for their operator, and ``allowed``.

    Scope comes from the policy table, never from the request. An operator without a policy row,
    an unknown role or an unknown purpose is denied; an omitted filter means all. ``policy`` is
    best a stored table: an operator behind a third of all requests is then split in the join.
    """
    asked = requests.drop("role", "region_scope", "pillar_scope").fillna(
        ALL, ["region", "pillar", "purpose"]
    )
    scoped = asked.join(policy, "operator", "left")
    known_role = F.coalesce(F.col("role").isin(*spec.role_codes), F.lit(False))
    known_purpose = F.coalesce(F.col("purpose").isin(ALL, *spec.purposes), F.lit(False))
    return scoped.withColumn("allowed", known_role & known_purpose)


def row_policy(scoped: DataFrame) -> DataFrame:
    """Adds ``region_filter`` and ``pillar_filter``, the filters after the row policy."""
    return scoped.withColumns(
        {
            "region_filter": F.when(F.col("role") == "field_officer", F.col("region_scope"))
            .otherwise(F.col("region")),
            "pillar_filter": F.when(F.col("role") == "pillar_coord", F.col("pillar_scope"))
            .otherwise(F.col("pillar")),
        }
    )


def directory_filter(
    registry: DataFrame,
    region: str = ALL,
    pillar: str = ALL,
    purpose: str = ALL,
    spec: RegistrySpec = DEFAULT_SPEC,
) -> DataFrame:
    """The rows of one request as plain filters, which reach the file scan."""
    rows = registry
    if region != ALL:
        rows = rows.filter(F.col("region") == region)
    if pillar != ALL:
        rows = rows.filter(F.col("pillar") == pillar)
    if purpose != ALL:
        if purpose not in spec.purposes:
            raise ValueError(f"unknown purpose {purpose!r}")
        rows = rows.filter(F.col(f"consent_{purpose}") == 1)
    return rows


def view_keys(spec: RegistrySpec = DEFAULT_SPEC) -> Column:
    """All views one record belongs to, as an array of at most 20 structs."""
    purposes = [F.lit(ALL)] + [
        F.when(F.col(f"consent_{p}") == 1, F.lit(p)) for p in spec.purposes
    ]
    combos = [
        F.when(
            purpose.isNotNull(),
            F.struct(
                region.alias("region_filter"), pillar.alias("pillar_filter"),
                purpose.alias("purpose"),
            ),
        )
        for region in (F.lit(ALL), F.col("region"))
        for pillar in (F.lit(ALL), F.col("pillar"))
        for purpose in purposes
    ]
    return F.array_compact(F.array(*combos))


def view_volumes(registry: DataFrame, spec: RegistrySpec = DEFAULT_SPEC) -> DataFrame:
    """Record count per view. Records are first counted per (region, pillar, flags) cell, of which
    the gate's domains allow 512, so the explosion into views works on cells. Other regions and
    pillars, should a registry hold any, are counted as well."""
    flags = [f"consent_{p}" for p in spec.purposes]
    cells = registry.groupBy("region", "pillar", *flags).agg(F.count(F.lit(1)).alias("_n"))
    return (
        cells.select(F.explode(view_keys(spec)).alias("v"), "_n").select("v.*", "_n")
        .groupBy(*VIEW).agg(F.sum("_n").alias("query_volume"))
    )


def with_volume(filtered: DataFrame, volumes: DataFrame) -> DataFrame:
    """Adds ``query_volume``, the rows each request returns; 0 when denied.

    ``volumes`` has a row per view, 225 with the default spec's domains; Spark knows its size and
    broadcasts it if it is small.
    """
    volume = F.when(F.col("allowed"), F.coalesce(F.col("query_volume"), F.lit(0))).otherwise(0)
    return filtered.join(volumes, list(VIEW), "left").withColumn(
        "query_volume", volume.cast("bigint")
    )


def request_volume(
    filtered: DataFrame, registry: DataFrame, spec: RegistrySpec = DEFAULT_SPEC
) -> DataFrame:
    return with_volume(filtered, view_volumes(registry, spec))


def mask_decision(requests: DataFrame, spec: RegistrySpec = DEFAULT_SPEC) -> DataFrame:
    """Adds ``masked``: asked for, forced by the role, or forced by an anomalous access. What is not
    known counts against disclosure."""
    return requests.withColumn(
        "masked",
        F.coalesce(F.col("force_anonymize"), F.lit(False))
        | F.coalesce(F.col("role").isin(*spec.masked_roles), F.lit(True))
        | F.coalesce(F.col("is_anomaly") == 1, F.lit(True)),
    )


def masked_columns(when: Column, spec: RegistrySpec = DEFAULT_SPEC) -> list[Column]:
    """The registry columns with personal data masked where ``when`` holds or the row is erased."""
    return _shown(when, {c: m(F.col(c), spec.redacted) for c, m in MASKS.items()})


def _shown(when: Column, masked: dict[str, Column]) -> list[Column]:
    hide = when | (F.col("status") == "Anonymized")
    return [
        F.when(hide, masked[c]).otherwise(F.col(c)).alias(c) if c in masked else F.col(c)
        for c in REGISTRY_COLUMNS
    ]


def requested_views(decided: DataFrame, spec: RegistrySpec = DEFAULT_SPEC) -> DataFrame:
    """Distinct views asked for, with the number of requests each serves."""
    return lookup(decided.filter("allowed").groupBy(*VIEW, "masked").agg(
        F.count(F.lit(1)).alias("n_requests")
    ))


def _place(region: Column, pillar: Column, purpose: Column, spec: RegistrySpec) -> Column:
    """The number of a view among all views of the domains; null for one outside them."""
    def at(value: Column, domain: tuple[str, ...]) -> Column:
        found = F.array_position(F.array(*[F.lit(v) for v in (ALL, *domain)]), value)
        return F.nullif(found, F.lit(0).cast("bigint")) - 1

    rows = at(region, spec.regions) * (len(spec.pillars) + 1) + at(pillar, spec.pillars)
    return (rows * (len(spec.purposes) + 1) + at(purpose, spec.purposes)).cast("int")


def _asked(views: DataFrame, spec: RegistrySpec) -> Column:
    """For each view of the domains whether it is asked for: one array, whatever the requests."""
    size = (len(spec.regions) + 1) * (len(spec.pillars) + 1) * (len(spec.purposes) + 1)
    places = views.select(_place(*map(F.col, VIEW), spec).alias("at")).agg(
        F.collect_set("at").alias("asked"))
    return places.select(F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.array_contains("asked", k))).scalar()


def directory(
    decided: DataFrame, registry: DataFrame, spec: RegistrySpec = DEFAULT_SPEC
) -> DataFrame:
    """The governed directory, one row per (requested view, record), masked as the view demands.

    A record's views are cut to those asked for before the record is repeated for them, so one view
    costs one copy of its records. A request's answer is the rows whose view columns equal its own,
    see ``request_rows``.
    """
    views = requested_views(decided, spec)

    def wanted(view: Column) -> Column:
        place = _place(view["region_filter"], view["pillar_filter"], view["purpose"], spec)
        # Views outside the domains are left to the join.
        return F.coalesce(F.get(F.col("_asked"), place), F.lit(True))

    # Masked once per record, before the record is repeated for its views.
    masked = {c: f"_m_{c}" for c in MASKS}
    members = registry.select(
        *REGISTRY_COLUMNS,
        *[MASKS[c](F.col(c), spec.redacted).alias(m) for c, m in masked.items()],
        _asked(views, spec).alias("_asked"),
    )
    members = members.select(
        *REGISTRY_COLUMNS, *masked.values(), F.explode(F.filter(view_keys(spec), wanted)).alias("_v"),
    ).select("*", "_v.*")
    return members.join(views, list(VIEW)).select(
        *VIEW, "masked", "n_requests",
        *_shown(F.col("masked"), {c: F.col(m) for c, m in masked.items()}),
    )


def request_rows(decided: DataFrame, directory_rows: DataFrame) -> DataFrame:
    """The directory rows of each given request. As large as the answers together: meant for the
    requests one is about to serve."""
    asked = decided.filter("allowed").select("request_id", *VIEW, "masked")
    return asked.join(directory_rows, [*VIEW, "masked"])


def access_features(requests: DataFrame, spec: RegistrySpec = DEFAULT_SPEC) -> DataFrame:
    """Adds the four features of the access model to requests with a volume.

    The mismatch compares what was asked with the operator's own scope, so asking for everything
    counts as one.
    """
    role_code = F.coalesce(
        *[F.when(F.col("role") == r, code) for r, code in spec.role_codes.items()],
        F.lit(UNKNOWN_ROLE_CODE),
    )
    mismatch = (
        (F.col("role") == "field_officer") & (F.col("region") != F.col("region_scope"))
    ) | ((F.col("role") == "pillar_coord") & (F.col("pillar") != F.col("pillar_scope")))
    return requests.withColumns(
        {
            "hour_of_day": F.hour("ts"),
            "role_code": role_code,
            "region_mismatch": F.when(mismatch, 1).otherwise(0),
        }
    )


def access_audit(decided: DataFrame) -> DataFrame:
    """One audit row per request: what was queried, how much came back, whether it was masked."""
    details = F.format_string(
        ACCESS_DETAILS, "region_filter", "pillar_filter", "purpose", "query_volume",
        F.when(F.col("masked"), "True").otherwise("False"),
    )
    flagged = F.concat(F.lit(ALERT_PREFIX), details, F.lit(ALERT_SUFFIX))
    return decided.select(
        F.col("request_id").alias("seq"),
        F.col("ts").alias("timestamp"),
        "operator",
        F.lit("PII_ACCESS").alias("action_type"),
        F.lit(None).cast("string").alias("target_beneficiary_id"),
        F.when(F.col("is_anomaly") == 1, flagged).otherwise(details).alias("details"),
        F.col("is_anomaly").cast("int").alias("is_anomaly"),
    )


def consent_gate(linked: DataFrame, registry: DataFrame) -> DataFrame:
    """The profile behind each linked message; personal data only while consent is active."""
    profile = linked.select("msg_id", KEY).join(registry, KEY)
    disclosed = F.coalesce(F.col("consent_status") == "Consented", F.lit(False))
    shown = {c: F.when(disclosed, F.col(c)).alias(c)
             for c in ("full_name", "email", "phone", "consent_type")}
    return profile.select(
        "msg_id", KEY, disclosed.alias("disclosed"), shown["full_name"], "pillar", "region",
        shown["email"], shown["phone"], "consent_status", shown["consent_type"],
    )


def linkable(registry: DataFrame, spec: RegistrySpec = DEFAULT_SPEC) -> DataFrame:
    """Records that are not erased."""
    return registry.filter(F.col("full_name") != spec.redacted)
