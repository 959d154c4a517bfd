"""One registered query per operator. Each takes the session and a folder of tables."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consentry.functions import masks, text
from consentry.models import forest, intent
from consentry.models import store as models
from consentry.operators import (
    access, audit, linking, quality, recon, report, standardise, state,
)
from consentry.plans import batch
from consentry.plans.inputs import AFTER_ALL, Inputs
from consentry.plans.messages import handle_classified, handle_messages
from consentry.sources import files, store, tables
from consentry.sources.payload_log import read_payload_log
from consentry.sources.staging import lookup, shared_dir, stage
from consentry.spec import (
    ALL, BATCH_RULES, DEFAULT_SPEC, EVENT_COLUMNS, FLAGS, KEY, PII, REGISTRY_COLUMNS, ROW_RULES,
    STRICT_RULES,
)
from consentry.streaming import alerts, ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FEATURES = ("hour_of_day", "role_code", "region_mismatch", "query_volume")


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
    return fn


# --- sources and sinks ------------------------------------------------------------------------

def _raw_csv(i: Inputs) -> str:
    """The registry as a raw CSV file with the sentinels of one, as text."""
    path = shared_dir(i.spark) + "/raw"
    rows = i.registry.select(
        *[
            F.coalesce(F.col(c), F.lit("None")).alias(c) if c == "consent_type"
            else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c == "consent_date"
            else F.col(c).cast("string").alias(c)
            for c in REGISTRY_COLUMNS
        ]
    )
    files.write_csv(rows, path)
    return path


@query
def scan_registry_csv(i: Inputs) -> DataFrame:
    return files.read_registry_csv(i.spark, _raw_csv(i))


@query
def scan_quoted_csv(i: Inputs) -> DataFrame:
    """Whole documents, with line breaks and quotes, written as CSV and read by ranges."""
    path = shared_dir(i.spark) + "/documents"
    docs = tables.load(i.spark, i.sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), "lang", "source", "text")
    files.write_csv(docs, path)
    return files.read_registry_csv(i.spark, path, docs.schema)


@query
def scan_report(i: Inputs) -> DataFrame:
    return files.scan_report(files.read_registry_csv(i.spark, _raw_csv(i)))


@query
def stage_extract(i: Inputs) -> DataFrame:
    return batch.extract(i.spark, _raw_csv(i)).drop(standardise.FILE_ORDER)


@query
def load_registry_typed(i: Inputs) -> DataFrame:
    return standardise.type_registry(files.read_registry_csv(i.spark, _raw_csv(i)))


@query
def sink_clean_csv(i: Inputs) -> DataFrame:
    out = shared_dir(i.spark)
    batch.run(i.spark, _raw_csv(i), f"{out}/clean", out)
    return files.read_registry_csv(i.spark, f"{out}/clean")


@query
def sink_registry_replace(i: Inputs) -> DataFrame:
    out = shared_dir(i.spark)
    batch.run(i.spark, _raw_csv(i), f"{out}/clean", out)
    return store.snapshot(i.spark, out).drop("row_order")


def _payloads(events: DataFrame) -> DataFrame:
    """Registrations as JSON lines, with a key that no column is known for."""
    fields = F.struct(*EVENT_COLUMNS, F.lit("kiosk").alias("channel"))
    return events.select(
        "event_seq", "arrived_at", F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"))


def _payload_lines(i: Inputs) -> DataFrame:
    """The same with every 97th cut short."""
    cut = F.col("value").substr(F.lit(1), F.length("value") - 5)
    return _payloads(i.events).withColumn(
        "value", F.when(F.col("event_seq") % 97 == 0, cut).otherwise(F.col("value")))


def _payload_folder(i: Inputs) -> str:
    """Payload files whose lines, file by file, are in the order of arrival."""
    path = shared_dir(i.spark)
    lines = _payload_lines(i).repartitionByRange("event_seq").sortWithinPartitions("event_seq")
    lines.select("value").write.text(path)
    return path


@query
def source_registration_events(i: Inputs) -> DataFrame:
    """Payload files read as a stream of (file, byte) offsets and drained into a table."""
    out = shared_dir(i.spark)
    parsed = files.parse_events(read_payload_log(i.spark, _payload_folder(i), streaming=True))
    drain = (
        parsed.writeStream.format("parquet").option("path", f"{out}/events")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    drain.awaitTermination()
    return i.spark.read.schema(parsed.schema).parquet(f"{out}/events").select(
        *EVENT_COLUMNS, F.col(files.CORRUPT).isNotNull().alias("is_corrupt")
    )


@query
def stream_payload_registry(i: Inputs) -> DataFrame:
    """The registry after draining payload files: the last arrival by offset wins."""
    out = shared_dir(i.spark)
    lines = read_payload_log(i.spark, _payload_folder(i), streaming=True)
    ingest.start_ingest(files.parse_events(lines), out).awaitTermination()
    return ingest.registry(i.spark, out).drop("row_order")


def _audit_frame(i: Inputs) -> DataFrame:
    requests = access.access_audit(
        access.mask_decision(i.features.withColumn("is_anomaly", F.lit(0)))
    ).withColumn("ip_address", F.lit("127.0.0.1"))
    return (
        audit.ingest_audit(i.routed, "event_seq", F.col("arrived_at"))
        .unionByName(audit.change_audit(i.interleaved, F.col("consent_date")))
        .unionByName(requests)
    )


def _log_order(df: DataFrame) -> DataFrame:
    """A position across the three logs: the kinds interleave by ``seq``."""
    kind = F.when(F.col("action_type") == "PII_ACCESS", 2).when(
        F.col("action_type") == "BENEFICIARY_INGEST", 0
    ).otherwise(1)
    return df.withColumn("audit_id", F.col("seq") * 3 + kind)


@query
def append_audit(i: Inputs) -> DataFrame:
    """Audit rows of ingest, changes and reads, appended to the registry's log."""
    out = shared_dir(i.spark)
    files.append_batch(_audit_frame(i).select(*audit.AUDIT_COLUMNS), f"{out}/audit", 0)
    return ingest.audited(i.spark, out).drop("batch_id")


@query
def audit_between(i: Inputs) -> DataFrame:
    """A time range of the audit log, of which only its months are read."""
    out = shared_dir(i.spark)
    files.append_batch(_audit_frame(i).select(*audit.AUDIT_COLUMNS), f"{out}/audit", 0)
    return ingest.audited(
        i.spark, out, "1994-03-15 12:00:00", "1995-06-01 00:00:00").drop("batch_id")


@query
def audit_view(i: Inputs) -> DataFrame:
    return audit.newest_first(
        _log_order(_audit_frame(i)).select("audit_id", *audit.AUDIT_COLUMNS[1:]), "audit_id"
    )


@query
def append_quarantine(i: Inputs) -> DataFrame:
    """What a registry quarantines of payload lines, some of them cut short."""
    out = shared_dir(i.spark)
    ingest.store_batch(files.parse_events(_payload_lines(i)), 0, out)
    return ingest.quarantined(i.spark, out).drop("batch_id")


@query
def quarantine_purged(i: Inputs) -> DataFrame:
    """The quarantine log after the payloads of erased people were blanked."""
    out = shared_dir(i.spark)
    ingest.store_batch(i.events, 0, out)
    store.append_writes(i.changes_after_all(), out, 1)
    store.compact(i.spark, out)
    store.purge_quarantine(i.spark, out, ingest.QUARANTINE_SCHEMA)
    return ingest.quarantined(i.spark, out).drop("batch_id")


@query
def quarantine_view(i: Inputs) -> DataFrame:
    return audit.newest_first(ingest.quarantine(i.routed), "event_id")


@query
def export_compliant_csv(i: Inputs) -> DataFrame:
    """The active directory, fully masked, as a CSV file."""
    out = shared_dir(i.spark)
    active = i.current.filter(F.col("status") == "Active")
    files.write_csv(active.select(*access.masked_columns(F.lit(True))), out)
    return files.read_registry_csv(i.spark, out).drop("consent_date")


# --- cleansing --------------------------------------------------------------------------------

def _per_event(i: Inputs, **columns) -> DataFrame:
    return i.events.select("event_seq", *[c.alias(name) for name, c in columns.items()])


@query
def blank_to_null(i: Inputs) -> DataFrame:
    return _per_event(i, **{c: text.blank_to_null(F.col(c)) for c in EVENT_COLUMNS})


@query
def strip_strings(i: Inputs) -> DataFrame:
    return standardise.strip_strings(i.events.select("event_seq", *EVENT_COLUMNS))


@query
def title_name(i: Inputs) -> DataFrame:
    return _per_event(i, full_name=text.title_name(F.col("full_name")))


@query
def phone_e164(i: Inputs) -> DataFrame:
    return _per_event(i, phone=text.phone_e164(F.col("phone")))


@query
def email_normalise(i: Inputs) -> DataFrame:
    return _per_event(i, email=text.email(F.col("email")))


@query
def pillar_canonical(i: Inputs) -> DataFrame:
    return _per_event(i, pillar=text.canonical(F.col("pillar"), DEFAULT_SPEC.pillars))


@query
def region_canonical(i: Inputs) -> DataFrame:
    return _per_event(i, region=text.region(F.col("region"), DEFAULT_SPEC.region_aliases))


@query
def default_status(i: Inputs) -> DataFrame:
    return standardise.cleanse_events(i.events, keep=("event_seq",)).select("event_seq", "status")


@query
def derive_consent_ingest(i: Inputs) -> DataFrame:
    return standardise.standardise_events(i.events, keep=("event_seq",)).select(
        "event_seq", "consent_status", "enrollment_status", *FLAGS
    )


@query
def standardise_events(i: Inputs) -> DataFrame:
    return standardise.standardise_events(i.events, keep=("event_seq",))


@query
def dedupe_rows(i: Inputs) -> DataFrame:
    return standardise.dedupe_rows(
        i.events.select(KEY, "full_name", "email", "phone", "pillar", "region", "status")
    )


@query
def clean_batch(i: Inputs) -> DataFrame:
    return standardise.clean_batch(i.events.select(*EVENT_COLUMNS))


# --- quality gates ----------------------------------------------------------------------------

def _violations(i: Inputs, kind: str) -> DataFrame:
    rules = tuple(r for r in ROW_RULES if r.kind == kind)
    cleansed = standardise.standardise_events(i.events, keep=("event_seq",))
    return cleansed.select(
        "event_seq", F.explode(quality.failure_reasons(rules)).alias("reason")
    )


@query
def expect_not_null(i: Inputs) -> DataFrame:
    return _violations(i, "not_null")


@query
def expect_in_set(i: Inputs) -> DataFrame:
    return _violations(i, "in_set")


@query
def expect_regex(i: Inputs) -> DataFrame:
    return _violations(i, "regex")


@query
def expect_unique(i: Inputs) -> DataFrame:
    return quality.duplicated_rows(i.events.select("event_seq", KEY))


@query
def gate_report(i: Inputs) -> DataFrame:
    return quality.gate_report(standardise.clean_batch(i.events.select(*EVENT_COLUMNS)))


@query
def gate_batch(i: Inputs) -> DataFrame:
    """The verdict on a clean and on a raw batch; the raw one is rejected."""
    verdicts = []
    for name, rows in (
        ("registry", i.registry.drop("row_order")),
        ("registrations", standardise.clean_batch(i.events.select(*EVENT_COLUMNS))),
    ):
        try:
            quality.require_valid(stage(rows), BATCH_RULES)
            verdicts.append((name, True, 0, 0))
        except quality.QualityGateError as e:
            counts = [f["unexpected"] for f in e.failures]
            verdicts.append((name, False, len(counts), sum(counts)))
    return i.spark.createDataFrame(
        verdicts, "batch string, accepted boolean, failed_rules bigint, unexpected bigint"
    )


def _gated(i: Inputs, rules) -> DataFrame:
    gated = quality.gate_rows(standardise.standardise_events(i.events, keep=("event_seq",)), rules)
    return gated.select(
        "event_seq", "is_valid", F.concat_ws("; ", "failure_reasons").alias("failure_reasons")
    )


@query
def gate_rows(i: Inputs) -> DataFrame:
    return _gated(i, ROW_RULES)


@query
def gate_rows_strict(i: Inputs) -> DataFrame:
    return _gated(i, STRICT_RULES)


@query
def route_ingest(i: Inputs) -> DataFrame:
    return i.routing.select("event_seq", KEY, "ingest_status", "failure_reasons")


@query
def ingest_outcomes(i: Inputs) -> DataFrame:
    return quality.ingest_outcomes(i.routing)


# --- keyed state ------------------------------------------------------------------------------

@query
def registry_upsert(i: Inputs) -> DataFrame:
    return state.registry_upsert(i.accepted, "event_seq")


def _after(i: Inputs, op: str) -> DataFrame:
    return state.apply_changes(i.ingest_log, i.changes_after_all(op))


@query
def consent_update(i: Inputs) -> DataFrame:
    return _after(i, state.UPDATE)


@query
def consent_self_update(i: Inputs) -> DataFrame:
    return _after(i, state.SELF_UPDATE)


@query
def consent_text_update(i: Inputs) -> DataFrame:
    """Consent changes read from linked messages, one fold over the registry."""
    links = linking.link_messages(i.messages, i.registry, linking.NARROW)
    requests = state.text_consent_changes(
        i.messages.join(links, "msg_id"), F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    )
    return state.apply_changes(
        i.ingest_log, state.change_writes(requests, F.col("seq") + AFTER_ALL)
    )


@query
def erase_subject(i: Inputs) -> DataFrame:
    return _after(i, state.ERASE)


@query
def apply_changes(i: Inputs) -> DataFrame:
    return state.apply_changes(i.interleaved)


@query
def apply_changes_reviving(i: Inputs) -> DataFrame:
    """Erasure not sticky: a later registration or update brings the record back."""
    return state.apply_changes(i.interleaved, sticky_erasure=False)


@query
def change_not_found(i: Inputs) -> DataFrame:
    return state.change_not_found(i.interleaved, i.interleaved_changes)


@query
def consent_transitions(i: Inputs) -> DataFrame:
    return state.consent_transitions(i.interleaved)


@query
def registry_compacted(i: Inputs) -> DataFrame:
    """The stored registry after two compactions: of all registrations, then of the buckets that
    changes touch."""
    out = shared_dir(i.spark)
    store.append_writes(i.ingest_log, out, 0)
    store.compact(i.spark, out)
    store.append_writes(i.changes_after_all(), out, 1)
    store.compact(i.spark, out)
    return store.snapshot(i.spark, out).withColumn("row_order", F.col("row_order.seq"))


@query
def purge_erased(i: Inputs) -> DataFrame:
    history = i.accepted.select("event_seq", KEY, *PII, "consent_status")
    erased = state.erased_keys(_after(i, state.ERASE))
    return state.purge_erased(history, erased)


# --- governed reads ---------------------------------------------------------------------------

def _open(requests: DataFrame, **columns) -> DataFrame:
    """Requests without policy, purpose or masking unless given."""
    base = {"allowed": F.lit(True), "masked": F.lit(False), "purpose": F.lit(ALL),
            "region_filter": F.lit(ALL), "pillar_filter": F.lit(ALL)}
    return requests.withColumns(base | columns)


@query
def directory_filter(i: Inputs) -> DataFrame:
    asked = _open(i.requests, region_filter=F.col("region"), pillar_filter=F.col("pillar"))
    return access.directory(asked, i.registry).select("region_filter", "pillar_filter", KEY)


@query
def purpose_filter(i: Inputs) -> DataFrame:
    asked = _open(i.requests, purpose=F.col("purpose"))
    return access.directory(asked, i.current).select("purpose", KEY)


@query
def row_policy_filter(i: Inputs) -> DataFrame:
    asked = _open(i.scoped, allowed=F.col("allowed"), region_filter=F.col("region_filter"),
                  pillar_filter=F.col("pillar_filter"))
    return access.directory(asked, i.registry).select(
        "region_filter", "pillar_filter", "n_requests", KEY
    )


@query
def erased_filter(i: Inputs) -> DataFrame:
    return access.linkable(i.current).select(KEY, "full_name", "status")


@query
def consent_gate(i: Inputs) -> DataFrame:
    return access.consent_gate(linking.link_messages(i.messages, i.current), i.current)


def _masked(i: Inputs, column: str) -> DataFrame:
    cleansed = standardise.standardise_events(i.events, keep=("event_seq",))
    return cleansed.select("event_seq", masks.MASKS[column](F.col(column)).alias(column))


@query
def mask_name(i: Inputs) -> DataFrame:
    return _masked(i, "full_name")


@query
def mask_national_id(i: Inputs) -> DataFrame:
    return _masked(i, "national_id")


@query
def mask_email(i: Inputs) -> DataFrame:
    return _masked(i, "email")


@query
def mask_phone(i: Inputs) -> DataFrame:
    return _masked(i, "phone")


def _odd(features: DataFrame) -> DataFrame:
    """Accesses with a given verdict, in place of a model's: at night and out of scope."""
    odd = (F.col("hour_of_day") < 6) & (F.col("region_mismatch") == 1)
    return features.withColumn("is_anomaly", F.when(odd, 1).otherwise(0))


def _verdicts(i: Inputs) -> DataFrame:
    return _odd(i.features)


@query
def mask_decision(i: Inputs) -> DataFrame:
    return access.mask_decision(_verdicts(i)).select("request_id", "allowed", "masked")


@query
def directory_masked(i: Inputs) -> DataFrame:
    return access.directory(access.mask_decision(_verdicts(i)), i.current)


@query
def policy_join(i: Inputs) -> DataFrame:
    policy = lookup(access.policy_of(i.requests))
    return access.policy_join(i.requests, policy).select(
        "request_id", "role", "region_scope", "pillar_scope", "allowed")


@query
def request_volume(i: Inputs) -> DataFrame:
    return access.request_volume(i.scoped, i.current).select("request_id", "query_volume")


# --- linking ----------------------------------------------------------------------------------

@query
def link_messages_wide(i: Inputs) -> DataFrame:
    return linking.link_messages(i.messages, i.current)


@query
def link_messages_narrow(i: Inputs) -> DataFrame:
    return linking.link_messages(i.messages, i.current, linking.NARROW)


@query
def link_messages_tokens(i: Inputs) -> DataFrame:
    return linking.link_messages_tokens(i.messages, i.current)


# --- reports ----------------------------------------------------------------------------------

@query
def report_global(i: Inputs) -> DataFrame:
    return report.report_global(i.current)


@query
def report_by_pillar(i: Inputs) -> DataFrame:
    return report.report_by(i.current, "pillar")


@query
def report_by_region(i: Inputs) -> DataFrame:
    return report.report_by(i.current, "region")


@query
def report_all(i: Inputs) -> DataFrame:
    return report.report_all(i.current)


@query
def report_maintained(i: Inputs) -> DataFrame:
    """All reports of a stored registry, from the counts kept with its snapshot and the changes
    after it."""
    out = shared_dir(i.spark)
    store.append_writes(i.ingest_log, out, 0)
    store.compact(i.spark, out)
    store.append_writes(i.changes_after_all(), out, 1)
    return store.report_all(i.spark, out)


@query
def report_scope(i: Inputs) -> DataFrame:
    return report.scoped_reports(i.messages, i.current).select(
        "msg_id", "scope", "name", *report.COUNTS, "consent_rate"
    )


@query
def message_topic(i: Inputs) -> DataFrame:
    return report.message_topic(i.messages).select("msg_id", "topic")


# --- reconciliation ---------------------------------------------------------------------------

@query
def attendance_rate(i: Inputs) -> DataFrame:
    return recon.attendance_rate(i.attendance)


def _joined(i: Inputs) -> DataFrame:
    return recon.recon_join(recon.attendance_rate(i.attendance), i.disbursements, i.current)


@query
def recon_join(i: Inputs) -> DataFrame:
    return _joined(i)


@query
def expected_stipend(i: Inputs) -> DataFrame:
    return recon.expected_stipend(_joined(i)).select(KEY, "month", "expected")


def _reconciled(i: Inputs) -> DataFrame:
    return recon.reconcile(recon.expected_stipend(_joined(i)))


@query
def reconcile(i: Inputs) -> DataFrame:
    return _reconciled(i).select(KEY, "month", "expected", "actual", "outcome", "reason")


@query
def recall_and_hold(i: Inputs) -> DataFrame:
    return recon.recall_ledger(_reconciled(i))


@query
def recall_holds(i: Inputs) -> DataFrame:
    """The registry after the holds of the recall ledger."""
    ledger = recon.recall_ledger(_reconciled(i))
    as_of = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    holds = recon.hold_requests(ledger, F.lit(2 * AFTER_ALL), as_of)
    return state.apply_changes(
        i.ingest_log, i.changes_after_all(), state.change_writes(holds)
    ).select(KEY, "consent_status", "status", "enrollment_status")


@query
def recall_audit(i: Inputs) -> DataFrame:
    return recon.recall_audit(recon.recall_ledger(_reconciled(i)))


# --- models -----------------------------------------------------------------------------------

def _forest(i: Inputs) -> tuple[DataFrame, forest.IsolationForest]:
    features = stage(i.features)
    return features, forest.fit(features, FEATURES, "request_id")


@query
def access_features(i: Inputs) -> DataFrame:
    return i.features.select("request_id", *FEATURES)


@query
def isolation_forest_fit(i: Inputs) -> DataFrame:
    """A fitted forest as it is after it was published and loaded again."""
    out = shared_dir(i.spark)
    model = models.load(i.spark, out, models.publish(i.spark, _forest(i)[1], out))
    return model.to_frame(i.spark).withColumns({
        "score_threshold": F.lit(model.threshold), "trained_on": F.lit(model.trained_on)})


@query
def isolation_forest_score(i: Inputs) -> DataFrame:
    features, model = _forest(i)
    return model.flag(features).select("request_id", "is_anomaly")


@query
def access_alerts(i: Inputs) -> DataFrame:
    """Audit rows of all requests, given the verdicts."""
    return access.access_audit(access.mask_decision(_verdicts(i)))


@query
def access_alerts_scored(i: Inputs) -> DataFrame:
    """Audit rows of all requests with the verdicts of a forest fitted on them."""
    features, model = _forest(i)
    return access.access_audit(access.mask_decision(model.flag(features)))


def _by_words(messages: DataFrame) -> DataFrame:
    """Messages with the intent that their words tell."""
    lowered = F.lower("text")

    def holds(*words: str):
        return reduce(operator.or_, [F.contains(lowered, F.lit(w)) for w in words])

    return messages.withColumn(
        "intent",
        F.when(holds("futa"), "request_deletion").when(holds("withdraw", "opt in"), "update_consent")
        .when(holds("ripoti", "report"), "generate_report")
        .when(holds("show profile", "angalia"), "view_data").otherwise(intent.DEFAULT_INTENT),
    )


@query
def intent_fit(i: Inputs) -> DataFrame:
    """A classifier trained on messages labelled by their words."""
    labelled = _by_words(i.messages).select("text", "intent")
    return intent.gram_weights(labelled, intent.fit(labelled, hashed=1 << 16))


@query
def intent_predict(i: Inputs) -> DataFrame:
    return intent.predict(i.messages, intent.default_model(i.spark)).select("msg_id", "intent")


@query
def message_actions(i: Inputs) -> DataFrame:
    as_of = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    return handle_messages(
        i.messages, i.current, intent.default_model(i.spark), as_of
    ).actions


@query
def message_actions_given(i: Inputs) -> DataFrame:
    """What messages lead to, given their intents."""
    as_of = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    return handle_classified(_by_words(i.messages), i.current, as_of).actions


# --- streams ----------------------------------------------------------------------------------

def _stream_table(i: Inputs, table: str) -> DataFrame:
    """One test table as a stream; each table is a single file in the folder."""
    schema = tables.load(i.spark, i.sf_dir, table).schema
    return (
        i.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
        .parquet(i.sf_dir)
    )


def _drained(i: Inputs) -> str:
    events = tables.adapt(
        i.spark, "registrations",
        {"orders": _stream_table(i, "orders"),
         "customer": tables.load(i.spark, i.sf_dir, "customer")},
    )
    out = shared_dir(i.spark)
    ingest.start_ingest(files.parse_events(_payloads(events)), out).awaitTermination()
    return out


@query
def stream_ingest(i: Inputs) -> DataFrame:
    """The outcome of every streamed event, from the logs the stream wrote."""
    out = _drained(i)
    done = ingest.accepted(i.spark, out).select(
        "event_seq", F.lit("ACCEPTED").alias("log"), F.lit("").alias("failure_reasons")
    )
    return done.unionByName(
        ingest.quarantined(i.spark, out).select(
            F.col("event_id").alias("event_seq"), F.lit("QUARANTINE").alias("log"),
            "failure_reasons",
        )
    ).unionByName(
        ingest.audited(i.spark, out).select(
            F.col("seq").alias("event_seq"), F.lit("AUDIT").alias("log"),
            F.lit("").alias("failure_reasons"),
        )
    )


@query
def stream_upsert(i: Inputs) -> DataFrame:
    return ingest.registry(i.spark, _drained(i))


@query
def stream_access_alerts(i: Inputs) -> DataFrame:
    _, model = _forest(i)
    requests = tables.adapt(i.spark, "access_requests", {"events": _stream_table(i, "events")})
    volumes = stage(access.view_volumes(i.registry))
    policy = lookup(access.policy_of(i.requests))
    out = shared_dir(i.spark)
    alerts.start_alerts(requests, policy, volumes, model, out).awaitTermination()
    return alerts.alerts(i.spark, out).drop("batch_id")


class _Rule:
    """The verdicts of ``_verdicts``, in place of a model."""

    def flag_rows(self, features: DataFrame) -> DataFrame:
        return _odd(features)


@query
def stream_access_alerts_given(i: Inputs) -> DataFrame:
    """Streamed requests against the volumes of a stored registry, given the verdicts."""
    requests = tables.adapt(i.spark, "access_requests", {"events": _stream_table(i, "events")})
    out = shared_dir(i.spark)
    store.append_writes(i.ingest_log, f"{out}/registry", 0)
    alerts.start_alerts(
        requests, lookup(access.policy_of(i.requests)),
        alerts.live_volumes(i.spark, f"{out}/registry"), _Rule, f"{out}/alerts",
    ).awaitTermination()
    return alerts.alerts(i.spark, f"{out}/alerts").drop("batch_id")
