"""A stored registry and everything one does with it.

``Registry(spark, root)`` keeps the write log, the snapshots, the quarantine and the audit log under
``root``. Each call is a Spark job over a batch of events, changes, requests or messages; arguments
and results are DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consentry.models.forest import IsolationForest
from consentry.operators import access, audit, state
from consentry.plans import batch
from consentry.plans.messages import MessageOutcome, handle_messages
from consentry.sources import manifest, store
from consentry.sources.files import append_batch, parse_events, write_csv
from consentry.sources.payload_log import read_payload_log
from consentry.sources.staging import discard, lookup, recorded, stage
from consentry.spec import ALL, DEFAULT_SPEC, KEY, RegistrySpec
from consentry.streaming import ingest


@dataclass
class Answer:
    """The rows of one directory request and how it was judged."""

    rows: DataFrame
    allowed: bool
    masked: bool
    is_anomaly: bool
    query_volume: int


# Kinds of batches. Each kind numbers its batches by itself: a stream's batch 5 and a caller's
# batch 5 of changes are two entries of the log, in this order.
_INGEST, _CHANGE, _READ, _MESSAGE, _KINDS = 0, 1, 2, 3, 4


def slot(batch_id: int, kind: int = _INGEST) -> int:
    """The number of a batch in the logs."""
    return batch_id * _KINDS + kind


class Registry:
    """All calls that write take a ``batch_id``, which orders them; a call repeated with the same
    number replaces what it wrote. Numbers must grow over time, also between kinds of calls: what
    ``compact`` has folded counts as earlier than everything that comes after.

    ``policy`` has the accounts ``(operator, role, region_scope, pillar_scope)``. Without one, only
    registered people may read, under their own id; everybody else is refused. Without
    ``sticky_erasure`` a later registration brings an erased record back. ``buckets`` is how many
    parts a new registry is folded and compacted by: a part is to be worth a few files."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        policy: DataFrame | None = None,
        forest: IsolationForest | None = None,
        intents: PipelineModel | None = None,
        spec: RegistrySpec = DEFAULT_SPEC,
        sticky_erasure: bool = True,
        buckets: int = manifest.BUCKETS,
    ):
        self.sticky_erasure, self._staged = sticky_erasure, []
        self.spark, self.root, self.spec = spark, root.rstrip("/"), spec
        manifest.create(spark, self.root, buckets)
        self.policy = policy if policy is not None else access.no_policy(spark)
        self.forest, self.intents = forest, intents

    # --- writing ------------------------------------------------------------------------------

    def load_csv(self, path: str, clean_csv: str) -> int:
        """Replace the registry by a raw file, if all of it passes the gate."""
        return batch.run(self.spark, path, clean_csv, self.root)

    def ingest(self, events: DataFrame, batch_id: int, at: str | None = None) -> None:
        """One batch of events; running it again changes nothing.

        ``events`` has the event columns, or is what ``files.parse_events`` makes of payload lines.
        ``event_seq`` (an offset of the source) is added if it is missing, and so is ``arrived_at``,
        as the time ``at``.
        """
        when = None if at is None else F.lit(at)
        with recorded(self._staged):
            ingest.store_batch(events, slot(batch_id), self.root, when)

    def ingest_stream(self, events: DataFrame):
        """Drain a stream of events; its batch numbers become the registry's."""
        return (
            ingest.timed(events).writeStream.foreachBatch(self.ingest)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(availableNow=True).start()
        )

    def ingest_folder(self, path: str):
        """Drain a folder of payload lines: what was not read before, in the order of its bytes."""
        lines = read_payload_log(self.spark, path, streaming=True)
        return self.ingest_stream(parse_events(lines.drop("file", "position")))

    def change(self, requests: DataFrame, batch_id: int) -> DataFrame:
        """Apply typed change requests; returns those whose record does not exist.

        ``seq`` orders the requests within the batch.
        """
        with recorded(self._staged):
            return self._change(requests, batch_id)

    def _change(self, requests: DataFrame, batch_id: int) -> DataFrame:
        place = slot(batch_id, _CHANGE)
        logged = stage(state.change_writes(requests, spec=self.spec))
        changes = logged.withColumn("seq", store.place(place, F.col("seq")))
        before = store.read_writes(self.spark, self.root).filter(F.col("batch_id") < place)
        # Only the records somebody asks to change matter, so nothing else is shuffled or staged.
        touched = lookup(changes.select(KEY).distinct())
        history = stage(state.union_writes(
            state.snapshot_writes(store.snapshot(self.spark, self.root)), before, changes,
        ).join(touched, KEY, "left_semi"))
        lost = stage(state.change_not_found(history, changes).withColumn("seq", F.col("seq.seq")))
        at = F.coalesce("consent_date", F.timestamp_micros(F.lit(0)).cast("timestamp_ntz"))
        asked = requests.select(
            F.col("seq").cast("bigint").alias("seq"), F.col("as_of").alias("timestamp"))
        rows = audit.change_audit(
            history, at, only=F.col("seq.batch_id") == place, seq="seq.seq"
        ).drop("timestamp").join(asked, "seq")
        store.append_writes(logged, self.root, place, rows.select(*audit.AUDIT_COLUMNS))
        return lost

    def compact(self, retain: int = 0) -> int:
        """Fold the log; afterwards no file holds what an erasure replaced: not the log, the older
        snapshots (but for ``retain`` of them), the quarantine, nor what calls have staged. Frames
        that earlier calls returned end with that."""
        with recorded(self._staged):
            version = store.compact(self.spark, self.root, self.sticky_erasure, retain)
            store.purge_quarantine(self.spark, self.root, ingest.QUARANTINE_SCHEMA)
        discard(self.spark, self._staged)
        return version

    # --- reading ------------------------------------------------------------------------------

    def current(self) -> DataFrame:
        with recorded(self._staged):
            return store.current(self.spark, self.root, self.sticky_erasure)

    def _has_log(self) -> bool:
        return not store.read_writes(self.spark, self.root).isEmpty()

    def audit_log(
        self, limit: int | None = None, since: str | None = None, until: str | None = None
    ) -> DataFrame:
        """Newest first, from ``since`` to before ``until``; only the months between are read."""
        return audit.newest_first(
            ingest.audited(self.spark, self.root, since, until), "batch_id", "seq", limit=limit)

    def quarantine(self, limit: int | None = None) -> DataFrame:
        return audit.newest_first(
            ingest.quarantined(self.spark, self.root), "batch_id", "event_id", limit=limit)

    def reports(self) -> DataFrame:
        with recorded(self._staged):
            return store.report_all(self.spark, self.root, self.sticky_erasure)

    def read(
        self, operator: str, at: str, batch_id: int, region: str = ALL, pillar: str = ALL,
        purpose: str = ALL, force_anonymize: bool = False,
    ) -> Answer:
        """One directory request: judged, logged, and answered by plain filters on the registry.

        Only the verdict, one row, comes to the driver. After ``compact`` the filters reach the
        snapshot's files. A batch of requests goes through ``access.directory`` instead.
        """
        with recorded(self._staged):
            return self._read(operator, at, batch_id, region, pillar, purpose, force_anonymize)

    def _read(
        self, operator: str, at: str, batch_id: int, region: str, pillar: str, purpose: str,
        force_anonymize: bool,
    ) -> Answer:
        # Folded once; the policy, the volumes and the rows read the written table.
        registry, place = self.current(), slot(batch_id, _READ)
        registry = stage(registry) if self._has_log() else registry
        request = self.spark.createDataFrame(
            [(0, at, operator, region, pillar, purpose, force_anonymize)],
            "request_id bigint, ts string, operator string, region string, pillar string, "
            "purpose string, force_anonymize boolean",
        ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        policy = self.policy.unionByName(access.people_policy(registry))
        scoped = access.row_policy(access.policy_join(
            request, policy.filter(F.col("operator") == operator), self.spec))
        features = access.access_features(
            access.request_volume(scoped, registry, self.spec), self.spec)
        judged = (
            self.forest.flag_rows(features) if self.forest
            else features.withColumn("is_anomaly", F.lit(0))
        )
        decided = stage(access.mask_decision(judged, self.spec))
        log = access.access_audit(decided).withColumn("ip_address", F.lit("127.0.0.1"))
        append_batch(log.select(*audit.AUDIT_COLUMNS), f"{self.root}/audit", place)
        d = decided.first()
        rows = (
            access.directory_filter(
                registry, d.region_filter, d.pillar_filter, d.purpose, self.spec)
            if d.allowed else registry.limit(0)
        )
        return Answer(
            rows.select(*access.masked_columns(F.lit(d.masked), self.spec)),
            d.allowed, d.masked, bool(d.is_anomaly), d.query_volume,
        )

    def messages(self, messages: DataFrame, at: str, batch_id: int) -> MessageOutcome:
        """Handle a batch of messages ``(msg_id, text)`` and apply the changes they ask for."""
        when = F.lit(at).cast("timestamp_ntz")
        with recorded(self._staged):
            done = handle_messages(messages, stage(self.current()), self.intents, when)
            self._change(done.changes, batch_id)
            # Reports and disclosures are logged beside the changes.
            append_batch(
                done.audit(when).select(*audit.AUDIT_COLUMNS), f"{self.root}/audit",
                slot(batch_id, _MESSAGE))
        return done

    def export(self, path: str) -> None:
        """The active directory, fully masked, as CSV."""
        active = self.current().filter(F.col("status") == "Active")
        write_csv(active.select(*access.masked_columns(F.lit(True), self.spec)), path, "overwrite")
