"""The frames the registered queries start from, built from the test tables.

The routed events and the two registries are tables that many queries read. Each is written once
per application and folder, as the ingest job would, and not derived again by every reader.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consentry.operators import access, quality, state
from consentry.session import tune
from consentry.sources import tables
from consentry.sources.staging import stored
from consentry.spec import REGISTRY_COLUMNS
from consentry.streaming.ingest import route_events

# Added to the order of changes that are to follow all registrations.
AFTER_ALL = 1 << 48


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return tables.read(self.spark, self.sf_dir, name)

    @cached_property
    def events(self) -> DataFrame:
        return self.read("registrations")

    def _stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return stored(self.spark, (self.sf_dir, name), build)

    @cached_property
    def routing(self) -> DataFrame:
        """The ingest job from raw events, as a plan."""
        return route_events(self.events)

    @cached_property
    def routed(self) -> DataFrame:
        """The routed events as a stored table: the registry, quarantine and audit all read it."""
        return self._stored("routed", lambda: self.routing)

    @cached_property
    def accepted(self) -> DataFrame:
        return self.routed.filter(F.col("ingest_status") == quality.SUCCESS).select(
            "event_seq", "arrived_at", *REGISTRY_COLUMNS
        )

    @cached_property
    def registry(self) -> DataFrame:
        """The stored registry with all registrations upserted and no changes applied."""
        return self._stored(
            "registry", lambda: state.registry_upsert(self.accepted, "event_seq")
        )

    @cached_property
    def changes(self) -> DataFrame:
        return self.read("consent_changes")

    def changes_after_all(self, *ops: str) -> DataFrame:
        """Change writes of the given kinds, later than every registration."""
        chosen = self.changes.filter(F.col("op").isin(*ops)) if ops else self.changes
        return state.change_writes(chosen, F.col("seq") + AFTER_ALL)

    @cached_property
    def ingest_log(self) -> DataFrame:
        return state.ingest_writes(self.accepted, F.col("event_seq"))

    @cached_property
    def interleaved_changes(self) -> DataFrame:
        return state.change_writes(self.changes, F.col("seq") * 2 + 1)

    @cached_property
    def interleaved(self) -> DataFrame:
        """Registrations on even and changes on odd positions of one order."""
        return state.union_writes(
            state.ingest_writes(self.accepted, F.col("event_seq") * 2), self.interleaved_changes
        )

    @cached_property
    def current(self) -> DataFrame:
        """The stored registry after all registrations and then all changes."""
        return self._stored(
            "current", lambda: state.apply_changes(self.ingest_log, self.changes_after_all())
        )

    @cached_property
    def requests(self) -> DataFrame:
        return self.read("access_requests")

    @cached_property
    def scoped(self) -> DataFrame:
        policy = self._stored("policy", lambda: access.policy_of(self.requests))
        return access.row_policy(access.policy_join(self.requests, policy))

    @cached_property
    def messages(self) -> DataFrame:
        return self.read("messages")

    @cached_property
    def features(self) -> DataFrame:
        return access.access_features(access.request_volume(self.scoped, self.registry))

    @cached_property
    def attendance(self) -> DataFrame:
        return self.read("attendance")

    @cached_property
    def disbursements(self) -> DataFrame:
        return self.read("disbursements")
