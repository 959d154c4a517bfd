"""Messages to actions: classify, link to a record, then report, disclose, change or erase."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.functions.text import contains_any
from consentry.models import intent
from consentry.operators import access, audit, linking, report, state
from consentry.sources.staging import stage
from consentry.spec import KEY, WITHDRAW_WORDS

LINKED_INTENTS = ("view_data", "update_consent", "request_deletion")


@dataclass
class MessageOutcome:
    """``actions`` has one row per message; ``changes`` are requests for the registry fold;
    ``reports`` and ``disclosures`` carry what the messages asked for."""

    actions: DataFrame
    changes: DataFrame
    reports: DataFrame
    disclosures: DataFrame

    def audit(self, at: Column) -> DataFrame:
        """Audit rows of reports and disclosures; those of the changes come from the fold."""
        return audit.report_audit(self.reports, "msg_id", at).unionByName(
            audit.disclosure_audit(self.disclosures, "msg_id", at)
        )


def handle_messages(
    messages: DataFrame, registry: DataFrame, model: PipelineModel | None, as_of: Column
) -> MessageOutcome:
    """All messages see the registry as of the start of the batch."""
    return handle_classified(intent.predict(messages, model), registry, as_of)


def handle_classified(
    classified: DataFrame, registry: DataFrame, as_of: Column
) -> MessageOutcome:
    """Messages ``(msg_id, text, intent)`` to what they ask for.

    They are linked once and staged, since every kind of action reads them.
    """
    viewing = F.col("intent") == "view_data"
    changing = F.col("intent").isin("update_consent", "request_deletion")
    known = stage(classified)
    links = linking.link_messages(known.filter(viewing), registry).unionByName(
        linking.link_messages(known.filter(changing), registry, linking.NARROW)
    )
    linked = stage(known.join(links, "msg_id", "left"))

    disclosures = access.consent_gate(
        linked.filter(viewing & F.col(KEY).isNotNull()), registry
    )
    found = linked.filter(F.col(KEY).isNotNull())
    updates = state.text_consent_changes(
        found.filter(F.col("intent") == "update_consent"), as_of
    )
    erasures = state.request_rows(
        found.filter(F.col("intent") == "request_deletion"), state.ERASE, as_of
    )
    asked = linked.filter(F.col("intent") == "generate_report")
    reports = report.scoped_reports(asked.select("msg_id", "text"), registry)

    disclosed = disclosures.select("msg_id", "disclosed")
    missing = F.col("intent").isin(*LINKED_INTENTS) & F.col(KEY).isNull()
    scoped = report.message_topic(report.report_scope(linked))
    lowered = F.lower("text")
    actions = scoped.join(disclosed, "msg_id", "left").select(
        "msg_id",
        "intent",
        F.when(missing, "NOT_FOUND")
        .when(F.col("disclosed"), "DISCLOSURE")
        .when(viewing, "DENIED")
        .when(F.col("intent") == "update_consent", "CONSENT_CHANGE")
        .when(F.col("intent") == "request_deletion", "ERASURE")
        .when(F.col("intent") == "generate_report", "REPORT")
        .otherwise("ANSWER").alias("action"),
        KEY,
        F.when(missing, F.lit(None).cast("string"))
        .when(F.col("intent") == "update_consent",
              F.when(contains_any(lowered, WITHDRAW_WORDS), "Withdrawn").otherwise("Consented"))
        .when(F.col("intent") == "generate_report",
              F.concat_ws(": ", F.col("scope"), F.col("name")))
        .when(F.col("intent") == intent.DEFAULT_INTENT, F.col("topic")).alias("detail"),
    )
    return MessageOutcome(actions, updates.unionByName(erasures), reports, disclosures)


