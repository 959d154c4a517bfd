"""The registry's domain as data: schemas, closed domains, quality rules, roles and purposes.

Operators take a ``RegistrySpec`` and hold no domain value of their own, so another registry
is another spec.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# Fixed values. Results depend on these exact strings, so they are stated as they are.
# ---------------------------------------------------------------------------------------------
PILLARS = ("Scholarship", "Plus", "Vocational", "Tech")
REGIONS = (
    "North Eastern", "Coastal", "Eastern", "Central", "Nairobi", "Nyanza", "Rift Valley", "Western",
)
REGION_ALIASES = {"north-eastern": "North Eastern", "riftvalley": "Rift Valley"}
CONSENT_STATUSES = ("Consented", "Pending", "Withdrawn")
PURPOSES = ("data_sharing", "photo_use", "sms_contact", "external_reporting")
ROLE_CODES = {
    "hq_admin": 0, "pillar_coord": 1, "field_officer": 1, "compliance_auditor": 2, "beneficiary": 2,
}
UNKNOWN_ROLE_CODE = 3
MASKED_ROLES = ("compliance_auditor", "beneficiary")
EMAIL_PATTERN = r"^[^@]+@[^@]+\.[^@]+$"
REDACTED = "[REDACTED_KDPA_REQUEST]"
DEFAULT_CONSENT_TYPE = "Digital Signature"
MESSAGE_CONSENT_TYPE = "Chatbot OTP"
WITHDRAW_WORDS = ("withdraw", "ondoa", "opt out", "revoke")
TOPIC_WORDS = {"privacy": ("kpc", "linda", "protect"), "rights": ("futa", "delete", "forgotten")}
LOCAL_ADDRESS = "127.0.0.1"
INGEST_OPERATOR = "streaming_pipeline"
MESSAGE_OPERATOR = "chatbot_interface"
DEFAULT_OPERATOR = "system"
REASON_FORMAT = "Validation failed on column '{column}' for check '{check}'"
ALERT_PREFIX = "[SECURITY ALERT] "
ALERT_SUFFIX = " Access flagged as ANOMALOUS by Machine Learning."
ACCESS_DETAILS = (
    "Query Directory (Region: %s, Pillar: %s, Purpose: %s). Returned %d records. "
    "Anonymization applied: %s."
)
INGEST_DETAILS = "Real-time stream registered beneficiary: %s under %s pillar."
UPDATE_DETAILS = "Changed consent status for %s from %s to %s via %s."
SELF_UPDATE_DETAILS = (
    "Beneficiary self-updated consent settings: DataSharing=%s, PhotoUse=%s, SMS=%s, ExtReport=%s. "
    "Status set to: %s."
)
TEXT_UPDATE_DETAILS = " consent via AI Chatbot self-service."
MESSAGE_ERASE_DETAILS = "Right to be Forgotten request executed via AI Chatbot self-service."
ERASE_DETAILS = "Executed Right to be Forgotten (KDPA redaction) for beneficiary profile %s."
REPORT_DETAILS = "Generated compliance status report via chatbot query."
DISCLOSURE_DETAILS = "Beneficiary accessed profile info via chatbot query."
STRICT_MESSAGES = {
    "beneficiary_id": "beneficiary_id cannot be null",
    "full_name": "full_name cannot be null",
    "pillar": "pillar must be Scholarship, Plus, Vocational, or Tech",
    "region": f"region must be one of {list(REGIONS)}",
    "consent_status": "consent_status must be Consented, Pending, or Withdrawn",
    "email": "email format is invalid",
}
# ---------------------------------------------------------------------------------------------

ALL = "All"
KEY = "beneficiary_id"
PII = ("full_name", "national_id", "email", "phone")
FLAGS = tuple(f"consent_{p}" for p in PURPOSES)

EVENT_COLUMNS = (
    KEY, "full_name", "national_id", "email", "phone", "pillar", "region",
    "consent_status", "consent_type", "consent_date", "status",
)
REGISTRY_COLUMNS = EVENT_COLUMNS + ("enrollment_status",) + FLAGS

EVENT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in EVENT_COLUMNS])
# Every column of a registry file is read as text; types are given afterwards, never inferred.
REGISTRY_CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in REGISTRY_COLUMNS])


@dataclass(frozen=True)
class Rule:
    """One expectation on one column.

    ``kind`` is ``not_null``, ``unique``, ``in_set`` or ``regex``. Set and pattern rules pass
    over nulls unless ``null_fails``.
    """

    kind: str
    column: str
    values: tuple[str, ...] = ()
    pattern: str = ""
    null_fails: bool = False
    message: str = ""

    @property
    def check(self) -> str:
        return {
            "not_null": "expect_column_values_to_not_be_null",
            "unique": "expect_column_values_to_be_unique",
            "in_set": "expect_column_values_to_be_in_set",
            "regex": "expect_column_values_to_match_regex",
        }[self.kind]

    @property
    def reason(self) -> str:
        return self.message or REASON_FORMAT.format(column=self.column, check=self.check)


ROW_RULES = (
    Rule("not_null", KEY),
    Rule("not_null", "full_name"),
    Rule("in_set", "pillar", values=PILLARS),
    Rule("in_set", "region", values=REGIONS),
    Rule("in_set", "consent_status", values=CONSENT_STATUSES),
    Rule("regex", "email", pattern=EMAIL_PATTERN),
)
BATCH_RULES = ROW_RULES[:1] + (Rule("unique", KEY),) + ROW_RULES[1:]
STRICT_RULES = tuple(
    replace(rule, null_fails=rule.kind == "in_set", message=STRICT_MESSAGES[rule.column])
    for rule in ROW_RULES
)


@dataclass(frozen=True)
class RegistrySpec:
    pillars: tuple[str, ...] = PILLARS
    regions: tuple[str, ...] = REGIONS
    region_aliases: dict[str, str] = field(default_factory=lambda: dict(REGION_ALIASES))
    purposes: tuple[str, ...] = PURPOSES
    row_rules: tuple[Rule, ...] = ROW_RULES
    batch_rules: tuple[Rule, ...] = BATCH_RULES
    strict_rules: tuple[Rule, ...] = STRICT_RULES
    # Columns the registry refuses to hold as null; an event that passes the gate with one of
    # them missing cannot be loaded.
    required: tuple[str, ...] = (
        "national_id", "email", "phone", "pillar", "region", "consent_status",
    )
    role_codes: dict[str, int] = field(default_factory=lambda: dict(ROLE_CODES))
    masked_roles: tuple[str, ...] = MASKED_ROLES
    redacted: str = REDACTED


DEFAULT_SPEC = RegistrySpec()
