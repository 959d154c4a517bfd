"""The registered queries as SQL for DuckDB, for checking results.

Written from the rules and not from the Spark plans: whole-table joins and windows where the
operators fold, look up or explode.
"""

from __future__ import annotations

import re

from consentry.plans.inputs import AFTER_ALL
from consentry.sources.tables import adapter_sql
from consentry.spec import (
    ALERT_PREFIX, ALERT_SUFFIX, BATCH_RULES, EVENT_COLUMNS, FLAGS, KEY, PII, PILLARS,
    PURPOSES, REDACTED, REGIONS, REGISTRY_COLUMNS, ROW_RULES, STRICT_RULES, Rule,
)

RUNS = r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def squeeze(c: str) -> str:
    return rf"regexp_replace({strip(c)}, '[\s\p{{Z}}]+', ' ', 'g')"


def title(c: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({c}, '{RUNS}', 1), "
            f"lambda x: upper(x[1]) || lower(x[2:])), '')")


def blank(c: str) -> str:
    return f"case when {strip(c)} <> '' then {c} end"


def phone(c: str) -> str:
    d = strip(f"replace({c}, ' ', '')")
    return (f"case when {d} like '07%' or {d} like '01%' then '+254' || {d}[2:] "
            f"when {d} like '7%' or {d} like '1%' then '+254' || {d} else {d} end")


def email(c: str) -> str:
    return f"lower({strip(c)})"


def pillar(c: str) -> str:
    whens = " ".join(f"when '{p.lower()}' then '{p}'" for p in PILLARS)
    return f"case {email(c)} {whens} else {c} end"


def region(c: str) -> str:
    t = title(strip(c))
    return (f"case lower({t}) when 'north-eastern' then 'North Eastern' "
            f"when 'riftvalley' then 'Rift Valley' else {t} end")


def names(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def broken(r: Rule) -> str:
    if r.kind == "not_null":
        return f"{r.column} is null"
    if r.kind == "in_set":
        test = f"{r.column} not in {names(r.values)}"
    else:
        test = f"not regexp_matches({r.column}, '{r.pattern}')"
    return f"({r.column} is null or {test})" if r.null_fails else (
        f"({r.column} is not null and {test})")


def reasons(rules) -> str:
    items = ", ".join(f"case when {broken(r)} then {text(r.reason)} end" for r in rules)
    return f"list_filter([{items}], lambda x: x is not null)"


def mask_name(c: str) -> str:
    s = squeeze(c)
    return (f"case when {c} <> '' and {c} <> '{REDACTED}' then case when contains({s}, ' ') "
            f"then {s}[1] || '. ' || substr({s}, instr({s}, ' ') + 1, 3) || '***' "
            f"else {c}[1:2] || '***' end else {c} end")


def _mask(c: str, body: str) -> str:
    return f"case when {c} <> '' and {c} <> '{REDACTED}' then {body} else {c} end"


MASKED = {
    "full_name": mask_name("full_name"),
    "national_id": _mask("national_id", "'*****' || right(national_id, 3)"),
    "email": _mask("email", "left(split_part(email, '@', 1), 2) || '***@' || split_part(email, '@', 2)"),
    "phone": _mask("phone", "left(phone, 4) || ' *** *** ' || right(phone, 2)"),
}

EVENTS = ", ".join(EVENT_COLUMNS)
COLS = ", ".join(REGISTRY_COLUMNS)
FLAG_LIST = ", ".join(FLAGS)

# --- the chain from raw tables to registries --------------------------------------------------

_CLEANSED = {
    "full_name": title(squeeze(blank("full_name"))),
    "email": email(blank("email")),
    "phone": phone(blank("phone")),
    "pillar": pillar(blank("pillar")),
    "region": region(blank("region")),
    "status": f"coalesce({blank('status')}, 'Active')",
    "consent_date": f"try_cast({blank('consent_date')} as timestamp)",
}


def _flags(status: str) -> str:
    return ", ".join(f"case when {status} = 'Consented' then 1 else 0 end as {f}" for f in FLAGS)


STEPS: dict[str, str] = {
    "registrations": adapter_sql("registrations", spark=False),
    "requests": adapter_sql("access_requests", spark=False),
    "changes": adapter_sql("consent_changes", spark=False),
    "messages": adapter_sql("messages", spark=False),
    "attendance": adapter_sql("attendance", spark=False),
    "disbursements": adapter_sql("disbursements", spark=False),
    "cleansed": (
        "select event_seq, arrived_at, "
        + ", ".join(f"{_CLEANSED.get(c, blank(c))} as {c}" for c in EVENT_COLUMNS)
        + " from registrations"
    ),
    "standard": (
        f"select *, case consent_status when 'Consented' then 'Enrolled' "
        f"when 'Pending' then 'Pending Review' else 'On Hold' end as enrollment_status, "
        f"{_flags('consent_status')} from cleansed"
    ),
    "routed": (
        "select *, case when len(broken) > 0 then 'QUARANTINED' when len(missing) > 0 then 'ERROR' "
        "else 'SUCCESS' end as ingest_status, array_to_string(case when len(broken) > 0 then broken "
        "else missing end, '; ') as failure_reasons from (select *, "
        f"{reasons(ROW_RULES)} as broken, list_filter(["
        + ", ".join(
            f"case when {c} is null then 'Load failed on column ''{c}'': value is null' end"
            for c in ("national_id", "email", "phone", "pillar", "region", "consent_status"))
        + "], lambda x: x is not null) as missing from standard)"
    ),
    "accepted": f"select event_seq, arrived_at, {COLS} from routed where ingest_status = 'SUCCESS'",
    "registry": (
        f"select {COLS}, event_seq as row_order from accepted "
        f"qualify row_number() over (partition by {KEY} order by event_seq desc) = 1"
    ),
    # Change requests with the status they set.
    "settled": (
        "select seq, beneficiary_id, op, operator, as_of, consent_type as asked_type, "
        "case when op in ('consent_update', 'consent_text_update') then new_status "
        "when op = 'consent_self_update' and f_sharing <> 0 then 'Consented' "
        "when op in ('consent_self_update', 'erase_subject') then 'Withdrawn' end as consent_status, "
        "f_sharing, f_photo, f_sms, f_report from changes"
    ),
    "change_writes": (
        "select seq, op, operator, beneficiary_id, "
        + ", ".join(f"case when op = 'erase_subject' then '{REDACTED}' end as {c}" for c in PII)
        + ", cast(null as varchar) as pillar, cast(null as varchar) as region, consent_status, "
        "case op when 'consent_update' then coalesce(asked_type, 'Digital Signature') "
        "when 'consent_text_update' then 'Chatbot OTP' end as consent_type, "
        "case when op <> 'erase_subject' then as_of end as consent_date, "
        "case when op = 'erase_subject' then 'Anonymized' end as status, "
        "case when consent_status = 'Consented' then 'Enrolled' else 'On Hold' end "
        "as enrollment_status, "
        + ", ".join(
            f"case when op in ('consent_update', 'consent_text_update') then "
            f"case when consent_status = 'Consented' then 1 else 0 end "
            f"when op = 'consent_self_update' then {asked} else 0 end as {flag}"
            for flag, asked in zip(FLAGS, ("f_sharing", "f_photo", "f_sms", "f_report")))
        + " from settled"
    ),
    "ingest_writes": f"select event_seq as seq, 'ingest' as op, {COLS} from accepted",
    "after_all": (
        f"select * from ingest_writes union all by name "
        f"select * replace (seq + {AFTER_ALL} as seq) from change_writes"
    ),
    "interleaved": (
        "select * replace (seq * 2 as seq) from ingest_writes union all by name "
        "select * replace (seq * 2 + 1 as seq) from change_writes"
    ),
}


def fold_sql(source: str) -> str:
    """Last writer per column, by the written column sets."""
    every = "('ingest', 'consent_update', 'consent_self_update', 'consent_text_update', " \
            "'erase_subject')"
    sets = (
        (("pillar", "region"), "('ingest')"),
        ((*PII, "status"), "('ingest', 'erase_subject')"),
        (("consent_status", *FLAGS), every),
        (("enrollment_status",), every[:-1] + ", 'hold')"),
        (("consent_type",), "('ingest', 'consent_update', 'consent_text_update')"),
        (("consent_date",),
         "('ingest', 'consent_update', 'consent_self_update', 'consent_text_update')"),
    )
    columns = ", ".join(
        f"struct_extract(arg_max({{'v': {c}}}, seq) filter (where op in {ops}), 'v') as {c}"
        for group, ops in sets for c in group
    )
    return (f"select {KEY}, {columns}, max(seq) filter (where op = 'ingest') as row_order "
            f"from {source} group by {KEY} having row_order is not null")


def lives_sql(source: str) -> str:
    """First ingest of each key, and its first erase after that."""
    return (
        f"select b.{KEY}, b.first_ingest, min(e.seq) as erased_at from "
        f"(select {KEY}, min(seq) as first_ingest from {source} where op = 'ingest' group by 1) b "
        f"left join {source} e on e.{KEY} = b.{KEY} and e.op = 'erase_subject' "
        f"and e.seq > b.first_ingest group by 1, 2"
    )


def alive_sql(source: str) -> str:
    return (
        f"select w.* from {source} w join ({lives_sql(source)}) l on l.{KEY} = w.{KEY} "
        "where w.seq >= l.first_ingest and (l.erased_at is null or w.seq <= l.erased_at)"
    )


STEPS["current"] = fold_sql(f"({alive_sql('after_all')})")
STEPS["scoped"] = (
    "select r.request_id, r.ts, r.operator, p.role, p.region_scope, p.pillar_scope, r.region, "
    "r.pillar, r.purpose, r.force_anonymize, "
    "coalesce(p.role in ('hq_admin', 'pillar_coord', 'field_officer', 'compliance_auditor', "
    "'beneficiary'), false) as allowed, "
    "case when p.role = 'field_officer' then p.region_scope else r.region end as region_filter, "
    "case when p.role = 'pillar_coord' then p.pillar_scope else r.pillar end as pillar_filter "
    "from requests r left join (select distinct operator, role, region_scope, pillar_scope "
    "from requests) p on p.operator = r.operator"
)


def sees(record: str = "b", view: str = "v") -> str:
    purposes = " or ".join(
        f"({view}.purpose = '{p}' and {record}.consent_{p} = 1)" for p in PURPOSES)
    return (
        f"({view}.region_filter = 'All' or {view}.region_filter = {record}.region) and "
        f"({view}.pillar_filter = 'All' or {view}.pillar_filter = {record}.pillar) and "
        f"({view}.purpose = 'All' or {purposes})"
    )


def volume_sql(registry: str) -> str:
    return (
        "select s.*, case when s.allowed then coalesce(n.n, 0) else 0 end as query_volume "
        "from scoped s left join (select v.region_filter, v.pillar_filter, v.purpose, "
        "count(*) as n from (select distinct region_filter, pillar_filter, purpose from scoped) v "
        f"join {registry} b on {sees()} group by all) n "
        "on n.region_filter = s.region_filter and n.pillar_filter = s.pillar_filter "
        "and n.purpose = s.purpose"
    )


STEPS["features"] = (
    "select *, cast(hour(ts) as int) as hour_of_day, cast(case role when 'hq_admin' then 0 "
    "when 'pillar_coord' then 1 when 'field_officer' then 1 when 'compliance_auditor' then 2 "
    "when 'beneficiary' then 2 else 3 end as int) as role_code, "
    "case when (role = 'field_officer' and region <> region_scope) or "
    "(role = 'pillar_coord' and pillar <> pillar_scope) then 1 else 0 end as region_mismatch "
    f"from ({volume_sql('registry')})"
)
STEPS["decided"] = (
    "select *, force_anonymize or coalesce(role in ('compliance_auditor', 'beneficiary'), true) "
    "or is_anomaly = 1 as masked from (select *, case when hour_of_day < 6 and region_mismatch = 1 "
    "then 1 else 0 end as is_anomaly from features)"
)
STEPS["unflagged"] = (
    "select *, force_anonymize or role in ('compliance_auditor', 'beneficiary') as masked "
    "from (select *, 0 as is_anomaly from features)"
)
STEPS["rates"] = (
    "select beneficiary_id, month, cast(sum(sessions_held) as bigint) as sessions_held, "
    "cast(sum(sessions_attended) as bigint) as sessions_attended, "
    "sum(sessions_held) > 0 and sum(sessions_attended) * 100 >= sum(sessions_held) * 75 "
    "as attended_enough from attendance group by 1, 2"
)
STEPS["joined"] = (
    "select coalesce(a.beneficiary_id, d.beneficiary_id) as beneficiary_id, "
    "coalesce(a.month, d.month) as month, a.sessions_held, a.sessions_attended, "
    "coalesce(a.attended_enough, false) as attended_enough, "
    "coalesce(b.consent_data_sharing = 1, false) as consent_active, "
    "cast(coalesce(d.amount, 0) as bigint) as actual from rates a full join "
    "(select beneficiary_id, month, sum(amount) as amount from disbursements group by 1, 2) d "
    "on d.beneficiary_id = a.beneficiary_id and d.month = a.month "
    "left join current b on b.beneficiary_id = coalesce(a.beneficiary_id, d.beneficiary_id)"
)
STEPS["reconciled"] = (
    "select *, case when actual > expected then 'OVERPAID' when actual < expected then 'UNDERPAID' "
    "else 'MATCHED' end as outcome, case when actual <= expected then null "
    "when not attended_enough and not consent_active then 'low attendance; withdrawn consent' "
    "when not attended_enough then 'low attendance' when not consent_active "
    "then 'withdrawn consent' else 'above stipend' end as reason from (select *, "
    "cast(case when attended_enough and consent_active then 5000 else 0 end as bigint) as expected "
    "from joined)"
)
STEPS["ledger"] = (
    "select beneficiary_id, month, actual - expected as recall_amount, reason from reconciled "
    "where outcome = 'OVERPAID'"
)


def link_sql(registry: str, wide: bool, whole_words: bool = False) -> str:
    """First record, in registry order, that a message refers to."""
    first = f"split_part(lower({squeeze('b.full_name')}), ' ', 1)"
    if whole_words:
        token = r"[\p{L}\p{N}]+(?:[''-][\p{L}\p{N}]+)*"
        words = f"regexp_extract_all(lower(m.text), '{token}')"
        tests = [f"list_contains({words}, {k})" for k in (
            "lower(b.beneficiary_id)", first, "b.national_id", "replace(b.phone, '+', '')")]
    else:
        tests = [
            "contains(lower(m.text), lower(b.beneficiary_id))",
            f"({first} <> '' and contains(lower(m.text), {first}))",
        ]
        if wide:
            tests += [
                "contains(lower(m.text), b.national_id)",
                "contains(replace(lower(m.text), '+', ''), replace(b.phone, '+', ''))",
            ]
    return (
        "select m.msg_id, arg_min(b.beneficiary_id, b.row_order) as beneficiary_id "
        f"from messages m join {registry} b on {' or '.join(tests)} "
        f"where b.full_name <> '{REDACTED}' group by 1"
    )


STEPS["linked_wide"] = link_sql("current", True)
_COUNTS = (
    "count(*) as total, count(*) filter (where consent_status = 'Consented') as consented, "
    "count(*) filter (where consent_status = 'Pending') as pending, "
    "count(*) filter (where consent_status = 'Withdrawn') as withdrawn, "
    "count(*) filter (where status = 'Anonymized') as erasures, "
    "case when count(*) > 0 then round_even(count(*) filter (where consent_status = 'Consented') "
    "/ count(*) * 100, 1) else 0.0 end as consent_rate"
)
STEPS["reports"] = (
    f"select 'global' as scope, 'All' as name, {_COUNTS} from current union all "
    f"select 'pillar', pillar, {_COUNTS} from current group by pillar union all "
    f"select 'region', region, {_COUNTS} from current group by region"
)
STEPS["asked"] = (
    "select msg_id, case when p is not null then 'pillar' when r is not null then 'region' "
    "else 'global' end as scope, coalesce(p, r, 'All') as name from (select msg_id, case "
    + " ".join(f"when contains(lower(text), '{p.lower()}') then '{p}'" for p in PILLARS)
    + " end as p, case "
    + " ".join(f"when contains(lower(text), '{r.lower()}') then '{r}'" for r in REGIONS)
    + " end as r from messages)"
)
STEPS["given"] = (
    "select msg_id, t, case when contains(t, 'futa') then 'request_deletion' "
    "when contains(t, 'withdraw') or contains(t, 'opt in') then 'update_consent' "
    "when contains(t, 'ripoti') or contains(t, 'report') then 'generate_report' "
    "when contains(t, 'show profile') or contains(t, 'angalia') then 'view_data' "
    "else 'general_faq' end as intent from (select msg_id, lower(text) as t from messages)"
)
STEPS["linked_narrow"] = link_sql("current", False)
STEPS["given_links"] = (
    "select g.*, case intent when 'view_data' then w.beneficiary_id when 'update_consent' then "
    "n.beneficiary_id when 'request_deletion' then n.beneficiary_id end as beneficiary_id "
    "from given g left join linked_wide w on w.msg_id = g.msg_id "
    "left join linked_narrow n on n.msg_id = g.msg_id"
)
_BATCH = {"full_name": title(squeeze("full_name")), "phone": phone("phone")}
STEPS["batch"] = (
    "select " + ", ".join(f"{_BATCH.get(c, strip(c))} as {c}" for c in EVENT_COLUMNS)
    + f" from (select distinct {EVENTS} from registrations)"
)


def report_sql(source: str) -> str:
    parts = []
    for n, r in enumerate(BATCH_RULES):
        if r.kind == "unique":
            count = (f"coalesce((select sum(n) from (select count(*) as n from {source} "
                     f"where {r.column} is not null group by {r.column} having count(*) > 1)), 0)")
        else:
            count = f"(select count(*) from {source} where {broken(r)})"
        parts.append(
            f"select cast({n} as int) as position, {text(r.check)} as rule, "
            f"{text(r.column)} as column_name, cast({count} as bigint) as unexpected")
    return f"select *, unexpected = 0 as passed from ({' union all '.join(parts)})"


STEPS["routed_audit"] = (
    "select event_seq as seq, arrived_at as timestamp, 'streaming_pipeline' as operator, "
    "'BENEFICIARY_INGEST' as action_type, beneficiary_id as target_beneficiary_id, "
    "'Real-time stream registered beneficiary: ' || beneficiary_id || ' under ' || pillar || "
    "' pillar.' as details, '127.0.0.1' as ip_address, cast(0 as int) as is_anomaly "
    "from routed where ingest_status = 'SUCCESS'"
)
STEPS["change_audit"] = (
    "select seq, consent_date as timestamp, case op when 'consent_self_update' then beneficiary_id "
    "when 'consent_text_update' then 'chatbot_interface' else coalesce(operator, 'system') end "
    "as operator, "
    "case op when 'erase_subject' then 'ANONYMIZATION' else 'CONSENT_CHANGE' end as action_type, "
    "beneficiary_id as target_beneficiary_id, case op when 'consent_update' then "
    "'Changed consent status for ' || beneficiary_id || ' from ' || old_status || ' to ' || "
    "consent_status || ' via ' || consent_type || '.' when 'consent_self_update' then "
    "'Beneficiary self-updated consent settings: DataSharing=' || consent_data_sharing || "
    "', PhotoUse=' || consent_photo_use || ', SMS=' || consent_sms_contact || ', ExtReport=' || "
    "consent_external_reporting || '. Status set to: ' || enrollment_status || '.' "
    "when 'consent_text_update' then case consent_status when 'Withdrawn' then 'Withdrew consent' "
    "else 'Granted consent' end || ' via AI Chatbot self-service.' else case operator "
    "when 'chatbot_interface' then 'Right to be Forgotten request executed via AI Chatbot "
    "self-service.' else 'Executed Right to be Forgotten (KDPA redaction) for beneficiary profile ' "
    "|| beneficiary_id || '.' end end as details, '127.0.0.1' as ip_address, cast(0 as int) as is_anomaly "
    "from (select *, lag(consent_status) over (partition by beneficiary_id order by seq) "
    "as old_status from "
    f"(select w.* from interleaved w left join ({lives_sql('interleaved')}) l "
    "on l.beneficiary_id = w.beneficiary_id where case when l.first_ingest is null "
    "or w.seq < l.first_ingest then w.op = 'consent_self_update' else l.erased_at is null "
    "or w.seq <= l.erased_at end)) where op <> 'ingest'"
)


def access_audit(source: str) -> str:
    details = (
        "'Query Directory (Region: ' || region_filter || ', Pillar: ' || pillar_filter || "
        "', Purpose: ' || purpose || '). Returned ' || query_volume || "
        "' records. Anonymization applied: ' || case when masked then 'True' else 'False' end || '.'"
    )
    return (
        "select request_id as seq, ts as timestamp, operator, 'PII_ACCESS' as action_type, "
        "cast(null as varchar) as target_beneficiary_id, case when is_anomaly = 1 then "
        f"'{ALERT_PREFIX}' || {details} || '{ALERT_SUFFIX}' else {details} end as details, "
        f"cast(is_anomaly as int) as is_anomaly from {source}"
    )


STEPS["audit"] = (
    "select * from routed_audit union all by name select * from change_audit union all by name "
    f"select *, '127.0.0.1' as ip_address from ({access_audit('unflagged')})"
)
STEPS["quarantine"] = (
    "select r.event_seq as event_id, r.arrived_at as timestamp, cast(json_object("
    + ", ".join(f"'{c}', e.{c}" for c in EVENT_COLUMNS)
    + ") as varchar) as raw_payload, r.failure_reasons from routed r join registrations e "
    "on e.event_seq = r.event_seq where r.ingest_status <> 'SUCCESS'"
)
STEPS["quarantined_lines"] = (
    "select event_seq as event_id, arrived_at as timestamp, case when event_seq % 97 = 0 then "
    "left(line, length(line) - 5) else line end as raw_payload, case when event_seq % 97 = 0 then "
    "'payload is not a JSON object' else failure_reasons end as failure_reasons from ("
    "select e.event_seq, e.arrived_at, r.ingest_status, r.failure_reasons, cast(json_object("
    + ", ".join(f"'{c}', e.{c}" for c in EVENT_COLUMNS)
    + ", 'channel', 'kiosk') as varchar) as line from registrations e join routed r "
    "on e.event_seq = r.event_seq) where ingest_status <> 'SUCCESS' or event_seq % 97 = 0"
)
_ORDER = list(STEPS)


def _with(final: str) -> str:
    """``final`` with the steps it uses, directly or through others, in order."""
    def used(sql: str) -> set[str]:
        words = set(re.findall(r"\b(?:from|join)\s+\(*\s*([a-z_]+)", sql, flags=re.I))
        return {w for w in words if w in STEPS}

    need, todo = set(), used(final)
    while todo:
        step = todo.pop()
        if step not in need:
            need.add(step)
            todo |= used(STEPS[step])
    steps = ", ".join(f"{s} as materialized ({STEPS[s]})" for s in _ORDER if s in need)
    return f"with {steps} {final}" if steps else final


def _raw_csv() -> str:
    """The registry as the text a CSV file of it gives back."""
    def cell(c: str) -> str:
        if c == "consent_type":
            return "coalesce(consent_type, 'None') as consent_type"
        if c == "consent_date":
            return "cast(consent_date as varchar) as consent_date"
        return f"cast({c} as varchar) as {c}"
    return ", ".join(cell(c) for c in REGISTRY_COLUMNS)


def _typed() -> str:
    return ", ".join(
        "nullif(consent_type, 'None') as consent_type" if c == "consent_type" else c
        for c in REGISTRY_COLUMNS)


def _events(**columns: str) -> str:
    return "select event_seq, " + ", ".join(
        f"{sql} as {name}" for name, sql in columns.items()) + " from registrations"


def _violations(kind: str) -> str:
    rules = [r for r in ROW_RULES if r.kind == kind]
    return f"select event_seq, unnest({reasons(rules)}) as reason from standard"


def _gated(rules) -> str:
    return (f"select event_seq, len(r) = 0 as is_valid, array_to_string(r, '; ') as failure_reasons "
            f"from (select event_seq, {reasons(rules)} as r from standard)")


def _after(op: str) -> str:
    chosen = f"(select * from after_all where op in ('ingest', '{op}'))"
    return fold_sql(f"({alive_sql(chosen)})")


def _directory(views: str, registry: str, columns: str) -> str:
    return (f"select {columns} from (select region_filter, pillar_filter, purpose, masked, "
            f"count(*) as n_requests from ({views}) where allowed group by all) v "
            f"join {registry} b on {sees()}")


def _open(source: str, **columns: str) -> str:
    base = {"allowed": "true", "masked": "false", "purpose": "'All'", "region_filter": "'All'",
            "pillar_filter": "'All'"} | columns
    return "select " + ", ".join(f"{v} as {k}" for k, v in base.items()) + f" from {source}"


def _masked(column: str) -> str:
    return f"select event_seq, {MASKED[column]} as {column} from standard"


def _hidden(when: str) -> str:
    return ", ".join(
        f"case when {when} or status = 'Anonymized' then {MASKED[c]} else {c} end as {c}"
        if c in MASKED else c for c in REGISTRY_COLUMNS)


_TEXT_WRITES = (
    f"select seq, 'ingest' as op, {COLS} from ingest_writes union all by name "
    f"select m.msg_id + {AFTER_ALL} as seq, 'consent_text_update' as op, l.beneficiary_id, "
    "case when contains(t, 'withdraw') or contains(t, 'ondoa') or contains(t, 'opt out') "
    "or contains(t, 'revoke') then 'Withdrawn' else 'Consented' end as consent_status, "
    "'Chatbot OTP' as consent_type, timestamp '2025-01-01 00:00:00' as consent_date, "
    "case when consent_status = 'Consented' then 'Enrolled' else 'On Hold' end as "
    "enrollment_status, "
    + ", ".join(f"case when consent_status = 'Consented' then 1 else 0 end as {f}" for f in FLAGS)
    + f" from (select *, lower(text) as t from messages) m join ({link_sql('registry', False)}) l "
    "on l.msg_id = m.msg_id"
)


def _build() -> dict[str, str]:
    corrupt = "event_seq % 97 = 0"
    raw = _raw_csv()
    scan = f"select {raw} from registry"
    sql = {
        "scan_registry_csv": scan,
        "scan_report": "select count(*) as n_rows, cast(16 as int) as n_columns from registry",
        "stage_extract": scan,
        "load_registry_typed": f"select {_typed()} from registry",
        "sink_clean_csv": scan,
        "sink_registry_replace": f"select {_typed()} from registry",
        "source_registration_events": "select " + ", ".join(
            f"case when not {corrupt} then {c} end as {c}" for c in EVENT_COLUMNS)
        + f", {corrupt} as is_corrupt from registrations",
        "append_audit": "select * from audit",
        "audit_between": "select * from audit where timestamp >= timestamp '1994-03-15 12:00:00' "
        "and timestamp < timestamp '1995-06-01 00:00:00'",
        "audit_view": "select seq * 3 + case action_type when 'PII_ACCESS' then 2 "
        "when 'BENEFICIARY_INGEST' then 0 else 1 end as audit_id, * exclude (seq) from audit "
        "order by audit_id desc",
        "append_quarantine": "select * from quarantined_lines",
        "quarantine_purged": "select event_id, timestamp, case when e.k is null then raw_payload end "
        "as raw_payload, failure_reasons from quarantine q join registrations r "
        f"on r.event_seq = q.event_id left join (select distinct {KEY} as k from current "
        f"where status = 'Anonymized') e on trim(r.{KEY}) = e.k",
        "quarantine_view": "select * from quarantine order by event_id desc",
        "export_compliant_csv": "select " + ", ".join(
            f"cast({MASKED.get(c, c)} as varchar) as {c}" for c in REGISTRY_COLUMNS
            if c != "consent_date") + " from current where status = 'Active'",
        "blank_to_null": _events(**{c: blank(c) for c in EVENT_COLUMNS}),
        "strip_strings": _events(**{c: strip(c) for c in EVENT_COLUMNS}),
        "title_name": _events(full_name=title(squeeze("full_name"))),
        "phone_e164": _events(phone=phone("phone")),
        "email_normalise": _events(email=email("email")),
        "pillar_canonical": _events(pillar=pillar("pillar")),
        "region_canonical": _events(region=region("region")),
        "default_status": "select event_seq, status from cleansed",
        "derive_consent_ingest":
            f"select event_seq, consent_status, enrollment_status, {FLAG_LIST} from standard",
        "standardise_events": f"select event_seq, {COLS} from standard",
        "dedupe_rows": "select distinct beneficiary_id, full_name, email, phone, pillar, region, "
        "status from registrations",
        "clean_batch": "select * from batch",
        "expect_not_null": _violations("not_null"),
        "expect_in_set": _violations("in_set"),
        "expect_regex": _violations("regex"),
        "expect_unique": "select event_seq, beneficiary_id from registrations "
        "qualify count(*) over (partition by beneficiary_id) > 1",
        "gate_report": report_sql("batch"),
        "gate_batch": "select 'registry' as batch, true as accepted, cast(0 as bigint) as "
        "failed_rules, cast(0 as bigint) as unexpected union all select 'registrations', false, "
        "count(*) filter (where not passed), cast(sum(unexpected) as bigint) "
        f"from ({report_sql('batch')})",
        "gate_rows": _gated(ROW_RULES),
        "gate_rows_strict": _gated(STRICT_RULES),
        "route_ingest":
            "select event_seq, beneficiary_id, ingest_status, failure_reasons from routed",
        "ingest_outcomes": "select ingest_status, count(*) as n_events from routed group by 1",
        "registry_upsert": "select * from registry",
        "registry_compacted": "select * from current",
        "consent_update": _after("consent_update"),
        "consent_self_update": _after("consent_self_update"),
        "consent_text_update": fold_sql(f"({_TEXT_WRITES})"),
        "erase_subject": _after("erase_subject"),
        "apply_changes": fold_sql(f"({alive_sql('interleaved')})"),
        "apply_changes_reviving": fold_sql("interleaved"),
        "change_not_found": "select c.seq * 2 + 1 as seq, c.beneficiary_id, c.op, "
        "c.op <> 'consent_self_update' as reported from changes c where not exists (select 1 from "
        "interleaved w where w.op = 'ingest' and w.beneficiary_id = c.beneficiary_id "
        "and w.seq < c.seq * 2 + 1)",
        "consent_transitions": "select seq, beneficiary_id, old_status, consent_status as "
        "new_status from (select *, lag(consent_status) over (partition by beneficiary_id "
        f"order by seq) as old_status from ({alive_sql('interleaved')})) "
        "where op = 'consent_update'",
        "purge_erased": "select a.event_seq, a.beneficiary_id, " + ", ".join(
            f"case when e.beneficiary_id is null then a.{c} end as {c}" for c in PII)
        + ", a.consent_status from accepted a left join (select distinct w.beneficiary_id "
        "from after_all w join accepted r on r.beneficiary_id = w.beneficiary_id "
        "where w.op = 'erase_subject') e on e.beneficiary_id = a.beneficiary_id",
        "directory_filter": _directory(
            _open("requests", region_filter="region", pillar_filter="pillar"), "registry",
            "v.region_filter, v.pillar_filter, b.beneficiary_id"),
        "purpose_filter": _directory(
            _open("requests", purpose="purpose"), "current", "v.purpose, b.beneficiary_id"),
        "row_policy_filter": _directory(
            _open("scoped", allowed="allowed", region_filter="region_filter",
                  pillar_filter="pillar_filter"), "registry",
            "v.region_filter, v.pillar_filter, v.n_requests, b.beneficiary_id"),
        "erased_filter": "select beneficiary_id, full_name, status from current "
        f"where full_name <> '{REDACTED}'",
        "consent_gate": "select l.msg_id, b.beneficiary_id, "
        "b.consent_status = 'Consented' as disclosed, " + ", ".join(
            f"case when b.consent_status = 'Consented' then b.{c} end as {c}"
            for c in ("full_name", "email", "phone", "consent_type"))
        + ", b.pillar, b.region, b.consent_status from linked_wide l join current b "
        "on b.beneficiary_id = l.beneficiary_id",
        "mask_name": _masked("full_name"),
        "mask_national_id": _masked("national_id"),
        "mask_email": _masked("email"),
        "mask_phone": _masked("phone"),
        "mask_decision": "select request_id, allowed, masked from decided",
        "directory_masked": f"select region_filter, pillar_filter, purpose, masked, n_requests, "
        f"{_hidden('masked')} from ({_directory('select * from decided', 'current', 'v.*, b.*')})",
        "policy_join": "select request_id, role, region_scope, pillar_scope, allowed from scoped",
        "request_volume": "select request_id, cast(query_volume as bigint) as query_volume "
        f"from ({volume_sql('current')})",
        "link_messages_wide": "select * from linked_wide",
        "link_messages_narrow": link_sql("current", False),
        "link_messages_tokens": link_sql("current", True, whole_words=True),
        "report_global": f"select {_COUNTS} from current",
        "report_by_pillar": f"select pillar, {_COUNTS} from current group by pillar",
        "report_by_region": f"select region, {_COUNTS} from current group by region",
        "report_all": "select * from reports",
        "report_maintained": "select * from reports",
        "report_scope": "select a.msg_id, a.scope, a.name, r.* exclude (scope, name) from asked a "
        "left join reports r on r.scope = a.scope and r.name = a.name",
        "message_actions_given": "select g.msg_id, g.intent, case "
        "when intent in ('view_data', 'update_consent', 'request_deletion') "
        "and g.beneficiary_id is null then 'NOT_FOUND' when intent = 'view_data' then "
        "case when c.consent_status = 'Consented' then 'DISCLOSURE' else 'DENIED' end "
        "when intent = 'update_consent' then 'CONSENT_CHANGE' "
        "when intent = 'request_deletion' then 'ERASURE' "
        "when intent = 'generate_report' then 'REPORT' else 'ANSWER' end as action, "
        "g.beneficiary_id, case when intent = 'update_consent' and g.beneficiary_id is not null "
        "then case when contains(t, 'withdraw') or contains(t, 'ondoa') or contains(t, 'opt out') "
        "or contains(t, 'revoke') then 'Withdrawn' else 'Consented' end "
        "when intent = 'generate_report' then a.scope || ': ' || a.name "
        "when intent = 'general_faq' then case when contains(t, 'kpc') or contains(t, 'linda') "
        "or contains(t, 'protect') then 'privacy' when contains(t, 'futa') or "
        "contains(t, 'delete') or contains(t, 'forgotten') then 'rights' else 'help' end "
        "end as detail from given_links g left join current c "
        "on c.beneficiary_id = g.beneficiary_id left join asked a on a.msg_id = g.msg_id",
        "message_topic": "select msg_id, case when contains(t, 'kpc') or contains(t, 'linda') "
        "or contains(t, 'protect') then 'privacy' when contains(t, 'futa') or "
        "contains(t, 'delete') or contains(t, 'forgotten') then 'rights' else 'help' end as topic "
        "from (select msg_id, lower(text) as t from messages)",
        "attendance_rate": "select * from rates",
        "recon_join": "select * from joined",
        "expected_stipend": "select beneficiary_id, month, expected from reconciled",
        "reconcile":
            "select beneficiary_id, month, expected, actual, outcome, reason from reconciled",
        "recall_and_hold": "select * from ledger",
        "recall_holds": "select b.beneficiary_id, b.consent_status, b.status, case when exists "
        "(select 1 from ledger l where l.beneficiary_id = b.beneficiary_id) then 'On Hold' "
        "else b.enrollment_status end as enrollment_status from current b",
        "recall_audit": "select month as timestamp, 'system' as operator, 'PAYOUT_RECALL' as "
        "action_type, beneficiary_id as target_beneficiary_id, 'Recalled ' || recall_amount || "
        "' for ' || strftime(month, '%Y-%m') || ' (' || reason || '); account on hold.' as details, "
        "'127.0.0.1' as ip_address, cast(0 as int) as is_anomaly from ledger",
        "access_features": "select request_id, hour_of_day, role_code, region_mismatch, "
        "cast(query_volume as bigint) as query_volume from features",
        "access_alerts": access_audit("decided"),
        "stream_access_alerts_given": access_audit("decided"),
        "stream_ingest": "select event_seq, case ingest_status when 'SUCCESS' then 'ACCEPTED' "
        "else 'QUARANTINE' end as log, failure_reasons from routed union all "
        "select event_seq, 'AUDIT', '' from routed where ingest_status = 'SUCCESS'",
        "stream_upsert": "select * from registry",
        "stream_payload_registry": "select " + ", ".join(REGISTRY_COLUMNS) + " from (select *, "
        f"row_number() over (partition by {KEY} order by event_seq desc) as n from routed "
        "where ingest_status = 'SUCCESS' and event_seq % 97 <> 0) where n = 1",
    }
    return {name: _with(body) for name, body in sql.items()}


ORACLE_SQL = _build()

ORACLE_SQL["scan_quoted_csv"] = """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, text FROM documents
"""
