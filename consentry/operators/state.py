"""Keyed registry state as a fold over a log of writes.

Every operation writes a fixed set of columns of one key, and the last writer of a column wins.
That fold is associative: it needs no ordered loop, map tasks reduce their rows to one per key
before the shuffle, and a key with a third of all writes costs one row per map task.

A *write* is a row ``(seq, op, operator, <registry columns>)``; columns its ``op`` does not write
are null and ignored. ``operator`` is who asked for it, null if that is not known. ``seq`` is the
arrival order and unique: an integer, or in a stored log a struct of the batch and the integer
within it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consentry.functions import consent, text
from consentry.sources.staging import lookup, stage
from consentry.spec import (
    DEFAULT_CONSENT_TYPE, DEFAULT_SPEC, FLAGS, KEY, MESSAGE_CONSENT_TYPE, MESSAGE_OPERATOR, PII,
    REGISTRY_COLUMNS,
    WITHDRAW_WORDS, RegistrySpec,
)

INGEST, UPDATE, SELF_UPDATE, TEXT_UPDATE, ERASE, HOLD = (
    "ingest", "consent_update", "consent_self_update", "consent_text_update", "erase_subject",
    "hold",
)

# Columns written together, with the operations that write them.
_WRITERS: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = (
    (("pillar", "region"), (INGEST,)),
    ((*PII, "status"), (INGEST, ERASE)),
    (("consent_status", *FLAGS), (INGEST, UPDATE, SELF_UPDATE, TEXT_UPDATE, ERASE)),
    (("enrollment_status",), (INGEST, UPDATE, SELF_UPDATE, TEXT_UPDATE, ERASE, HOLD)),
    (("consent_type",), (INGEST, UPDATE, TEXT_UPDATE)),
    (("consent_date",), (INGEST, UPDATE, SELF_UPDATE, TEXT_UPDATE)),
)

WRITE_COLUMNS = ("seq", "op", "operator", *REGISTRY_COLUMNS)


def ingest_writes(rows: DataFrame, seq: Column) -> DataFrame:
    """Accepted registrations as writes of all columns."""
    return rows.select(*[c.alias(name) for name, c in ingest_columns(seq).items()])


def ingest_columns(seq: Column) -> dict[str, Column]:
    return {"seq": seq.cast("bigint"), "op": F.lit(INGEST), "operator": _nobody(),
            **{c: F.col(c) for c in REGISTRY_COLUMNS}}


def _nobody() -> Column:
    return F.lit(None).cast("string").alias("operator")


def change_writes(
    changes: DataFrame, seq: Column | None = None, spec: RegistrySpec = DEFAULT_SPEC
) -> DataFrame:
    """Typed change requests (``op, new_status, consent_type, f_*, as_of[, operator]``) as writes."""
    op = F.col("op")
    by_status = op.isin(UPDATE, TEXT_UPDATE)
    requested = dict(zip(FLAGS, ("f_sharing", "f_photo", "f_sms", "f_report")))
    sharing = F.coalesce(F.col("f_sharing"), F.lit(0))
    status = (
        F.when(by_status, F.col("new_status"))
        .when((op == SELF_UPDATE) & (sharing != 0), "Consented")
        .when(op.isin(SELF_UPDATE, ERASE), "Withdrawn")
    )
    granted = consent.all_or_none(F.col("new_status"))
    flags = {
        flag: F.when(by_status, granted[flag])
        .when(op == SELF_UPDATE, F.coalesce(F.col(requested[flag]), F.lit(0)))
        .when(op == ERASE, 0)
        for flag in FLAGS
    }
    values = {
        **{c: F.when(op == ERASE, spec.redacted) for c in PII},
        "pillar": F.lit(None).cast("string"),
        "region": F.lit(None).cast("string"),
        "consent_status": status,
        "consent_type": F.when(
            op == UPDATE, F.coalesce(F.col("consent_type"), F.lit(DEFAULT_CONSENT_TYPE))
        ).when(op == TEXT_UPDATE, MESSAGE_CONSENT_TYPE),
        "consent_date": F.when(op.isin(UPDATE, SELF_UPDATE, TEXT_UPDATE), F.col("as_of")),
        "status": F.when(op == ERASE, "Anonymized"),
        "enrollment_status": F.when(op == HOLD, "On Hold").otherwise(
            consent.enrollment_on_update(status)
        ),
        **flags,
    }
    return changes.select(
        (F.col("seq") if seq is None else seq).cast("bigint").alias("seq"),
        "op",
        F.col("operator") if "operator" in changes.columns else _nobody(),
        KEY,
        *[values[c].alias(c) for c in REGISTRY_COLUMNS if c != KEY],
    )


def snapshot_writes(registry: DataFrame) -> DataFrame:
    """A folded registry as writes at its ``row_order``, which every later write exceeds.

    An erased record comes back as an ingest and an erase of the same ``seq`` and values, so the
    erasure still holds for what follows.
    """
    ops = F.when(F.col("status") == "Anonymized", F.array(F.lit(INGEST), F.lit(ERASE))).otherwise(
        F.array(F.lit(INGEST))
    )
    return registry.select(
        F.col("row_order").alias("seq"), F.explode(ops).alias("op"), _nobody(), *REGISTRY_COLUMNS
    )


def first_ingest(writes: DataFrame) -> DataFrame:
    return (
        writes.filter(F.col("op") == INGEST).groupBy(KEY).agg(F.min("seq").alias("first_ingest"))
    )


def lifetimes(writes: DataFrame) -> DataFrame:
    """Per ingested key ``first_ingest`` and ``erased_at``, its first erase that found a record.

    One aggregation over three columns of the log decides nearly every key. Only keys with an erase
    both before and after their first ingest need their erases looked at again. Staged, see
    ``lookup``.
    """
    op, seq = F.col("op"), F.col("seq")
    marks = lookup(
        writes.groupBy(KEY).agg(
            F.min(F.when(op == INGEST, seq)).alias("first_ingest"),
            F.min(F.when(op == ERASE, seq)).alias("first_erase"),
            F.max(F.when(op == ERASE, seq)).alias("last_erase"),
        ).filter(F.col("first_ingest").isNotNull())
    )
    open_question = F.coalesce(
        F.expr("first_erase < first_ingest AND last_erase >= first_ingest"), F.lit(False)
    )
    decided = marks.filter(~open_question).select(
        KEY, "first_ingest",
        F.expr("if(first_erase >= first_ingest, first_erase, null)").alias("erased_at"),
    )
    reopened = marks.filter(open_question).select(KEY, "first_ingest")
    if reopened.isEmpty():
        return decided
    resolved = (
        writes.filter(op == ERASE).select(KEY, "seq").join(reopened, KEY)
        .filter("seq >= first_ingest")
        .groupBy(KEY, "first_ingest").agg(F.min("seq").alias("erased_at"))
    )
    return decided.unionByName(lookup(resolved))


def drop_after_erasure(writes: DataFrame) -> DataFrame:
    """Writes up to and including the erasure of their key: an erased person stays erased.

    Only keys with an erase, which are few, are looked at for when it took effect. The staged table
    behind ``lifetimes`` has a row for each of them, so Spark broadcasts it below its threshold, and
    then the fold that follows combines its rows before any shuffle.
    """
    asked = lookup(writes.filter(F.col("op") == ERASE).select(KEY).distinct())
    marks = writes.filter(F.col("op").isin(INGEST, ERASE)).select(KEY, "seq", "op")
    lives = lifetimes(marks.join(asked, KEY, "left_semi"))
    erased = lives.filter(F.col("erased_at").isNotNull()).select(KEY, "erased_at")
    return (
        writes.join(erased, KEY, "left")
        .filter(F.col("erased_at").isNull() | (F.col("seq") <= F.col("erased_at")))
        .drop("erased_at")
    )


def grouped(rows: DataFrame, *keys: str) -> GroupedData:
    """``rows`` by ``keys``, for aggregates of structs, which Spark sorts for. A sort tells most
    rows apart by eight bytes of its first key; ids begin alike, hashes of them do not. The
    hash is a column ``_hash`` of the result."""
    return rows.groupBy(F.xxhash64(*keys).alias("_hash"), *keys)


def fold(writes: DataFrame) -> DataFrame:
    """Current registry: 16 columns and ``row_order``, the ``seq`` of the last ingest.

    Changes that precede the first ingest of their key need no filter here: that ingest writes
    every column and is later than they are. Keys never ingested are not in the result.
    """
    groups = [
        F.max_by(F.struct(*columns), F.when(F.col("op").isin(*ops), F.col("seq"))).alias(f"_g{i}")
        for i, (columns, ops) in enumerate(_WRITERS)
    ]
    folded = grouped(writes, KEY).agg(
        F.max(F.when(F.col("op") == INGEST, F.col("seq"))).alias("row_order"), *groups
    )
    source = {c: f"_g{i}.{c}" for i, (columns, _) in enumerate(_WRITERS) for c in columns}
    return folded.filter(F.col("row_order").isNotNull()).select(
        *[F.col(source.get(c, c)).alias(c) for c in REGISTRY_COLUMNS], "row_order"
    )


def apply_changes(*logs: DataFrame, sticky_erasure: bool = True) -> DataFrame:
    writes = union_writes(*logs)
    return fold(drop_after_erasure(writes) if sticky_erasure else writes)


def union_writes(*logs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [log.select(*WRITE_COLUMNS) for log in logs])


def registry_upsert(rows: DataFrame, order: str) -> DataFrame:
    """Whole-row upsert: the last arrival of a key replaces all its columns."""
    value = [c for c in REGISTRY_COLUMNS if c != KEY]
    last = rows.groupBy(KEY).agg(
        F.max_by(F.struct(*value), F.col(order)).alias("_row"), F.max(order).alias("row_order")
    )
    return last.select(KEY, *[F.col(f"_row.{c}").alias(c) for c in value], "row_order")


def change_not_found(writes: DataFrame, changes: DataFrame) -> DataFrame:
    """Change writes on a key the registry did not hold at that moment.

    A self-service update of an unknown key is not reported to the caller, every other is.
    """
    return (
        changes.join(lookup(first_ingest(writes)), KEY, "left")
        .filter(F.col("first_ingest").isNull() | (F.col("first_ingest") > F.col("seq")))
        .select("seq", KEY, "op", (F.col("op") != SELF_UPDATE).alias("reported"))
    )


def effective_writes(writes: DataFrame, sticky_erasure: bool = True) -> DataFrame:
    """Writes that changed the registry: none before the key's first ingest, none after erasure."""
    if not sticky_erasure:
        born = lookup(first_ingest(writes))
        alive = writes.join(born, KEY).filter("seq >= first_ingest")
        return alive.drop("first_ingest")
    return (
        writes.join(lifetimes(writes), KEY)
        .filter("seq >= first_ingest AND (erased_at IS NULL OR seq <= erased_at)")
        .drop("first_ingest", "erased_at")
    )


def previous_value(
    rows: DataFrame, key: str, order: str, value: str, into: str, block: int = 1 << 20
) -> DataFrame:
    """``lag(value)`` per key in ``order``, without a task that holds a whole key.

    ``order`` is a unique integer, or a struct of a batch and such an integer, so a (key, block of
    ``order``) holds at most ``block`` rows; each is one window partition. The last value of every
    block is carried to the next block of its key over the much smaller table of blocks.

    The rows are shuffled by (key, block) explicitly: rows that arrive already grouped by key
    would satisfy the window as they are and leave a hot key in one task.
    """
    def start(n: Column) -> Column:
        return n.cast("bigint") - F.pmod(n, F.lit(block))

    at = F.col(order)
    batched = isinstance(rows.schema[order].dataType, T.StructType)
    blocked = rows.withColumn(
        "_block", F.struct(at["batch_id"], start(at["seq"])) if batched else start(at))
    blocked = blocked.repartition(key, "_block")
    last = blocked.groupBy(key, "_block").agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.col(order)).alias("_last")
    )
    carried = last.select(
        key, "_block",
        F.lag("_last").over(Window.partitionBy(key).orderBy("_block")).alias("_carried"),
    ).filter(F.col("_carried").isNotNull())
    within = Window.partitionBy(key, "_block").orderBy(order)
    lagged = blocked.withColumn("_prev", F.lag(F.struct(F.col(value).alias("v"))).over(within))
    return (
        lagged.join(carried, [key, "_block"], "left")
        .withColumn(into, F.coalesce(F.col("_prev"), F.col("_carried"))["v"])
        .drop("_block", "_prev", "_carried")
    )


def consent_transitions(
    writes: DataFrame, sticky_erasure: bool = True, block: int = 1 << 20
) -> DataFrame:
    """Old and new status of each staff update that took effect."""
    # Read twice below, so it is written once.
    statuses = stage(
        effective_writes(writes, sticky_erasure)
        .filter(F.col("op") != HOLD)
        .select("seq", KEY, "op", F.col("consent_status").alias("new_status"))
    )
    return (
        previous_value(statuses, KEY, "seq", "new_status", "old_status", block)
        .filter(F.col("op") == UPDATE)
        .select("seq", KEY, "old_status", "new_status")
    )


def text_consent_changes(linked: DataFrame, as_of: Column) -> DataFrame:
    """Linked messages ``(msg_id, text, beneficiary_id)`` as consent changes."""
    lowered = F.lower("text")
    withdraws = text.contains_any(lowered, WITHDRAW_WORDS)
    return request_rows(
        linked, TEXT_UPDATE, as_of,
        new_status=F.when(withdraws, "Withdrawn").otherwise("Consented"),
    )


def request_rows(
    linked: DataFrame, op: str, as_of: Column, new_status: Column | None = None
) -> DataFrame:
    """Change requests of one kind, one per message; ``seq`` is the message id."""
    none = F.lit(None)
    return linked.select(
        F.col("msg_id").alias("seq"),
        KEY,
        F.lit(op).alias("op"),
        (none.cast("string") if new_status is None else new_status).alias("new_status"),
        none.cast("string").alias("consent_type"),
        *[none.cast("int").alias(f) for f in ("f_sharing", "f_photo", "f_sms", "f_report")],
        as_of.alias("as_of"),
        F.lit(MESSAGE_OPERATOR).alias("operator"),
    )


def purge_erased(history: DataFrame, erased: DataFrame, columns: tuple[str, ...] = PII) -> DataFrame:
    """``history`` with ``columns`` nulled on every row of an erased key. Removes no row."""
    hit = lookup(erased.select(KEY).distinct()).withColumn("_erased", F.lit(True))
    joined = history.join(hit, KEY, "left")
    return joined.select(
        *[
            F.when(F.col("_erased").isNull(), F.col(c)).alias(c) if c in columns else F.col(c)
            for c in history.columns
        ]
    )


def erased_keys(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("status") == "Anonymized").select(KEY)
