"""Ledger: admission, folds and verification.

Event rows have an object id, a sequence within it (or in the ledger) and typed payload columns. Folds are one aggregation by
object; "latest" is decided by the sequence, so the order of rows doesn't matter. Checks of neighbours join a
row with the one before it by sequence, never with a global window.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.canon import canonical, digest, first_code
from tallystone.functions.trees import tree_digest
from tallystone.operators.folds import fold_rows
from tallystone.operators.prefix import last_before
from tallystone.sources.scratch import written

GENESIS = "0" * 64


def idempotency(proposals: DataFrame) -> DataFrame:
    """(proposal_id, outcome, receipt_of): NEW for the first arrival of a key, REPLAY of its receipt for the same hash, else IDEMPOTENCY_KEY_REUSE."""
    first = proposals.groupBy("idempotency_key").agg(F.min_by(F.struct("proposal_id", "proposal_hash"), F.struct("arrival", "proposal_id")).alias("first"))
    j = proposals.join(first, "idempotency_key")
    outcome = F.when(F.col("first.proposal_id") == F.col("proposal_id"), "NEW").when(F.col("first.proposal_hash") == F.col("proposal_hash"), "REPLAY").otherwise("IDEMPOTENCY_KEY_REUSE")
    return j.select("proposal_id", outcome.alias("outcome"), F.when(outcome != "IDEMPOTENCY_KEY_REUSE", F.col("first.proposal_id")).alias("receipt_of"))


def version_pins(proposals: DataFrame, pins: dict[str, str]) -> DataFrame:
    """(proposal_id, code): the first pinned version that differs, in the order of `pins`; null if all agree."""
    rules = [(~F.col(name).eqNullSafe(F.lit(value)), f"{name.upper()}_MISMATCH") for name, value in pins.items()]
    return proposals.select("proposal_id", first_code(*rules).alias("code"))


def missing_reads(operations: DataFrame, reads: DataFrame, destructive: list[str]) -> DataFrame:
    """(proposal_id, target) of destructive operations whose proposal doesn't read their target."""
    need = operations.where(F.col("op").isin(destructive)).select("proposal_id", "target")
    return need.join(reads.select("proposal_id", "target"), ["proposal_id", "target"], "left_anti").distinct()


def precondition_check(guards: DataFrame, state: DataFrame) -> DataFrame:
    """(proposal_id, position, code, expected, actual): the first guard of a proposal that the state doesn't meet.

    guards: proposal_id, position, kind, object_id, expected; state: kind, object_id, actual. Codes: <KIND>_NOT_FOUND, <KIND>_MISMATCH.
    """
    j = guards.join(state, ["kind", "object_id"], "left").where(~F.col("expected").eqNullSafe(F.col("actual")))
    code = F.concat("kind", F.when(F.col("actual").isNull(), "_NOT_FOUND").otherwise("_MISMATCH"))
    worst = F.min(F.struct("position", code.alias("code"), "expected", "actual")).alias("w")
    return j.groupBy("proposal_id").agg(worst).select("proposal_id", "w.*")


def first_writer_wins(proposals: DataFrame, initial: int = 1) -> DataFrame:
    """(proposal_id, aggregate_id, admitted): per aggregate, in order of arrival, a write from the current version is admitted and advances it.

    The writes of one aggregate stream through one task, as they do in any serial history.
    """
    rows = proposals.select("aggregate_id", "arrival", "proposal_id", "base_version")
    told = fold_rows(rows, "aggregate_id", ["arrival", "proposal_id"], ["base_version"], "admitted boolean", initial, lambda v, base: (v + (base == v), base == v))
    return told.select("proposal_id", "aggregate_id", "admitted")


def receipt_outcome(checks: DataFrame) -> DataFrame:
    """(proposal_id, outcome, reason) from columns invalid, stale (codes or null) and opened (number of conflicts).

    VALIDATION_ERROR before TRANSACTION_CONFLICT before FACT_CONFLICT before COMMITTED.
    """
    outcome = F.when(F.col("invalid").isNotNull(), "VALIDATION_ERROR").when(F.col("stale").isNotNull(), "TRANSACTION_CONFLICT").when(F.col("opened") > 0, "FACT_CONFLICT").otherwise("COMMITTED")
    return checks.select("proposal_id", outcome.alias("outcome"), F.coalesce("invalid", "stale").alias("reason"))


def ledger_events(ledger: DataFrame) -> DataFrame:
    """One row per event of each entry: the entry's columns but `events`, with position (from 0) and the event's fields."""
    keep = [c for c in ledger.columns if c != "events"]
    return ledger.select(*keep, F.posexplode("events").alias("position", "event")).select(*keep, "position", "event.*")


def fold_claims(events: DataFrame) -> DataFrame:
    """(object_id, status, version, superseded_by) of claims; evidence, supersession and retraction raise the version.

    events: object_id, seq, event_type, other_id. Only objects with a CLAIM_ASSERTED event count, from that event on.
    """
    kind = F.col("event_type")
    status = F.when(kind == "CLAIM_ASSERTED", "ACTIVE").when(kind == "CLAIM_SUPERSEDED", "SUPERSEDED").when(kind == "CLAIM_RETRACTED", "RETRACTED")
    e = events.withColumn("status", status)
    born = e.where(kind == "CLAIM_ASSERTED").groupBy("object_id").agg(F.min("seq").alias("born"))
    live = e.join(born, "object_id").where("seq >= born")
    agg = live.groupBy("object_id").agg(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"), (1 + F.count_if(kind != "CLAIM_ASSERTED")).cast("long").alias("version"), F.max_by("other_id", F.when(kind == "CLAIM_SUPERSEDED", F.col("seq"))).alias("superseded_by"))
    return agg


def fold_conflicts(events: DataFrame) -> DataFrame:
    """(object_id, status, episode, version, members) of conflicts through OPENED, EXTENDED, RESOLVED; opening again starts an episode.

    Members come from the last OPENED event, united with those of later EXTENDED ones.
    """
    kind = F.col("event_type")
    last = events.where(kind == "CONFLICT_OPENED").groupBy("object_id").agg(F.max("seq").alias("opened"), F.count("*").alias("episode"))
    j = events.join(last, "object_id")
    agg = j.groupBy("object_id").agg(F.max_by(F.when(kind == "CONFLICT_RESOLVED", "RESOLVED").otherwise("OPEN"), "seq").alias("status"), F.max("episode").alias("episode"), F.count("*").alias("version"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when((F.col("seq") >= F.col("opened")) & (kind != "CONFLICT_RESOLVED"), F.col("members")))))).alias("members"))
    return agg


def fold_latest(events: DataFrame, payload: list[str], versions: bool = True) -> DataFrame:
    """The payload columns of each object's last event, with version = number of its events."""
    out = events.groupBy("object_id").agg(F.max_by(F.struct(*payload), "seq").alias("p"), F.count("*").alias("version"))
    return out.select("object_id", "p.*", *(["version"] if versions else []))


def fold_decisions(events: DataFrame) -> DataFrame:
    """(object_id, status, replaced_by, version) by DECISION_RECORDED, DECISION_SUPERSEDED (with other_id) and DECISION_REVERSED."""
    status = F.when(F.col("event_type") == "DECISION_SUPERSEDED", "SUPERSEDED").when(F.col("event_type") == "DECISION_REVERSED", "REVERSED").otherwise("ACTIVE")
    return fold_latest(events.withColumn("status", status).withColumn("replaced_by", F.when(status == "SUPERSEDED", F.col("other_id"))), ["status", "replaced_by"])


def fold_questions(events: DataFrame) -> DataFrame:
    """(object_id, status, answer, drop_reason, version) by QUESTION_OPENED, QUESTION_ANSWERED and QUESTION_DROPPED (both with text)."""
    kind = F.col("event_type")
    status = F.when(kind == "QUESTION_ANSWERED", "ANSWERED").when(kind == "QUESTION_DROPPED", "DROPPED").otherwise("OPEN")
    return fold_latest(events.select("object_id", "seq", status.alias("status"), F.when(kind == "QUESTION_ANSWERED", F.col("text")).alias("answer"), F.when(kind == "QUESTION_DROPPED", F.col("text")).alias("drop_reason")), ["status", "answer", "drop_reason"])


def fold_work_items(events: DataFrame) -> DataFrame:
    """(object_id, status, blocker, version, valid): the last status and blocker; valid unless BLOCKED lacks a blocker or another status has one."""
    out = fold_latest(events, ["status", "blocker"])
    return out.withColumn("valid", (F.col("status") == "BLOCKED") == (F.length(F.coalesce("blocker", F.lit(""))) > 0))


def transition_check(events: DataFrame) -> DataFrame:
    """(object_id, seq, code) of events whose recorded previous_status or version differs from the history before them. The history of one object is checked by all tasks."""
    e = last_before(events, "object_id", "seq", F.struct("status"), "had", "n").withColumn("had", F.col("had.status"))
    code = first_code((~F.col("previous_status").eqNullSafe(F.col("had")), "PREVIOUS_STATUS_MISMATCH"), (F.col("version") != F.col("n"), "VERSION_MISMATCH"))
    return e.select("object_id", "seq", code.alias("code")).where("code is not null")


def replay_parity(folded: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, difference): MISSING in stored, UNEXPECTED there, or CHANGED, over the columns that both have."""
    columns = sorted(c for c in folded.columns if c in stored.columns and c != key)
    row = lambda df, name: df.select(key, F.sha2(canonical(F.struct(*columns)), 256).alias(name))
    j = row(folded, "a").join(row(stored, "b"), key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return j.select(key, F.when(F.col("b").isNull(), "MISSING").when(F.col("a").isNull(), "UNEXPECTED").otherwise("CHANGED").alias("difference"))


def sequence_gaps(ledger: DataFrame, key: str) -> DataFrame:
    """(key, seq) of entries without the one before them; the first has sequence 1. An equi-join, whatever the ledger's length."""
    before = ledger.select(key, (F.col("seq") + 1).alias("seq"))
    return ledger.where("seq <> 1").select(key, "seq").join(before, [key, "seq"], "left_anti")


def entry_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit("|"), payload), 256)


def hash_chain_check(log: DataFrame, key: str) -> DataFrame:
    """(key, first_invalid): the first sequence at which prev_hash isn't the predecessor's hash or the own hash doesn't recompute; intact chains are absent.

    Rows meet their predecessor by (key, seq), so one long chain is checked in parallel like many short ones.
    """
    before = log.select(key, (F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("want"))
    j = log.join(before, [key, "seq"], "left")
    want = F.when(F.col("seq") == 1, F.lit(GENESIS)).otherwise(F.col("want"))
    bad = ~F.col("prev_hash").eqNullSafe(want) | ~F.col("entry_hash").eqNullSafe(entry_hash(F.col("prev_hash"), F.col("payload")))
    return j.where(bad).groupBy(key).agg(F.min("seq").alias("first_invalid"))


def _link(previous: str | None, payload: str | None) -> tuple[str | None, str | None, str | None]:
    own = None if previous is None or payload is None else hashlib.sha256(f"{previous}|{payload}".encode()).hexdigest()
    return own, previous, own


def hash_chain_build(events: DataFrame, key: str) -> DataFrame:
    """(key, seq, payload, prev_hash, entry_hash): an append chain per key over its events in order. Behind a null payload all hashes are null.

    A chain is serial by its nature: its entries stream through one task that holds one hash.
    """
    return fold_rows(events.select(key, "seq", "payload"), key, ["seq", "payload"], ["payload"], "prev_hash string, entry_hash string", GENESIS, _link)


def receipt_coverage(ledger: DataFrame, receipts: DataFrame) -> DataFrame:
    """(seq, receipts) of entries that don't have exactly one accepted receipt."""
    n = receipts.where(F.col("outcome").isin("COMMITTED", "FACT_CONFLICT")).groupBy(F.col("ledger_seq").alias("seq")).agg(F.count("*").alias("receipts"))
    return ledger.select("seq").join(n, "seq", "left").na.fill(0, ["receipts"]).where("receipts <> 1")


def receipt_parity(receipts: DataFrame, ledger: DataFrame) -> DataFrame:
    """(receipt_id, code): the first way in which an accepted receipt disagrees with its entry."""
    have = ledger.select(F.col("seq").alias("ledger_seq"), F.col("proposal_hash").alias("want_hash"), F.col("opened"))
    j = receipts.where(F.col("outcome").isin("COMMITTED", "FACT_CONFLICT")).join(have, "ledger_seq", "left")
    code = first_code(
        (F.col("want_hash").isNull(), "ENTRY_NOT_FOUND"),
        (F.col("proposal_hash") != F.col("want_hash"), "PROPOSAL_HASH_MISMATCH"),
        ((F.col("outcome") == "FACT_CONFLICT") != (F.col("opened") > 0), "OUTCOME_MISMATCH"),
        (F.size("reason_codes") > 0, "REASON_CODES_PRESENT"),
    )
    return j.select("receipt_id", code.alias("code")).where("code is not null")


def rejected_head_check(receipts: DataFrame, key: str) -> DataFrame:
    """(receipt_id) of rejected receipts that don't keep the head of the last accepted one before them (GENESIS if none), per log. One long log is checked by all tasks."""
    ok = F.col("outcome").isin("COMMITTED", "FACT_CONFLICT")
    r = last_before(receipts, key, "receipt_id", F.when(ok, F.col("head_after")), "head").withColumn("head", F.coalesce("head", F.lit(GENESIS)))
    return r.where(~ok & ((F.col("head_before") != F.col("head")) | (F.col("head_after") != F.col("head")))).select("receipt_id")


def proposals_with_outcome(proposals: DataFrame, receipts: DataFrame, outcome: str) -> DataFrame:
    """Proposals whose receipt has an outcome, with the receipt's id."""
    return proposals.join(receipts.where(F.col("outcome") == outcome).select("proposal_id", "receipt_id"), "proposal_id")


def history_index(entries: DataFrame) -> DataFrame:
    """(object_id, seq): the entries that name an object in any string under a JSON key `id` or ending in `_id`, at any depth but below a key `versions`.

    entries: seq, document (JSON text; what can't be parsed names nothing). Each pair once. The values of one level of nesting are walked at a time, all entries at once;
    only objects and arrays go on to the next level.
    """
    spark, found = entries.sparkSession, []
    at = entries.select("seq", F.try_parse_json("document").alias("v")).where("v is not null")
    while True:
        inner = at.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("seq", "key", "value").where("key is null or key <> 'versions'")
        kind = F.schema_of_variant("value")
        named = (F.col("key") == "id") | F.endswith(F.col("key"), F.lit("_id"))
        told = inner.select("seq", F.when((kind == "STRING") & named, F.try_variant_get("value", "$", "string")).alias("object_id"), F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.col("value")).alias("v"))
        level = written(told.where("object_id is not null or v is not null"), "history-level")
        found.append(level.where("object_id is not null").select("object_id", "seq"))
        at = level.where("v is not null").select("seq", "v")
        if at.limit(1).count() == 0:
            return reduce(DataFrame.union, found).distinct()


def bounded_history(index: DataFrame, n: int = 16) -> DataFrame:
    """(object_id, seq, omitted): the latest n sequences of each object, and how many older ones there are."""
    w = Window.partitionBy("object_id").orderBy(F.desc("seq"))
    total = index.groupBy("object_id").agg(F.greatest(F.count("*") - n, F.lit(0)).cast("long").alias("omitted"))
    latest = index.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("rank")
    return latest.join(total, "object_id")


def state_digest(rows: DataFrame, key: str) -> DataFrame:
    """(digest): one digest of a table, by levels: row digests in order of key within buckets, then buckets in order."""
    columns = sorted(c for c in rows.columns if c != key)
    name = F.col(key).cast("string")
    row = rows.select(name.alias("key"), F.sha2(F.concat_ws("|", name, *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]), 256).alias("value"))
    return tree_digest(row, [], "key", "value").select("digest")


def rebase_hints(guards: DataFrame, state: DataFrame) -> DataFrame:
    """(proposal_id, first_failed, expected, actual, replacements): for stale proposals, what to put in place of each guard that failed.

    replacements: array of (kind, object_id, actual) sorted by kind and id, for guards whose object exists.
    """
    j = guards.join(state, ["kind", "object_id"], "left").where(~F.col("expected").eqNullSafe(F.col("actual")))
    worst = F.min(F.struct("position", "kind", "object_id", "expected", "actual")).alias("w")
    values = F.array_sort(F.collect_set(F.when(F.col("actual").isNotNull(), F.struct("kind", "object_id", "actual")))).alias("replacements")
    out = j.groupBy("proposal_id").agg(worst, values)
    return out.select("proposal_id", F.concat_ws(":", "w.kind", "w.object_id").alias("first_failed"), F.col("w.expected").alias("expected"), F.col("w.actual").alias("actual"), "replacements")
