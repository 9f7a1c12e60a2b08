"""Queries L01-L25, on a ledger that derives from events: one aggregate per user, in order of event_id."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallystone.operators import ledger as L
from tallystone.plans.derive import table


def steps(s, d):
    e = table(s, d, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.select("event_id", "user_id", "event_type", F.concat(F.lit("user_"), "user_id").alias("object_id"), F.row_number().over(w).cast("long").alias("seq"), F.concat_ws("|", "event_id", "event_type").alias("payload"))


STEPS = """steps AS (SELECT event_id, user_id, event_type, 'user_' || user_id AS object_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id || '|' || event_type AS payload FROM events)"""


def typed(s, d, names):
    """Steps with event types of a record kind: names maps the five raw types."""
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    e = steps(s, d)
    return e.withColumn("event_type", m[F.col("event_type")]).withColumn("other_id", F.concat(F.lit("next_"), "event_id")).withColumn("text", F.concat(F.lit("because "), "event_id")).where("event_type is not null")


CLAIM = {"signup": "CLAIM_ASSERTED", "view": "EVIDENCE_ATTACHED", "click": "EVIDENCE_ATTACHED", "error": "CLAIM_RETRACTED", "purchase": "CLAIM_SUPERSEDED"}
CONFLICT = {"signup": "CONFLICT_OPENED", "view": "CONFLICT_EXTENDED", "error": "CONFLICT_RESOLVED"}
DECISION = {"signup": "DECISION_RECORDED", "purchase": "DECISION_SUPERSEDED", "error": "DECISION_REVERSED"}
QUESTION = {"signup": "QUESTION_OPENED", "click": "QUESTION_ANSWERED", "error": "QUESTION_DROPPED"}


def work(s, d):
    status = F.create_map(*map(F.lit, ("signup", "TODO", "view", "DOING", "click", "DOING", "error", "BLOCKED", "purchase", "DONE")))[F.col("event_type")]
    e = steps(s, d).withColumn("status", status)
    w = Window.partitionBy("object_id").orderBy("seq")
    e = e.withColumn("blocker", F.when((status == "BLOCKED") & (F.col("event_id") % 4 != 0), F.concat(F.lit("waits for "), "event_id")))
    return e.withColumn("previous_status", F.when(F.col("event_id") % 31 == 0, "LOST").otherwise(F.lag("status").over(w))).withColumn("version", F.when(F.col("event_id") % 37 == 0, 0).otherwise(F.col("seq")))


WORK = f"""{STEPS}, work AS (SELECT *, CASE event_type WHEN 'signup' THEN 'TODO' WHEN 'error' THEN 'BLOCKED' WHEN 'purchase' THEN 'DONE' ELSE 'DOING' END AS status,
  CASE WHEN event_type = 'error' AND event_id % 4 <> 0 THEN 'waits for ' || event_id END AS blocker FROM steps)"""


def proposals(s, d):
    e = steps(s, d)
    base = F.when(F.col("event_id") % 5 == 0, F.col("seq") - 1).otherwise(F.col("seq"))
    return e.select(
        "event_id", F.concat(F.lit("proposal_"), "event_id").alias("proposal_id"), F.col("event_id").alias("arrival"), F.col("object_id").alias("aggregate_id"), base.alias("base_version"), F.col("seq").alias("current"),
        F.concat_ws(":", "user_id", F.col("seq") % 40).alias("idempotency_key"), F.sha2(F.concat_ws(":", "user_id", "event_type"), 256).alias("proposal_hash"),
        F.when(F.col("event_id") % 11 == 0, "schema@1").otherwise("schema@2").alias("schema_version"), F.when(F.col("event_id") % 13 == 0, None).otherwise(F.lit("registry@1")).alias("registry_version"),
    )


PROPOSALS = f"""{STEPS}, proposals AS (SELECT event_id, 'proposal_' || event_id AS proposal_id, event_id AS arrival, object_id AS aggregate_id, CASE WHEN event_id % 5 = 0 THEN seq - 1 ELSE seq END AS base_version, seq AS current,
  user_id || ':' || (seq % 40) AS idempotency_key, user_id || ':' || event_type AS proposal_hash FROM steps)"""


def guards(s, d):
    p = proposals(s, d)
    one = p.select("proposal_id", F.lit(0).alias("position"), F.lit("VERSION").alias("kind"), F.col("proposal_id").alias("object_id"), F.col("base_version").cast("string").alias("expected"))
    two = p.select("proposal_id", F.lit(1), F.lit("STATUS"), F.concat(F.when(F.col("event_id") % 17 == 0, "gone_").otherwise(""), F.col("proposal_id")), F.lit("ACTIVE"))
    state = p.select(F.lit("VERSION").alias("kind"), F.col("proposal_id").alias("object_id"), F.col("current").cast("string").alias("actual"))
    state = state.unionAll(p.select(F.lit("STATUS"), "proposal_id", F.when(F.col("event_id") % 19 == 0, "DONE").otherwise("ACTIVE")))
    return one.unionAll(two), state


GUARD_SQL = f"""{PROPOSALS}, failed AS (SELECT proposal_id, event_id, 0 AS position, 'VERSION' AS kind, proposal_id AS object_id, base_version::VARCHAR AS expected, current::VARCHAR AS actual FROM proposals WHERE event_id % 5 = 0
  UNION ALL SELECT proposal_id, event_id, 1, 'STATUS', CASE WHEN event_id % 17 = 0 THEN 'gone_' ELSE '' END || proposal_id, 'ACTIVE', CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'DONE' END FROM proposals WHERE event_id % 17 = 0 OR event_id % 19 = 0)"""


def outcomes(s, d):
    k = F.col("event_id")
    return proposals(s, d).withColumn("outcome", F.when(k % 11 == 0, "VALIDATION_ERROR").when(k % 5 == 0, "TRANSACTION_CONFLICT").when(k % 7 == 0, "FACT_CONFLICT").otherwise("COMMITTED"))


def ledger_and_receipts(s, d):
    o, k = outcomes(s, d), F.col("event_id")
    ledger = o.where(F.col("outcome").isin("COMMITTED", "FACT_CONFLICT")).select(k.alias("seq"), "proposal_hash", F.when(k % 7 == 0, 1).otherwise(0).alias("opened"))
    r = o.select((k * 2).alias("receipt_id"), "proposal_id", F.col("aggregate_id").alias("log"), "outcome", k.alias("ledger_seq"), F.when(k % 41 == 0, "other").otherwise(F.col("proposal_hash")).alias("proposal_hash"), F.when(k % 43 == 0, F.array(F.lit("X"))).otherwise(F.array().cast("array<string>")).alias("reason_codes"))
    r = r.where("ledger_seq % 47 <> 0")
    return ledger, r.unionAll(r.where("ledger_seq % 53 = 0").withColumn("receipt_id", F.col("receipt_id") + 1))


RECEIPTS = f"""{PROPOSALS}, outcomes AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'VALIDATION_ERROR' WHEN event_id % 5 = 0 THEN 'TRANSACTION_CONFLICT' WHEN event_id % 7 = 0 THEN 'FACT_CONFLICT' ELSE 'COMMITTED' END AS outcome FROM proposals),
receipts AS (SELECT event_id * 2 + x AS receipt_id, event_id AS ledger_seq, * FROM outcomes, (VALUES (0), (1)) AS v(x) WHERE event_id % 47 <> 0 AND (x = 0 OR event_id % 53 = 0))"""


def chain(s, d):
    return L.hash_chain_build(steps(s, d), "user_id")


def tampered(s, d):
    """The chain with some payloads changed afterwards."""
    return chain(s, d).withColumn("payload", F.when(F.substring_index("payload", "|", 1).cast("long") % 997 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))


def entries(s, d):
    """Three events to an entry."""
    e = steps(s, d)
    return e.groupBy("user_id", F.floor((F.col("seq") - 1) / 3).alias("entry")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("events"))


def heads(s, d):
    """Receipts with heads: the hash of the last accepted proposal; some rejected ones have moved it."""
    ok = F.col("outcome").isin("COMMITTED", "FACT_CONFLICT")
    w = Window.partitionBy("aggregate_id").orderBy("event_id")
    r = outcomes(s, d).withColumn("own", F.md5("proposal_id"))
    before = F.coalesce(F.last(F.when(ok, F.col("own")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(L.GENESIS))
    r = r.withColumn("head_before", before)
    return r.select(F.col("event_id").alias("receipt_id"), "aggregate_id", "outcome", "head_before", F.when(ok, F.col("own")).when(F.col("event_id") % 3 == 0, F.col("own")).otherwise(F.col("head_before")).alias("head_after"))


def documents_log(s, d):
    """Ledger entries as JSON documents that name users and parts of orders."""
    e = steps(s, d)
    doc = F.to_json(F.struct(F.col("object_id").alias("claim_id"), F.struct(F.concat(F.lit("kind_"), "event_type").alias("id"), F.lit("x").alias("name")).alias("inner"), F.concat(F.lit("e_"), F.col("event_id") % 100).alias("evidence_link_id")))
    return e.select(F.col("event_id").alias("seq"), doc.alias("document"))


def idempotency(s, d):
    return L.idempotency(proposals(s, d))


def missing_reads(s, d):
    e = steps(s, d)
    ops = e.select(F.concat(F.lit("proposal_"), "event_id").alias("proposal_id"), F.upper("event_type").alias("op"), F.col("object_id").alias("target"))
    reads = e.where("event_id % 3 <> 0").select(F.concat(F.lit("proposal_"), "event_id").alias("proposal_id"), F.col("object_id").alias("target"))
    return L.missing_reads(ops, reads, ["ERROR", "PURCHASE"])


def outcome(s, d):
    p, k = proposals(s, d), F.col("event_id")
    return L.receipt_outcome(p.select("proposal_id", F.when(k % 11 == 0, "SCHEMA_VERSION_MISMATCH").alias("invalid"), F.when(k % 5 == 0, "VERSION_MISMATCH").alias("stale"), F.when(k % 7 == 0, 2).otherwise(0).alias("opened")))


def conflicts_fold(s, d):
    e = typed(s, d, CONFLICT).withColumn("members", F.array(F.concat(F.lit("claim_"), F.col("event_id") % 10), F.concat(F.lit("claim_"), F.col("event_id") % 7)))
    out = L.fold_conflicts(e)
    return out.withColumn("members", F.array_join("members", ","))


def parity(s, d):
    folded = L.fold_work_items(work(s, d)).withColumn("n", F.substring("object_id", 6, 20).cast("long"))
    stored = folded.where("n % 10 <> 0").withColumn("status", F.when(F.col("n") % 7 == 0, "LOST").otherwise(F.col("status"))).unionByName(folded.where("n % 15 = 0").withColumn("object_id", F.concat("object_id", F.lit("_x"))))
    return L.replay_parity(folded.drop("n"), stored.drop("n"), "object_id")


def rebase(s, d):
    out = L.rebase_hints(*guards(s, d))
    text = F.transform("replacements", lambda r: F.concat_ws("=", r["kind"], r["actual"]))
    return out.withColumn("replacements", F.array_join(text, ","))


def digest_of(s, d):
    return L.state_digest(L.fold_work_items(work(s, d)).select("object_id", "status", "version"), "object_id")


QUERIES = {
    "l01_idempotency": idempotency,
    "l02_version_pins": lambda s, d: L.version_pins(proposals(s, d), {"schema_version": "schema@2", "registry_version": "registry@1"}),
    "l03_missing_reads": missing_reads,
    "l04_precondition_check": lambda s, d: L.precondition_check(*guards(s, d)),
    "l05_first_writer_wins": lambda s, d: L.first_writer_wins(proposals(s, d)),
    "l06_receipt_outcome": outcome,
    "l07_ledger_events": lambda s, d: L.ledger_events(entries(s, d)),
    "l08_fold_claims": lambda s, d: L.fold_claims(typed(s, d, CLAIM)),
    "l09_fold_conflicts": conflicts_fold,
    "l10_fold_decisions": lambda s, d: L.fold_decisions(typed(s, d, DECISION)),
    "l11_fold_questions": lambda s, d: L.fold_questions(typed(s, d, QUESTION)),
    "l12_fold_work_items": lambda s, d: L.fold_work_items(work(s, d)),
    "l13_transition_check": lambda s, d: L.transition_check(work(s, d)),
    "l14_replay_parity": parity,
    "l15_sequence_gaps": lambda s, d: L.sequence_gaps(steps(s, d).where("event_id % 29 <> 0"), "user_id"),
    "l16_hash_chain_check": lambda s, d: L.hash_chain_check(tampered(s, d), "user_id"),
    "l17_hash_chain_build": lambda s, d: chain(s, d).select("user_id", "seq", "prev_hash", "entry_hash"),
    "l18_receipt_coverage": lambda s, d: L.receipt_coverage(*ledger_and_receipts(s, d)),
    "l19_receipt_parity": lambda s, d: L.receipt_parity(*reversed(ledger_and_receipts(s, d))),
    "l20_rejected_head_check": lambda s, d: L.rejected_head_check(heads(s, d), "aggregate_id"),
    "l21_proposals_with_outcome": lambda s, d: L.proposals_with_outcome(proposals(s, d), ledger_and_receipts(s, d)[1], "FACT_CONFLICT").select("proposal_id", "receipt_id", "aggregate_id"),
    "l22_history_index": lambda s, d: L.history_index(documents_log(s, d)),
    "l23_bounded_history": lambda s, d: L.bounded_history(L.history_index(documents_log(s, d))),
    "l24_state_digest": digest_of,
    "l25_rebase_hints": rebase,
}

_MAPPED = {name: " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) for name, m in (("claim", CLAIM), ("decision", DECISION), ("question", QUESTION))}
_INDEX = f"""{STEPS}, index_ AS (SELECT DISTINCT unnest([object_id, 'kind_' || event_type, 'e_' || (event_id % 100)]) AS object_id, event_id AS seq FROM steps)"""
_FOLD = f"{WORK}, fold AS (SELECT object_id, arg_max(status, seq) AS status, arg_max(coalesce(blocker, ''), seq) AS blocker, count(*) AS version FROM work GROUP BY object_id)"

ORACLE_SQL = {
    "l01_idempotency": f"""WITH {PROPOSALS}, f AS (SELECT *, first_value(proposal_id) OVER w AS fp, first_value(proposal_hash) OVER w AS fh FROM proposals WINDOW w AS (PARTITION BY idempotency_key ORDER BY arrival)),
        o AS (SELECT *, CASE WHEN fp = proposal_id THEN 'NEW' WHEN fh = proposal_hash THEN 'REPLAY' ELSE 'IDEMPOTENCY_KEY_REUSE' END AS outcome FROM f) SELECT proposal_id, outcome, CASE WHEN outcome <> 'IDEMPOTENCY_KEY_REUSE' THEN fp END AS receipt_of FROM o""",
    "l02_version_pins": "SELECT 'proposal_' || event_id AS proposal_id, CASE WHEN event_id % 11 = 0 THEN 'SCHEMA_VERSION_MISMATCH' WHEN event_id % 13 = 0 THEN 'REGISTRY_VERSION_MISMATCH' END AS code FROM events",
    "l03_missing_reads": "SELECT 'proposal_' || event_id AS proposal_id, 'user_' || user_id AS target FROM events WHERE event_type IN ('error', 'purchase') AND event_id % 3 = 0",
    "l04_precondition_check": f"WITH {GUARD_SQL} SELECT proposal_id, position, kind || CASE WHEN actual IS NULL THEN '_NOT_FOUND' ELSE '_MISMATCH' END AS code, expected, actual FROM failed QUALIFY row_number() OVER (PARTITION BY proposal_id ORDER BY position) = 1",
    "l05_first_writer_wins": f"""WITH RECURSIVE {PROPOSALS}, walk AS (SELECT proposal_id, aggregate_id, current AS n, base_version = 1 AS admitted, CASE WHEN base_version = 1 THEN 2 ELSE 1 END AS v FROM proposals WHERE current = 1
        UNION ALL SELECT p.proposal_id, p.aggregate_id, p.current, p.base_version = w.v, CASE WHEN p.base_version = w.v THEN w.v + 1 ELSE w.v END FROM walk w JOIN proposals p ON p.aggregate_id = w.aggregate_id AND p.current = w.n + 1)
        SELECT proposal_id, aggregate_id, admitted FROM walk""",
    "l06_receipt_outcome": "SELECT 'proposal_' || event_id AS proposal_id, CASE WHEN event_id % 11 = 0 THEN 'VALIDATION_ERROR' WHEN event_id % 5 = 0 THEN 'TRANSACTION_CONFLICT' WHEN event_id % 7 = 0 THEN 'FACT_CONFLICT' ELSE 'COMMITTED' END AS outcome, CASE WHEN event_id % 11 = 0 THEN 'SCHEMA_VERSION_MISMATCH' WHEN event_id % 5 = 0 THEN 'VERSION_MISMATCH' END AS reason FROM events",
    "l07_ledger_events": f"WITH {STEPS} SELECT user_id, (seq - 1) // 3 AS entry, ((seq - 1) % 3)::INTEGER AS position, event_id, event_type FROM steps",
    "l08_fold_claims": f"""WITH {STEPS}, e AS (SELECT *, CASE event_type {_MAPPED['claim']} END AS t FROM steps), b AS (SELECT object_id, min(seq) AS born FROM e WHERE t = 'CLAIM_ASSERTED' GROUP BY 1)
        SELECT object_id, arg_max(CASE t WHEN 'CLAIM_ASSERTED' THEN 'ACTIVE' WHEN 'CLAIM_SUPERSEDED' THEN 'SUPERSEDED' ELSE 'RETRACTED' END, seq) FILTER (WHERE t <> 'EVIDENCE_ATTACHED') AS status, 1 + count(*) FILTER (WHERE t <> 'CLAIM_ASSERTED') AS version,
        arg_max('next_' || event_id, seq) FILTER (WHERE t = 'CLAIM_SUPERSEDED') AS superseded_by FROM e JOIN b USING (object_id) WHERE seq >= born GROUP BY object_id""",
    "l09_fold_conflicts": f"""WITH {STEPS}, e AS (SELECT * FROM steps WHERE event_type IN ('signup', 'view', 'error')), o AS (SELECT object_id, max(seq) AS opened, count(*) AS episode FROM e WHERE event_type = 'signup' GROUP BY 1),
        m AS (SELECT e.object_id, unnest(['claim_' || (event_id % 10), 'claim_' || (event_id % 7)]) AS member FROM e JOIN o USING (object_id) WHERE seq >= opened AND event_type <> 'error')
        SELECT e.object_id, arg_max(CASE WHEN event_type = 'error' THEN 'RESOLVED' ELSE 'OPEN' END, seq) AS status, max(episode) AS episode, count(*) AS version,
        (SELECT string_agg(DISTINCT member, ',' ORDER BY member) FROM m WHERE m.object_id = e.object_id) AS members FROM e JOIN o USING (object_id) GROUP BY e.object_id""",
    "l10_fold_decisions": f"""WITH {STEPS}, e AS (SELECT *, CASE event_type {_MAPPED['decision']} END AS t FROM steps), l AS (SELECT object_id, arg_max(t, seq) AS t, arg_max(event_id, seq) AS id, count(*) AS version FROM e WHERE t IS NOT NULL GROUP BY 1)
        SELECT object_id, CASE t WHEN 'DECISION_RECORDED' THEN 'ACTIVE' WHEN 'DECISION_SUPERSEDED' THEN 'SUPERSEDED' ELSE 'REVERSED' END AS status, CASE WHEN t = 'DECISION_SUPERSEDED' THEN 'next_' || id END AS replaced_by, version FROM l""",
    "l11_fold_questions": f"""WITH {STEPS}, e AS (SELECT *, CASE event_type {_MAPPED['question']} END AS t FROM steps), l AS (SELECT object_id, arg_max(t, seq) AS t, arg_max(event_id, seq) AS id, count(*) AS version FROM e WHERE t IS NOT NULL GROUP BY 1)
        SELECT object_id, CASE t WHEN 'QUESTION_OPENED' THEN 'OPEN' WHEN 'QUESTION_ANSWERED' THEN 'ANSWERED' ELSE 'DROPPED' END AS status, CASE WHEN t = 'QUESTION_ANSWERED' THEN 'because ' || id END AS answer, CASE WHEN t = 'QUESTION_DROPPED' THEN 'because ' || id END AS drop_reason, version FROM l""",
    "l12_fold_work_items": f"WITH {_FOLD} SELECT object_id, status, nullif(blocker, '') AS blocker, version, (status = 'BLOCKED') = (blocker <> '') AS valid FROM fold",
    "l13_transition_check": f"WITH {WORK} SELECT object_id, seq, CASE WHEN event_id % 31 = 0 THEN 'PREVIOUS_STATUS_MISMATCH' ELSE 'VERSION_MISMATCH' END AS code FROM work WHERE event_id % 31 = 0 OR event_id % 37 = 0",
    "l14_replay_parity": f"""WITH {STEPS}, u AS (SELECT DISTINCT user_id FROM steps) SELECT 'user_' || user_id AS object_id, CASE WHEN user_id % 10 = 0 THEN 'MISSING' ELSE 'CHANGED' END AS difference FROM u WHERE user_id % 10 = 0 OR user_id % 7 = 0
        UNION ALL SELECT 'user_' || user_id || '_x', 'UNEXPECTED' FROM u WHERE user_id % 15 = 0""",
    "l15_sequence_gaps": f"WITH {STEPS}, k AS (SELECT * FROM steps WHERE event_id % 29 <> 0) SELECT user_id, seq FROM k WHERE seq <> 1 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.user_id = k.user_id AND b.seq = k.seq - 1)",
    "l16_hash_chain_check": f"WITH {STEPS} SELECT user_id, min(seq) AS first_invalid FROM steps WHERE event_id % 997 = 0 GROUP BY user_id",
    "l17_hash_chain_build": f"""WITH RECURSIVE {STEPS}, walk AS (SELECT user_id, seq, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '|' || payload) AS entry_hash FROM steps WHERE seq = 1
        UNION ALL SELECT s.user_id, s.seq, w.entry_hash, sha256(w.entry_hash || '|' || s.payload) FROM walk w JOIN steps s ON s.user_id = w.user_id AND s.seq = w.seq + 1) SELECT * FROM walk""",
    "l18_receipt_coverage": f"""WITH {RECEIPTS} SELECT o.event_id AS seq, count(r.receipt_id) AS receipts FROM outcomes o LEFT JOIN receipts r ON r.ledger_seq = o.event_id WHERE o.outcome IN ('COMMITTED', 'FACT_CONFLICT') GROUP BY 1 HAVING count(r.receipt_id) <> 1""",
    "l19_receipt_parity": f"""WITH {RECEIPTS} SELECT receipt_id, CASE WHEN event_id % 41 = 0 THEN 'PROPOSAL_HASH_MISMATCH' ELSE 'REASON_CODES_PRESENT' END AS code FROM receipts WHERE outcome IN ('COMMITTED', 'FACT_CONFLICT') AND (event_id % 41 = 0 OR event_id % 43 = 0)""",
    "l20_rejected_head_check": f"WITH {RECEIPTS} SELECT event_id AS receipt_id FROM outcomes WHERE outcome IN ('VALIDATION_ERROR', 'TRANSACTION_CONFLICT') AND event_id % 3 = 0",
    "l21_proposals_with_outcome": f"WITH {RECEIPTS} SELECT proposal_id, receipt_id, aggregate_id FROM receipts WHERE outcome = 'FACT_CONFLICT'",
    "l22_history_index": f"WITH {_INDEX} SELECT * FROM index_",
    "l23_bounded_history": f"WITH {_INDEX} SELECT object_id, seq, greatest(count(*) OVER (PARTITION BY object_id) - 16, 0) AS omitted FROM index_ QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY seq DESC) <= 16",
    "l24_state_digest": f"""WITH {_FOLD}, r AS (SELECT sha256(object_id) AS b, object_id AS k, sha256(object_id || '|' || status || '|' || version) AS h FROM fold),
        g4 AS (SELECT substr(b, 1, 4) AS b, sha256(string_agg(h, '' ORDER BY k)) AS h FROM r GROUP BY ALL), g2 AS (SELECT substr(b, 1, 2) AS b, sha256(string_agg(h, '' ORDER BY b)) AS h FROM g4 GROUP BY substr(b, 1, 2)) SELECT 'sha256:' || sha256(string_agg(h, '' ORDER BY b)) AS digest FROM g2""",
    "l25_rebase_hints": f"""WITH {GUARD_SQL} SELECT proposal_id, arg_min(kind || ':' || object_id, position) AS first_failed, arg_min(expected, position) AS expected, CASE WHEN min(position) = 0 OR max(event_id) % 17 <> 0 THEN arg_min(coalesce(actual, ''), position) END AS actual,
        coalesce(string_agg(kind || '=' || actual, ',' ORDER BY kind, object_id), '') AS replacements FROM failed GROUP BY proposal_id""",
}
