"""Queries C01-C15."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.operators import claims as C
from tallystone.plans import derive as D
from tallystone.sources.scratch import written


def flagship(spark, d) -> DataFrame:
    """Which claims contradict each other, and is each backed by its source bytes?"""
    evidence = written(D.evidence(spark, d), "evidence")
    checked = C.verify_evidence(evidence, D.sources(spark, d))
    links = evidence.select("evidence_id", "claim_id").join(checked, "evidence_id").groupBy("claim_id").agg(F.count("*").alias("links"), F.count_if(F.col("code") == "OK").alias("verified"))
    conflicts = C.conflict_episodes(D.claims(spark, d), D.registry(spark))
    members = conflicts.select("conflict_id", "kind", "opened_seq", F.explode("members").alias("claim_id"))
    return members.join(links, "claim_id", "left").na.fill(0, ["links", "verified"]).select("conflict_id", "kind", "opened_seq", "claim_id", "links", "verified")


def _pairs(s, d):
    return C.conflict_pairs(D.claims(s, d), D.registry(s))


def _conflicts(s, d):
    """The conflicts as a table, so that what reads them neither finds them again nor shares a task's memory with what does."""
    return written(C.conflict_episodes(D.claims(s, d), D.registry(s)), "conflicts")


def conformance(s, d):
    used = D.evidence(s, d).groupBy("claim_id").agg(F.collect_set("interpretation").alias("interpretations"))
    return C.conformance(D.claims(s, d), D.registry(s), used)


def hash_check(s, d):
    made = C.with_proposition_hash(D.claims(s, d))
    return C.proposition_hash_check(made.withColumn("declared_hash", F.when(F.col("seq") % 13 == 0, "sha256:old").otherwise(F.col("proposition_hash"))))


def overlap(s, d):
    c = D.claims(s, d).select("subject_id", "claim_id", "valid_from", "valid_to")
    a, b = c.alias("a"), c.alias("b")
    met = a.join(b, (F.col("a.subject_id") == F.col("b.subject_id")) & (F.col("a.claim_id") < F.col("b.claim_id")) & C.valid_time_overlap(F.col("a.valid_from"), F.col("a.valid_to"), F.col("b.valid_from"), F.col("b.valid_to")))
    return met.select(F.col("a.claim_id").alias("claim_a"), F.col("b.claim_id").alias("claim_b"))


def resolution_check(s, d):
    conflicts = _conflicts(s, d)
    return C.resolution_check(D.resolutions(conflicts), conflicts, D.evidence(s, d))


def authority(s, d):
    records = D.claims(s, d).select(F.col("claim_id").alias("record_id"), F.col("subject_id").alias("asserted_by"))
    o = D.table(s, d, "orders")
    ops = o.select(F.concat(F.lit("op_"), "o_orderkey").alias("op_id"), F.concat(F.lit("claim_"), F.col("o_orderkey") + F.col("o_orderkey") % 2).alias("record_id"), F.concat(F.lit("customer:"), "o_custkey").alias("actor_id"), F.when(F.col("o_orderkey") % 4 == 0, "HUMAN").otherwise("SERVICE").alias("actor_type"))
    return C.authority_check(ops, records)


def context(s, d):
    """The context of all keys of a customer and an environment that claims have."""
    keys = D.claims(s, d).where("environment is not null").select("subject_id", F.lit("order.priority@1").alias("predicate"), "environment").distinct()
    out = C.epistemic_context(D.claims(s, d), D.evidence(s, d), _conflicts(s, d), keys)
    return out.select("claim_id", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.array_join("conflict_ids", ",").alias("conflict_ids"))


def references(s, d):
    o = D.table(s, d, "orders")
    refs = o.select(F.concat(F.lit("ref_"), "o_orderkey").alias("ref_id"), F.when(F.col("o_orderkey") % 6 == 0, F.concat(F.lit("claim_x"), "o_orderkey")).otherwise(F.concat(F.lit("claim_"), "o_orderkey")).alias("target"), F.when(F.col("o_orderkey") % 8 == 0, "DECISION_RECORD").otherwise("CLAIM").alias("record_type"))
    return C.reference_check(refs, D.claims(s, d).select(F.col("claim_id").alias("object_id"), F.lit("CLAIM").alias("kind")))


def preservation(s, d):
    before = _conflicts(s, d).withColumn("version", F.lit(1))
    k = F.col("opened_seq")
    after = before.select("conflict_id", F.when(k % 7 == 0, 2).otherwise(1).alias("episode"), "member_digest", F.when(k % 5 == 0, F.slice("members", 1, 1)).otherwise(F.col("members")).alias("members"), F.when(k % 3 == 0, 1).otherwise(2).alias("version"), F.slice("members", 1, 1).alias("selected"), F.expr("slice(members, 2, size(members))").alias("rejected"), F.when(k % 11 == 0, "").otherwise("checked").alias("rationale"), F.lit("human:1").alias("resolved_by"), F.array(F.lit("e")).alias("evidence_ids"), F.lit("2024-01-01T00:00:00Z").alias("resolved_at"))
    out = C.resolution_preservation(before, after)
    return out.select("conflict_id", F.array_join("failures", ",").alias("failures"))


QUERIES = {
    "c01_conformance": conformance,
    "c02_proposition_hash_check": hash_check,
    "c03_family_key": lambda s, d: C.with_family_key(D.claims(s, d), D.registry(s)).select("claim_id", "family_key"),
    "c04_verify_evidence": lambda s, d: C.verify_evidence(D.evidence(s, d), D.sources(s, d)),
    "c05_insufficient_evidence": lambda s, d: C.insufficient_evidence(D.claims(s, d), D.evidence(s, d), D.registry(s)),
    "c06_valid_time_overlap": overlap,
    "c07_conflict_pairs": _pairs,
    "c08_conflict_episodes": lambda s, d: C.conflict_episodes(D.claims(s, d), D.registry(s)).withColumn("members", F.array_join("members", ",")),
    "c09_resolution_check": resolution_check,
    "c10_authority_check": authority,
    "c11_active_set_digest": lambda s, d: C.active_set_digest(D.claims(s, d), D.registry(s)).select("family_key", "members"),
    "c12_epistemic_context": context,
    "c13_reference_check": references,
    "c14_list_conflicts": lambda s, d: C.list_conflicts(_conflicts(s, d), "OPEN").select("conflict_id", "kind", "opened_seq"),
    "c15_resolution_preservation": preservation,
    "flagship_contradictions": flagship,
}

_BASE = f"{D.CLAIMS}, {D.FAMILIES}, {D.PAIRS}, {D.CONFLICTS}"
_CODE = """CASE WHEN k % 23 = 0 THEN 'SOURCE_NOT_FOUND' WHEN k % 17 = 0 OR n_bytes <= 0 THEN 'RANGE_INVALID' WHEN k % 13 = 0 THEN 'EXCERPT_MISMATCH' ELSE 'OK' END"""

ORACLE_SQL = {
    "c01_conformance": f"""WITH {D.CLAIMS}, {D.EVIDENCE} SELECT claim_id, CASE WHEN predicate = 'order.unknown@1' THEN 'UNKNOWN_PREDICATE' WHEN subject_type <> 'customer' THEN 'SUBJECT_TYPE_MISMATCH'
        WHEN object_value = '5-LOW' THEN 'OBJECT_ENUM_VALUE_NOT_ALLOWED' WHEN component IS NOT NULL THEN 'SCOPE_FIELD_NOT_ALLOWED' WHEN environment IS NULL THEN 'REQUIRED_SCOPE_MISSING'
        WHEN valid_from IS NULL THEN 'VALID_TIME_REQUIRED' WHEN valid_from >= valid_to THEN 'INVALID_VALID_TIME_RANGE'
        WHEN claim_id IN (SELECT claim_id FROM evidence WHERE interpretation = 'INFERRED') THEN 'EVIDENCE_INTERPRETATION_NOT_ALLOWED' END AS code FROM claims""",
    "c02_proposition_hash_check": f"WITH {D.CLAIMS} SELECT claim_id FROM claims WHERE seq % 13 = 0",
    "c03_family_key": f"WITH {D.CLAIMS}, {D.FAMILIES} SELECT claim_id, family_key FROM families",
    "c04_verify_evidence": f"WITH {D.EVIDENCE} SELECT evidence_id, {_CODE} AS code FROM evidence",
    "c05_insufficient_evidence": f"WITH {D.CLAIMS}, {D.EVIDENCE} SELECT claim_id, 0::BIGINT AS links, 1 AS min_links FROM claims WHERE predicate = 'order.priority@1' AND claim_id NOT IN (SELECT claim_id FROM evidence)",
    "c06_valid_time_overlap": f"""WITH {D.CLAIMS} SELECT a.claim_id AS claim_a, b.claim_id AS claim_b FROM claims a JOIN claims b ON a.subject_id = b.subject_id AND a.claim_id < b.claim_id
        WHERE greatest(coalesce(a.valid_from, TIMESTAMP '0001-01-01'), coalesce(b.valid_from, TIMESTAMP '0001-01-01')) < least(a.valid_to, b.valid_to)""",
    "c07_conflict_pairs": f"WITH {_BASE} SELECT * FROM pairs",
    "c08_conflict_episodes": f"WITH {_BASE} SELECT conflict_id, family_key, kind, array_to_string(members, ',') AS members, member_digest, opened_seq, status, episode FROM conflicts",
    "c09_resolution_check": f"""WITH {_BASE}, {D.EVIDENCE} SELECT 'resolution_' || substr(conflict_id, 10, 24) AS resolution_id,
        CASE WHEN opened_seq % 5 = 0 THEN 'MEMBER_DIGEST_MISMATCH' WHEN opened_seq % 7 = 0 THEN 'EPISODE_MISMATCH' WHEN opened_seq % 11 = 0 THEN 'RESOLUTION_NOT_A_PARTITION'
             WHEN (opened_seq % 3 = 0 AND NOT list_contains(members, 'claim_1')) OR NOT EXISTS (SELECT 1 FROM evidence e WHERE e.claim_id = CASE WHEN opened_seq % 3 = 0 THEN 'claim_1' ELSE members[1] END) THEN 'EVIDENCE_NOT_OF_MEMBERS' END AS code FROM conflicts""",
    "c10_authority_check": """SELECT 'op_' || a.o_orderkey AS op_id, a.o_orderkey % 4 = 0 OR coalesce(a.o_custkey = b.o_custkey, false) AS allowed FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey + a.o_orderkey % 2""",
    "c11_active_set_digest": f"WITH {D.CLAIMS}, {D.FAMILIES} SELECT family_key, count(*) AS members FROM families WHERE status = 'ACTIVE' GROUP BY family_key",
    "c12_epistemic_context": f"""WITH {_BASE}, {D.EVIDENCE}, t AS (SELECT unnest(members) AS claim_id, conflict_id FROM conflicts)
        SELECT c.claim_id, coalesce((SELECT string_agg(evidence_id, ',' ORDER BY evidence_id) FROM evidence e WHERE e.claim_id = c.claim_id), '') AS evidence_ids, coalesce((SELECT string_agg(conflict_id, ',' ORDER BY conflict_id) FROM t WHERE t.claim_id = c.claim_id), '') AS conflict_ids
        FROM claims c WHERE status = 'ACTIVE' AND predicate = 'order.priority@1' AND environment IS NOT NULL""",
    "c13_reference_check": "SELECT 'ref_' || o_orderkey AS ref_id, CASE WHEN o_orderkey % 6 = 0 THEN 'REFERENCE_NOT_FOUND' ELSE 'REFERENCE_TYPE_MISMATCH' END AS code FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 8 = 0",
    "c14_list_conflicts": f"WITH {_BASE} SELECT conflict_id, kind, opened_seq FROM conflicts",
    "c15_resolution_preservation": f"""WITH {_BASE} SELECT conflict_id, concat_ws(',', CASE WHEN opened_seq % 7 = 0 THEN 'EPISODE_CHANGED' END, CASE WHEN opened_seq % 5 = 0 THEN 'MEMBERS_CHANGED' END,
        CASE WHEN opened_seq % 3 = 0 THEN 'VERSION_NOT_INCREMENTED' END, CASE WHEN opened_seq % 11 = 0 THEN 'RATIONALE_MISSING' END) AS failures FROM conflicts""",
    "flagship_contradictions": f"""WITH {_BASE}, {D.EVIDENCE}, m AS (SELECT conflict_id, kind, opened_seq, unnest(members) AS claim_id FROM conflicts)
        SELECT conflict_id, kind, opened_seq, m.claim_id, count(e.claim_id) AS links, count(*) FILTER (WHERE e.claim_id IS NOT NULL AND {_CODE} = 'OK') AS verified FROM m LEFT JOIN evidence e ON m.claim_id = e.claim_id GROUP BY ALL""",
}
