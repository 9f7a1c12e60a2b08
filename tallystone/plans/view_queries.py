"""Queries V01-V26 and Q01-Q06, on records of all kinds that derive from documents, orders, part, supplier and customer."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tallystone.operators import claims as C
from tallystone.operators import query as Q
from tallystone.operators import views as V
from tallystone.plans import derive as D
from tallystone.plans.derive import table
from tallystone.sources.scratch import written


def conflicts(s, d):
    """The conflicts as a table, so that what reads them neither finds them again nor shares a task's memory with what does."""
    return written(C.conflict_episodes(D.claims(s, d), D.registry(s)), "conflicts")


def decisions(s, d):
    k = F.col("p_partkey")
    status = F.when(k % 4 == 0, "SUPERSEDED").when(k % 9 == 1, "REVERSED").otherwise("ACTIVE")
    return table(s, d, "part").select(F.concat(F.lit("decision_"), k).alias("object_id"), F.lit("DECISION_RECORD").alias("kind"), F.col("p_name").alias("title"), status.alias("status"), F.array(F.concat(F.lit("claim_"), k), F.concat(F.lit("revision_"), k % 1200)).alias("related_ids"), F.when(k % 4 == 0, F.concat(F.lit("decision_"), k + 1)).alias("replaced_by"))


def questions(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(F.concat(F.lit("question_"), k).alias("object_id"), F.lit("OPEN_QUESTION").alias("kind"), F.col("s_name").alias("title"), F.when(k % 3 == 0, "ANSWERED").when(k % 7 == 1, "WEIRD").otherwise("OPEN").alias("status"), F.array(F.concat(F.lit("claim_"), k * 3)).alias("related_ids"))


def work(s, d):
    k = F.col("c_custkey")
    status = F.element_at(F.array(*map(F.lit, ("TODO", "DOING", "BLOCKED", "DONE", "DROPPED"))), (k % 5 + 1).cast("int"))
    return table(s, d, "customer").select(F.concat(F.lit("work_"), k).alias("object_id"), F.lit("WORK_ITEM").alias("kind"), F.col("c_name").alias("title"), status.alias("status"), F.array(F.concat(F.lit("claim_"), k * 2), F.concat(F.lit("claim_"), k * 2 + 1)).alias("related_ids"), F.when(k % 7 < 4, F.concat(F.lit("P"), k % 7)).alias("priority"))


def sources(s, d):
    return D.sources(s, d).select("revision_id", "source_id", F.col("source").alias("title"))


def records(s, d, found=None):
    """Records of all kinds. found: the conflicts, where a query has made them."""
    parts = [
        sources(s, d).select(F.col("revision_id").alias("object_id"), F.lit("SOURCE_REVISION").alias("kind"), "title", F.lit(None).cast("string").alias("summary"), F.lit("IMMUTABLE").alias("status"), F.array().cast("array<string>").alias("related_ids"), F.lit(None).cast("string").alias("priority")),
        D.claims(s, d).select(F.col("claim_id").alias("object_id"), F.lit("CLAIM").alias("kind"), F.col("object_value").alias("title"), "status"),
        (conflicts(s, d) if found is None else found).select(F.col("conflict_id").alias("object_id"), F.lit("CONFLICT").alias("kind"), F.col("kind").alias("title"), "status", F.col("members").alias("related_ids")),
        decisions(s, d).drop("replaced_by"), questions(s, d), work(s, d),
    ]
    return V.atomic_records(parts)


_BASE = f"{D.CLAIMS}, {D.FAMILIES}, {D.PAIRS}, {D.CONFLICTS}"
RECORDS = f"""{_BASE},
decisions AS (SELECT 'decision_' || p_partkey AS object_id, p_name AS title, CASE WHEN p_partkey % 4 = 0 THEN 'SUPERSEDED' WHEN p_partkey % 9 = 1 THEN 'REVERSED' ELSE 'ACTIVE' END AS status, ['claim_' || p_partkey, 'revision_' || (p_partkey % 1200)] AS related, CASE WHEN p_partkey % 4 = 0 THEN 'decision_' || (p_partkey + 1) END AS replaced_by FROM part),
questions AS (SELECT 'question_' || s_suppkey AS object_id, s_name AS title, CASE WHEN s_suppkey % 3 = 0 THEN 'ANSWERED' WHEN s_suppkey % 7 = 1 THEN 'WEIRD' ELSE 'OPEN' END AS status, ['claim_' || (s_suppkey * 3)] AS related FROM supplier),
work AS (SELECT 'work_' || c_custkey AS object_id, c_name AS title, ['TODO', 'DOING', 'BLOCKED', 'DONE', 'DROPPED'][c_custkey % 5 + 1] AS status, ['claim_' || (c_custkey * 2), 'claim_' || (c_custkey * 2 + 1)] AS related, CASE WHEN c_custkey % 7 < 4 THEN 'P' || (c_custkey % 7) END AS priority FROM customer),
records AS (SELECT 'revision_' || doc_id AS object_id, 'SOURCE_REVISION' AS kind, source AS title, 'IMMUTABLE' AS status, []::VARCHAR[] AS related, NULL::VARCHAR AS priority FROM documents
  UNION ALL SELECT claim_id, 'CLAIM', object_value, status, []::VARCHAR[], NULL FROM claims UNION ALL SELECT conflict_id, 'CONFLICT', kind, status, members, NULL FROM conflicts
  UNION ALL SELECT object_id, 'DECISION_RECORD', title, status, list_sort(related), NULL FROM decisions UNION ALL SELECT object_id, 'OPEN_QUESTION', title, status, related, NULL FROM questions UNION ALL SELECT object_id, 'WORK_ITEM', title, status, list_sort(related), priority FROM work),
members AS (SELECT conflict_id, unnest(members) AS claim_id FROM conflicts)"""


def subject_members(s, d):
    return V.scenario_subject(D.claims(s, d), conflicts(s, d))


def project_kinds(s, d):
    r = records(s, d)
    return V.scenario_project(r).join(r.select("object_id", "kind", "hash"), "object_id")


def view_digests(s, d, keep):
    """Digests of the subjects' views, over claims with or without every fiftieth one."""
    m = D.claims(s, d).where(keep).select(F.col("subject_id").alias("scope"), F.col("claim_id").alias("object_id"), F.concat_ws("|", "object_value", "status").alias("hash"))
    return V.dependency_digest(m)


def incremental(s, d):
    old = view_digests(s, d, "seq % 50 <> 0").where("scope <> 'customer:7'").select(F.col("scope").alias("artifact_id"), "dependency_digest", F.lit(3).alias("version"))
    new = view_digests(s, d, "true").where("scope <> 'customer:11'").select(F.col("scope").alias("artifact_id"), "dependency_digest")
    return V.incremental_views(new, old)


def verify(s, d):
    r = records(s, d).where("kind = 'WORK_ITEM'").select(F.col("object_id").alias("artifact_id"), "hash", F.substring("object_id", 6, 20).cast("int").alias("n"))
    actual = r.where("n % 9 <> 0").select("artifact_id", F.when(F.col("n") % 7 == 0, "x").otherwise(F.col("hash")).alias("hash")).unionByName(r.where("n % 50 = 0").select(F.concat("artifact_id", F.lit("_b")).alias("artifact_id"), "hash"))
    return V.verify_views(r.select("artifact_id", "hash"), actual)


def skills(s, d):
    """Skill operations by events: signup creates, click revises, view tests, purchase approves, error deprecates; a version per ten events."""
    e = table(s, d, "events")
    op = F.create_map(*map(F.lit, ("signup", "CREATE", "click", "REVISE", "view", "TEST", "purchase", "APPROVE", "error", "DEPRECATE")))[F.col("event_type")]
    return e.select(F.concat(F.lit("skill:"), "user_id").alias("skill_id"), F.col("event_id").alias("seq"), op.alias("op"), F.floor(F.col("event_id") / 2000).cast("int").alias("version"), F.md5(F.concat("event_type", (F.col("event_id") % 3).cast("string"))).alias("content_hash"))


SKILLS = "ops AS (SELECT 'skill:' || user_id AS skill_id, event_id AS seq, event_type AS t, (event_id // 2000)::INTEGER AS version, md5(event_type || (event_id % 3)) AS content_hash FROM events)"
_OWN = "own AS (SELECT skill_id, version, arg_max(CASE t WHEN 'view' THEN 'TESTED' WHEN 'purchase' THEN 'APPROVED' WHEN 'error' THEN 'DEPRECATED' ELSE 'DRAFT' END, seq) AS st FROM ops GROUP BY ALL), best AS (SELECT skill_id, arg_max(version, seq) AS approved FROM ops WHERE t = 'purchase' GROUP BY 1), folded AS (SELECT skill_id, version, CASE WHEN st = 'APPROVED' AND version <> approved THEN 'DEPRECATED' ELSE st END AS status FROM own LEFT JOIN best USING (skill_id))"


def listing(s, d):
    sk = V.fold_skills(skills(s, d)).select(F.lit("SKILL").alias("kind"), F.concat_ws("@", "skill_id", "version").alias("object_id"), F.lit(None).cast("string").alias("title"), "status")
    return [records(s, d), sk]


def links(s, d):
    found = conflicts(s, d)
    r = records(s, d, found).withColumn("revision_ids", F.filter("related_ids", lambda x: x.startswith("revision_")))
    views = found.select(F.concat(F.lit("view_"), "conflict_id").alias("artifact_id"), "members")
    sk = table(s, d, "part").select(F.concat(F.lit("skill:"), F.col("p_partkey") % 20).alias("skill_id"), F.array("p_brand", "p_type").alias("resources"))
    return V.link_graph(r, views, sk)


LINKS = f"""{RECORDS}, links AS (SELECT DISTINCT * FROM (SELECT object_id AS source_id, unnest(related) AS target_id, 'RELATED_TO' AS relation FROM records
  UNION ALL SELECT object_id, unnest(list_filter(related, lambda x: starts_with(x, 'revision_'))), 'DERIVED_FROM' FROM records UNION ALL SELECT 'view_' || conflict_id, unnest(members), 'CONTAINS' FROM conflicts
  UNION ALL SELECT 'skill:' || (p_partkey % 20), unnest([p_brand, p_type]), 'USES_RESOURCE' FROM part))"""


def drill(s, d):
    r = records(s, d)
    ids = r.where("kind = 'DECISION_RECORD'").select("object_id")
    history = table(s, d, "events").select(F.concat(F.lit("decision_"), "user_id").alias("object_id"), F.col("event_id").alias("seq"))
    out = V.drill_down(ids, r, history)
    return out.select("object_id", F.array_join("found", ",").alias("found"), F.array_join("missing", ",").alias("missing"), F.size("sequences").alias("entries"))


def enriched(s, d):
    out = V.enrich_claims(D.claims(s, d), D.evidence(s, d), conflicts(s, d))
    return out.select("claim_id", *[F.array_join(x, ",").alias(x) for x in ("evidence_ids", "revision_ids", "conflict_ids")])


def candidates(s, d):
    found = conflicts(s, d)
    continuity = records(s, d, found).where("kind in ('DECISION_RECORD', 'OPEN_QUESTION', 'WORK_ITEM')")
    return Q.query_candidates(sources(s, d), D.claims(s, d), D.evidence(s, d), found, continuity)


def core(s, d):
    found = conflicts(s, d)
    return V.core_context(records(s, d, found), found)


def joined(df):
    return df.select("kind", "object_id", "title", "status", *[F.array_join(x, ",").alias(x) for x in ("predicates", "source_ids", "revision_ids")])


CANDIDATES = f"""{RECORDS}, {D.EVIDENCE}, link AS (SELECT evidence_id, claim_id, revision_id, 'document:' || substr(revision_id, 10) AS source_id FROM evidence),
cl AS (SELECT claim_id AS target, any_value(predicate) AS p, list(DISTINCT CASE WHEN revision_id <> 'revision_none' THEN source_id END) AS s, list(DISTINCT revision_id) AS r FROM claims LEFT JOIN link USING (claim_id) GROUP BY 1),
facets AS (SELECT target, [p] AS p, list_filter(s, lambda x: x IS NOT NULL) AS s, list_filter(r, lambda x: x IS NOT NULL) AS r FROM cl UNION ALL SELECT 'revision_' || doc_id, []::VARCHAR[], ['document:' || doc_id], ['revision_' || doc_id] FROM documents),
refs AS (SELECT object_id, unnest(related) AS target FROM records WHERE kind IN ('CONFLICT', 'DECISION_RECORD', 'OPEN_QUESTION', 'WORK_ITEM')),
met AS (SELECT object_id, flatten(list(p)) AS p, flatten(list(s)) AS s, flatten(list(r)) AS r FROM refs JOIN facets USING (target) GROUP BY 1),
candidates AS (SELECT 'SOURCE_REVISION' AS kind, 'revision_' || doc_id AS object_id, source AS title, 'IMMUTABLE' AS status, []::VARCHAR[] AS p, ['document:' || doc_id] AS s, ['revision_' || doc_id] AS r FROM documents
  UNION ALL SELECT 'CLAIM', target, NULL, status, p, s, r FROM facets JOIN claims ON target = claim_id
  UNION ALL SELECT 'EVIDENCE_LINK', evidence_id, NULL, 'IMMUTABLE', [predicate], CASE WHEN revision_id = 'revision_none' THEN [] ELSE [source_id] END, [revision_id] FROM link JOIN claims USING (claim_id)
  UNION ALL SELECT kind, object_id, CASE WHEN kind <> 'CONFLICT' THEN title END, status, coalesce(p, []), coalesce(s, []), coalesce(r, []) FROM records LEFT JOIN met USING (object_id) WHERE kind IN ('CONFLICT', 'DECISION_RECORD', 'OPEN_QUESTION', 'WORK_ITEM')),
flat AS (SELECT kind, object_id, title, status, array_to_string(list_sort(list_distinct(p)), ',') AS predicates, array_to_string(list_sort(list_distinct(s)), ',') AS source_ids, array_to_string(list_sort(list_distinct(r)), ',') AS revision_ids FROM candidates)"""

#: The same with each part made once: a reader that asks for a few rows only must not plan it otherwise.
CANDIDATES_ONCE = re.sub(r"\b(claims|families|pairs|since|conflicts|evidence|records|link|cl|facets|refs|met|candidates) AS \(", r"\1 AS MATERIALIZED (", CANDIDATES)

SPEC = {"kinds": ["CLAIM", "DECISION_RECORD", "WORK_ITEM"], "statuses": ["ACTIVE", "TODO"], "source_ids": [f"document:{i}" for i in range(0, 60)]}
_SPEC = "kind IN ('CLAIM', 'DECISION_RECORD', 'WORK_ITEM') AND status IN ('ACTIVE', 'TODO') AND list_has_any(string_split(source_ids, ','), list_transform(range(60), lambda i: 'document:' || i))"
_ORDER = "CASE kind WHEN 'CLAIM' THEN 2 WHEN 'DECISION_RECORD' THEN 5 ELSE 7 END"


def drafts(s, d):
    return table(s, d, "events").select(F.concat(F.lit("draft_"), "event_id").alias("draft_id"), F.upper("event_type").alias("status"), F.when(F.col("event_id") % 4 == 0, "SKILL").otherwise("OPERATIONS").alias("draft_kind"), F.concat(F.lit("b"), F.col("user_id") % 5).alias("batch_key"))


QUERIES = {
    "v01_atomic_records": lambda s, d: records(s, d).select("object_id", "kind", "title", "status", "priority", F.array_join("related_ids", ",").alias("related_ids"), "hash"),
    "v02_enrich_claims": enriched,
    "v03_broken_conflict_members": lambda s, d: V.broken_conflict_members(conflicts(s, d), D.claims(s, d).where("seq % 6 <> 0")),
    "v04_scenario_project": lambda s, d: V.scenario_project(records(s, d)),
    "v05_scenario_subject": subject_members,
    "v06_scenario_decision": lambda s, d: V.scenario_decision(decisions(s, d)),
    "v07_scenario_incident": lambda s, d: V.scenario_incident(conflicts(s, d), D.evidence(s, d)),
    "v08_scenario_work": lambda s, d: V.scenario_work(work(s, d), conflicts(s, d)),
    "v09_kind_summary": lambda s, d: V.kind_summary(project_kinds(s, d)),
    "v10_dependency_digest": lambda s, d: view_digests(s, d, "true"),
    "v11_incremental_views": incremental,
    "v12_verify_views": verify,
    "v13_core_context": core,
    "v14_unknown_status": lambda s, d: V.unknown_status(records(s, d)),
    "v15_catalog": lambda s, d: V.catalog(listing(s, d)),
    "v16_review_queue": lambda s, d: V.review_queue(V.catalog(listing(s, d))),
    "v17_lifecycle": lambda s, d: V.lifecycle(records(s, d)),
    "v18_next_actions": lambda s, d: V.next_actions(records(s, d), 40),
    "v19_link_graph": links,
    "v20_neighbours": lambda s, d: V.neighbours(links(s, d), questions(s, d).select(F.get("related_ids", F.lit(0)).alias("object_id"))),
    "v21_drill_down": drill,
    "v22_source_map": lambda s, d: V.source_map(records(s, d)),
    "v23_current_skills": lambda s, d: V.current_skills(V.fold_skills(skills(s, d)), True),
    "v24_fold_skills": lambda s, d: V.fold_skills(skills(s, d)),
    "v25_skill_version_reuse": lambda s, d: V.skill_version_reuse(skills(s, d)),
    "v26_telemetry": lambda s, d: V.telemetry(table(s, d, "events").unionByName(table(s, d, "events").where("event_id % 5 = 0").withColumn("ts", F.col("ts") + F.expr("interval 1 hour"))), "error").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at")),
    "q01_query_candidates": lambda s, d: joined(candidates(s, d)),
    "q02_query": lambda s, d: joined(Q.query(candidates(s, d), SPEC)),
    "q03_page": lambda s, d: Q.page(Q.query(candidates(s, d), SPEC), 50, 20).select("kind", "object_id", "total", "truncated"),
    "q04_matched_fields": lambda s, d: Q.matched_fields(Q.query(candidates(s, d), SPEC), SPEC).select("object_id", F.array_join("matched_fields", ",").alias("matched_fields")),
    "q05_list_drafts": lambda s, d: Q.list_drafts(drafts(s, d), "ERROR", "SKILL", "b3"),
    "q06_list_work_items": lambda s, d: Q.list_work_items(records(s, d), "BLOCKED").select("object_id", "title", "status"),
}

_R = f"WITH {RECORDS}"
_CLOSED = "('SUPERSEDED', 'REVERSED', 'ANSWERED', 'DROPPED', 'DONE', 'DEPRECATED')"


def _digests(name, where):
    return f"""{name}_r AS (SELECT subject_id AS scope, sha256(claim_id || '|' || object_value || '|' || status) AS h FROM claims WHERE {where}), {name}_4 AS (SELECT scope, substr(sha256(h), 1, 4) AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM {name}_r GROUP BY ALL),
    {name}_2 AS (SELECT scope, substr(b, 1, 2) AS b, sum(n) AS n, sha256(string_agg(h, '' ORDER BY b)) AS h FROM {name}_4 GROUP BY scope, substr(b, 1, 2)), {name} AS (SELECT scope, sum(n)::BIGINT AS members, 'sha256:' || sha256(string_agg(h, '' ORDER BY b)) AS dependency_digest FROM {name}_2 GROUP BY scope)"""


ORACLE_SQL = {
    "v01_atomic_records": f"{_R} SELECT object_id, kind, title, status, priority, array_to_string(related, ',') AS related_ids, 'sha256:' || sha256(concat_ws('|', object_id, kind, title, status, array_to_string(related, ','), priority)) AS hash FROM records",
    "v02_enrich_claims": f"""{_R}, {D.EVIDENCE} SELECT claim_id, coalesce((SELECT string_agg(evidence_id, ',' ORDER BY evidence_id) FROM evidence e WHERE e.claim_id = c.claim_id), '') AS evidence_ids, coalesce((SELECT string_agg(DISTINCT revision_id, ',' ORDER BY revision_id) FROM evidence e WHERE e.claim_id = c.claim_id), '') AS revision_ids,
        coalesce((SELECT string_agg(conflict_id, ',' ORDER BY conflict_id) FROM members m WHERE m.claim_id = c.claim_id), '') AS conflict_ids FROM claims c""",
    "v03_broken_conflict_members": f"{_R} SELECT conflict_id, m.claim_id FROM members m JOIN claims USING (claim_id) WHERE seq % 6 = 0",
    "v04_scenario_project": f"{_R} SELECT 'project' AS scope, object_id, kind = 'CONFLICT' AS open_conflict FROM records WHERE kind <> 'SOURCE_REVISION' AND status NOT IN {_CLOSED}",
    "v05_scenario_subject": f"{_R} SELECT subject_id AS scope, claim_id AS object_id, false AS open_conflict FROM claims UNION ALL SELECT DISTINCT subject_id, conflict_id, true FROM claims JOIN members USING (claim_id)",
    "v06_scenario_decision": f"""{_R} SELECT object_id AS scope, object_id, 'SELF' AS relation FROM decisions UNION ALL SELECT object_id, unnest(related), 'REFERENCES' FROM decisions UNION ALL SELECT object_id, replaced_by, 'REPLACED_BY' FROM decisions WHERE replaced_by IS NOT NULL
        UNION ALL SELECT a.replaced_by, a.object_id, 'REPLACES' FROM decisions a JOIN decisions b ON a.replaced_by = b.object_id""",
    "v07_scenario_incident": f"{_R}, {D.EVIDENCE} SELECT conflict_id AS scope, conflict_id AS object_id, 'CONFLICT' AS role FROM conflicts UNION ALL SELECT conflict_id, claim_id, 'CLAIM' FROM members UNION ALL SELECT DISTINCT conflict_id, revision_id, 'SOURCE' FROM members JOIN evidence USING (claim_id)",
    "v08_scenario_work": f"""{_R}, w AS (SELECT object_id, unnest(related) AS ref FROM work WHERE status IN ('TODO', 'DOING', 'BLOCKED')) SELECT object_id AS scope, object_id, 'WORK_ITEM' AS role FROM work WHERE status IN ('TODO', 'DOING', 'BLOCKED') UNION ALL SELECT object_id, ref, 'REFERENCE' FROM w
        UNION ALL SELECT DISTINCT object_id, conflict_id, 'OPEN_CONFLICT' FROM w JOIN members ON ref = claim_id""",
    "v09_kind_summary": f"{_R}, n AS (SELECT kind, count(*) AS n FROM records WHERE kind <> 'SOURCE_REVISION' AND status NOT IN {_CLOSED} GROUP BY kind) SELECT 'project' AS scope, string_agg(kind || '=' || n, ', ' ORDER BY kind) AS summary FROM n",
    "v10_dependency_digest": f"WITH {D.CLAIMS}, {_digests('x', 'true')} SELECT * FROM x",
    "v11_incremental_views": f"""WITH {D.CLAIMS}, {_digests('n', "subject_id <> 'customer:11'")}, {_digests('o', "seq % 50 <> 0 AND subject_id <> 'customer:7'")}
        SELECT coalesce(n.scope, o.scope) AS artifact_id, CASE WHEN o.scope IS NULL THEN 1 WHEN n.dependency_digest <> o.dependency_digest THEN 4 ELSE 3 END::BIGINT AS version, CASE WHEN n.scope IS NULL THEN 'STALE' ELSE 'READY' END AS status,
        CASE WHEN n.scope IS NULL THEN 'STALE' WHEN o.scope IS NULL THEN 'NEW' WHEN n.dependency_digest = o.dependency_digest THEN 'UNCHANGED' ELSE 'REBUILT' END AS change FROM n FULL JOIN o ON n.scope = o.scope""",
    "v12_verify_views": "SELECT 'work_' || c_custkey AS artifact_id, CASE WHEN c_custkey % 9 = 0 THEN 'MISSING' ELSE 'MISMATCHED' END AS problem FROM customer WHERE c_custkey % 9 = 0 OR c_custkey % 7 = 0 UNION ALL SELECT 'work_' || c_custkey || '_b', 'UNEXPECTED' FROM customer WHERE c_custkey % 50 = 0",
    "v13_core_context": f"""{_R} SELECT CASE kind WHEN 'CONFLICT' THEN 'open_conflicts' WHEN 'DECISION_RECORD' THEN 'decisions' WHEN 'OPEN_QUESTION' THEN 'questions' ELSE 'work_items' END AS section, object_id, true AS mandatory FROM records
        WHERE kind = 'CONFLICT' OR (kind = 'DECISION_RECORD' AND status = 'ACTIVE') OR (kind = 'OPEN_QUESTION' AND status = 'OPEN') OR (kind = 'WORK_ITEM' AND status IN ('TODO', 'DOING', 'BLOCKED'))
        UNION ALL SELECT 'claims', claim_id, false FROM claims WHERE status = 'ACTIVE' AND claim_id NOT IN (SELECT claim_id FROM members)""",
    "v14_unknown_status": f"{_R} SELECT object_id, kind, status FROM records WHERE status = 'WEIRD'",
    "v15_catalog": f"{_R}, {SKILLS}, {_OWN} SELECT kind, object_id, title, status FROM records UNION ALL SELECT 'SKILL', skill_id || '@' || version, NULL, status FROM folded",
    "v16_review_queue": f"{_R}, {SKILLS}, {_OWN} SELECT 'conflicts' AS queue, object_id FROM records WHERE kind = 'CONFLICT' UNION ALL SELECT CASE status WHEN 'DRAFT' THEN 'skills_to_test' ELSE 'skills_to_approve' END, skill_id || '@' || version FROM folded WHERE status IN ('DRAFT', 'TESTED')",
    "v17_lifecycle": f"""{_R}, x AS (SELECT object_id, status, CASE WHEN status IN ('ACTIVE', 'OPEN', 'TODO', 'DOING', 'BLOCKED', 'IMMUTABLE') THEN 'CURRENT' WHEN status IN ('SUPERSEDED', 'REVERSED') THEN 'SUPERSEDED' WHEN status IN ('DONE', 'ANSWERED', 'DROPPED') THEN 'COMPLETED' ELSE 'UNSUPPORTED' END AS lifecycle FROM records) SELECT *, lifecycle = 'CURRENT' AS current FROM x""",
    "v18_next_actions": f"""{_R}, x AS (SELECT *, CASE WHEN kind = 'CONFLICT' THEN -2 WHEN kind = 'WORK_ITEM' AND status IN ('TODO', 'DOING', 'BLOCKED') THEN coalesce(substr(priority, 2)::INTEGER, 3) WHEN kind = 'OPEN_QUESTION' AND status = 'OPEN' THEN 4 END AS o FROM records)
        SELECT row_number() OVER (ORDER BY o, object_id)::INTEGER AS rank, kind, object_id, CASE kind WHEN 'CONFLICT' THEN 'Review unresolved conflict: ' || title WHEN 'OPEN_QUESTION' THEN 'Resolve open question: ' || title ELSE title END AS action FROM x WHERE o IS NOT NULL QUALIFY row_number() OVER (ORDER BY o, object_id) <= 40""",
    "v19_link_graph": f"WITH {LINKS} SELECT * FROM links",
    "v20_neighbours": f"WITH {LINKS}, i AS (SELECT 'claim_' || (s_suppkey * 3) AS id FROM supplier) SELECT DISTINCT links.* FROM links WHERE source_id IN (SELECT id FROM i) OR target_id IN (SELECT id FROM i)",
    "v21_drill_down": f"""{_R}, rel AS (SELECT d.object_id, t, r.object_id IS NOT NULL AS there FROM (SELECT object_id, unnest(related) AS t FROM decisions) d LEFT JOIN records r ON r.object_id = t)
        SELECT object_id, coalesce(string_agg(t, ',' ORDER BY t) FILTER (WHERE there), '') AS found, coalesce(string_agg(t, ',' ORDER BY t) FILTER (WHERE NOT there), '') AS missing, (SELECT count(*) FROM events WHERE 'decision_' || user_id = rel.object_id)::INTEGER AS entries FROM rel GROUP BY object_id""",
    "v22_source_map": "SELECT 'revision_' || doc_id AS object_id, source AS title FROM documents",
    "v23_current_skills": f"WITH {SKILLS}, {_OWN} SELECT * FROM folded WHERE status = 'APPROVED' QUALIFY row_number() OVER (PARTITION BY skill_id ORDER BY version DESC) = 1",
    "v24_fold_skills": f"WITH {SKILLS}, {_OWN} SELECT * FROM folded",
    "v25_skill_version_reuse": f"WITH {SKILLS} SELECT skill_id, version, count(DISTINCT content_hash) AS contents FROM ops GROUP BY ALL HAVING count(DISTINCT content_hash) > 1",
    "v26_telemetry": "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_type = 'error'",
    "q01_query_candidates": f"WITH {CANDIDATES_ONCE} SELECT * FROM flat",
    "q02_query": f"WITH {CANDIDATES} SELECT * FROM flat WHERE {_SPEC}",
    "q03_page": f"WITH {CANDIDATES}, h AS (SELECT * FROM flat WHERE {_SPEC}) SELECT kind, object_id, (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM h) > 70 AS truncated FROM h ORDER BY {_ORDER}, object_id LIMIT 50 OFFSET 20",
    "q04_matched_fields": f"WITH {CANDIDATES} SELECT object_id, 'kinds,source_ids,statuses' AS matched_fields FROM flat WHERE {_SPEC}",
    "q05_list_drafts": "SELECT 'draft_' || event_id AS draft_id, 'ERROR' AS status, 'SKILL' AS draft_kind, 'b3' AS batch_key FROM events WHERE event_type = 'error' AND event_id % 4 = 0 AND user_id % 5 = 3",
    "q06_list_work_items": "SELECT 'work_' || c_custkey AS object_id, c_name AS title, 'BLOCKED' AS status FROM customer WHERE c_custkey % 5 = 2",
}
