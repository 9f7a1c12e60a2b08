"""Views and catalogs over current state.

A record row: object_id, kind, title, summary, status, related_ids array, subject_id, priority, hash. Members and ids are joined as rows;
arrays are built at the end, of one view's members at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.canon import digest, short_id
from tallystone.functions.trees import tree_digest
from tallystone.sources.scratch import task_parts

# Lifecycles of statuses, closed statuses, kinds' and priorities' order.
LIFECYCLES = {
    "CURRENT": ["ACTIVE", "OPEN", "REOPENED", "TODO", "DOING", "BLOCKED", "ASSERTED", "READY", "IMMUTABLE", "TESTED", "APPROVED", "DRAFT"],
    "STALE": ["STALE", "EXPIRED"],
    "SUPERSEDED": ["SUPERSEDED", "REVERSED", "RETRACTED", "DEPRECATED"],
    "COMPLETED": ["DONE", "ANSWERED", "RESOLVED", "DROPPED", "COMMITTED", "REJECTED"],
}
CLOSED = ["SUPERSEDED", "REVERSED", "ANSWERED", "DROPPED", "DONE", "DEPRECATED"]
UNFINISHED = ["TODO", "DOING", "BLOCKED"]
KNOWN = {"DECISION_RECORD": ["ACTIVE", "SUPERSEDED", "REVERSED"], "OPEN_QUESTION": ["OPEN", "ANSWERED", "DROPPED"], "WORK_ITEM": ["TODO", "DOING", "BLOCKED", "DONE", "DROPPED"]}
RECORD = ["object_id", "kind", "title", "summary", "status", "related_ids", "subject_id", "priority"]
NO_IDS = "array<string>"


def none() -> Column:
    return F.array().cast(NO_IDS)


def atomic_records(parts: list[DataFrame]) -> DataFrame:
    """One table of all kinds of records; columns a kind lacks are null, related ids sorted and distinct, with a hash of the rest."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = whole.withColumn("related_ids", F.array_sort(F.array_distinct(F.coalesce("related_ids", none()))))
    return rows.withColumn("hash", digest(F.concat_ws("|", "object_id", "kind", "title", "summary", "status", F.array_join("related_ids", ","), "priority")))


def enrich_claims(claims: DataFrame, evidence: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Claims with sorted evidence_ids, revision_ids and open conflict_ids; the arrays are built before they are joined."""
    n = task_parts(claims, evidence)
    e = evidence.repartition(n, "claim_id").groupBy("claim_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"), F.array_sort(F.collect_set("revision_id")).alias("revision_ids"))
    c = conflicts.where("status = 'OPEN'").select("conflict_id", F.explode("members").alias("claim_id")).repartition(n, "claim_id").groupBy("claim_id").agg(F.array_sort(F.collect_set("conflict_id")).alias("conflict_ids"))
    j = claims.repartition(n, "claim_id").join(e, "claim_id", "left").join(c, "claim_id", "left")
    return j.withColumns({x: F.coalesce(x, none()) for x in ("evidence_ids", "revision_ids", "conflict_ids")})


def broken_conflict_members(conflicts: DataFrame, claims: DataFrame) -> DataFrame:
    """(conflict_id, claim_id) of members of open conflicts that aren't claims."""
    return conflicts.where("status = 'OPEN'").select("conflict_id", F.explode("members").alias("claim_id")).join(claims.select("claim_id"), "claim_id", "left_anti").select("conflict_id", "claim_id")


def scenario_project(records: DataFrame) -> DataFrame:
    """(scope, object_id, open_conflict): the members of the project's view, as rows since they grow with the state."""
    live = records.where((F.col("kind") != "SOURCE_REVISION") & ~F.col("status").isin(CLOSED))
    return live.select(F.lit("project").alias("scope"), "object_id", ((F.col("kind") == "CONFLICT") & (F.col("status") == "OPEN")).alias("open_conflict"))


def scenario_subject(claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(scope, object_id, open_conflict): each subject's claims and the open conflicts that they are members of."""
    own = claims.where("subject_id is not null").select(F.col("subject_id").alias("scope"), F.col("claim_id").alias("object_id"))
    member = conflicts.where("status = 'OPEN'").select("conflict_id", F.explode("members").alias("object_id"))
    n = task_parts(own, member)
    touched = own.repartition(n, "object_id").join(member.repartition(n, "object_id"), "object_id").select("scope", F.col("conflict_id").alias("object_id")).distinct()
    return own.withColumn("open_conflict", F.lit(False)).unionByName(touched.withColumn("open_conflict", F.lit(True)))


def scenario_decision(decisions: DataFrame) -> DataFrame:
    """(scope, object_id, relation): each decision itself, what it references, its replacement and what it replaced."""
    own = decisions.select(F.col("object_id").alias("scope"), "object_id", F.lit("SELF").alias("relation"))
    refs = decisions.select(F.col("object_id").alias("scope"), F.explode("related_ids").alias("object_id"), F.lit("REFERENCES").alias("relation"))
    swap = decisions.where("replaced_by is not null")
    after = swap.select(F.col("object_id").alias("scope"), F.col("replaced_by").alias("object_id"), F.lit("REPLACED_BY").alias("relation"))
    before = swap.select(F.col("replaced_by").alias("scope"), "object_id", F.lit("REPLACES").alias("relation")).join(decisions.select(F.col("object_id").alias("scope")), "scope", "left_semi")
    return own.unionByName(refs).unionByName(after).unionByName(before.select("scope", "object_id", "relation")).distinct()


def scenario_incident(conflicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(scope, object_id, role): each open conflict, its member claims and their sources."""
    live = conflicts.where("status = 'OPEN'")
    own = live.select(F.col("conflict_id").alias("scope"), F.col("conflict_id").alias("object_id"), F.lit("CONFLICT").alias("role"))
    member = live.select(F.col("conflict_id").alias("scope"), F.explode("members").alias("object_id"), F.lit("CLAIM").alias("role"))
    cited = evidence.select(F.col("claim_id").alias("object_id"), "revision_id")
    n = task_parts(member, cited)
    sources = member.repartition(n, "object_id").join(cited.repartition(n, "object_id"), "object_id").select("scope", F.col("revision_id").alias("object_id"), F.lit("SOURCE").alias("role"))
    return own.unionByName(member).unionByName(sources).distinct()


def scenario_work(work: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(scope, object_id, role): each unfinished work item, its references, and the open conflicts among these or with them as members."""
    live = work.where(F.col("status").isin(UNFINISHED))
    own = live.select(F.col("object_id").alias("scope"), "object_id", F.lit("WORK_ITEM").alias("role"))
    refs = live.select(F.col("object_id").alias("scope"), F.explode("related_ids").alias("object_id"), F.lit("REFERENCE").alias("role"))
    member = conflicts.where("status = 'OPEN'").select("conflict_id", F.explode(F.array_append("members", F.col("conflict_id"))).alias("object_id"))
    touched = refs.join(member, "object_id").select("scope", F.col("conflict_id").alias("object_id"), F.lit("OPEN_CONFLICT").alias("role"))
    return own.unionByName(refs).unionByName(touched).distinct()


def kind_summary(members: DataFrame) -> DataFrame:
    """(scope, summary) with text like `CLAIM=3, CONFLICT=1`, kinds in order."""
    n = members.groupBy("scope", "kind").agg(F.count("*").alias("n"))
    return n.groupBy("scope").agg(F.array_join(F.array_sort(F.collect_list(F.concat("kind", F.lit("="), "n"))), ", ").alias("summary"))


def dependency_digest(members: DataFrame) -> DataFrame:
    """(scope, members, dependency_digest) over the hashes of a view's own members, so other changes leave it alone.

    members: scope, object_id, hash. By levels, so a view with very many members is no single list.
    """
    row = members.select("scope", F.sha2(F.concat_ws("|", "object_id", "hash"), 256).alias("h")).distinct()
    return tree_digest(row, ["scope"], "h", "h").select("scope", F.col("rows").alias("members"), F.col("digest").alias("dependency_digest"))


def incremental_views(new: DataFrame, old: DataFrame) -> DataFrame:
    """(artifact_id, version, status, change): UNCHANGED, REBUILT (version + 1), NEW, or STALE for views that are gone. Inputs: artifact_id, dependency_digest; old also version."""
    j = new.withColumnRenamed("dependency_digest", "n").join(old.select("artifact_id", F.col("dependency_digest").alias("o"), "version"), "artifact_id", "full_outer")
    change = F.when(F.col("n").isNull(), "STALE").when(F.col("o").isNull(), "NEW").when(F.col("n") == F.col("o"), "UNCHANGED").otherwise("REBUILT")
    version = F.when(change == "NEW", 1).when(change == "REBUILT", F.col("version") + 1).otherwise(F.col("version"))
    return j.select("artifact_id", version.cast("long").alias("version"), F.when(change == "STALE", "STALE").otherwise("READY").alias("status"), change.alias("change"))


def verify_views(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(artifact_id, problem): MISSING, UNEXPECTED or MISMATCHED. Inputs: artifact_id, hash."""
    j = expected.select("artifact_id", F.col("hash").alias("e")).join(actual.select("artifact_id", F.col("hash").alias("a")), "artifact_id", "full_outer").where(~F.col("e").eqNullSafe(F.col("a")))
    return j.select("artifact_id", F.when(F.col("a").isNull(), "MISSING").when(F.col("e").isNull(), "UNEXPECTED").otherwise("MISMATCHED").alias("problem"))


def core_context(records: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(section, object_id, mandatory): open conflicts, active decisions, open questions, unfinished work; then active claims in no open conflict."""
    held = conflicts.where("status = 'OPEN'").select(F.explode("members").alias("object_id")).distinct()
    k, s = F.col("kind"), F.col("status")
    section = F.when((k == "CONFLICT") & (s == "OPEN"), "open_conflicts").when((k == "DECISION_RECORD") & (s == "ACTIVE"), "decisions").when((k == "OPEN_QUESTION") & (s == "OPEN"), "questions").when((k == "WORK_ITEM") & s.isin(UNFINISHED), "work_items")
    must = records.select(section.alias("section"), "object_id", F.lit(True).alias("mandatory")).where("section is not null")
    free = records.where("kind = 'CLAIM' and status = 'ACTIVE'").join(held, "object_id", "left_anti").select(F.lit("claims").alias("section"), "object_id", F.lit(False).alias("mandatory"))
    return must.unionByName(free)


def unknown_status(records: DataFrame, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(object_id, kind, status) of records of a listed kind with a status outside its set; null counts as unknown."""
    known = known or KNOWN
    bad = reduce(lambda a, b: a | b, [(F.col("kind") == k) & ~F.coalesce(F.col("status").isin(v), F.lit(False)) for k, v in known.items()])
    return records.where(bad).select("object_id", "kind", "status")


def catalog(parts: list[DataFrame]) -> DataFrame:
    """(kind, object_id, title, status) of all listings, by kind and id."""
    return reduce(DataFrame.unionByName, [p.select("kind", "object_id", "title", "status") for p in parts]).orderBy("kind", "object_id")


def review_queue(listing: DataFrame) -> DataFrame:
    """(queue, object_id): drafts to review, stale views, open conflicts, skills to test and to approve."""
    k, s = F.col("kind"), F.col("status")
    queue = F.when((k == "DRAFT") & (s == "DRAFT"), "drafts").when((k == "VIEW") & (s == "STALE"), "stale_views").when((k == "CONFLICT") & (s == "OPEN"), "conflicts").when((k == "SKILL") & (s == "DRAFT"), "skills_to_test").when((k == "SKILL") & (s == "TESTED"), "skills_to_approve")
    return listing.select(queue.alias("queue"), "object_id").where("queue is not null")


def lifecycle(records: DataFrame) -> DataFrame:
    """(object_id, status, lifecycle, current); a status of no lifecycle is UNSUPPORTED."""
    which = reduce(lambda acc, kv: acc.when(F.col("status").isin(kv[1]), kv[0]), LIFECYCLES.items(), F.when(F.lit(False), ""))
    return records.select("object_id", "status", which.otherwise("UNSUPPORTED").alias("lifecycle")).withColumn("current", F.col("lifecycle") == "CURRENT")


def next_actions(records: DataFrame, n: int = 12) -> DataFrame:
    """(rank, kind, object_id, action) of the n first actions: open conflicts, then work by priority and questions; ties by id. The limit is the feature."""
    k, s = F.col("kind"), F.col("status")
    order = F.when((k == "CONFLICT") & (s == "OPEN"), -2).when((k == "WORK_ITEM") & s.isin(UNFINISHED), F.coalesce(F.array_position(F.array(*map(F.lit, ("P0", "P1", "P2", "P3"))), F.coalesce("priority", F.lit("P3"))).cast("int") - 1, F.lit(9))).when((k == "OPEN_QUESTION") & (s == "OPEN"), 4)
    order = F.when(order == -1, 9).otherwise(order)
    action = F.when(k == "CONFLICT", F.concat(F.lit("Review unresolved conflict: "), "title")).when(k == "OPEN_QUESTION", F.concat(F.lit("Resolve open question: "), "title")).otherwise(F.col("title"))
    top = records.withColumn("o", order).where("o is not null").select("o", "kind", "object_id", action.alias("action")).orderBy("o", "object_id").limit(n)
    return top.select(F.row_number().over(Window.orderBy("o", "object_id")).alias("rank"), "kind", "object_id", "action")


def link_graph(records: DataFrame, views: DataFrame, skills: DataFrame) -> DataFrame:
    """Distinct edges (source_id, target_id, relation): RELATED_TO and DERIVED_FROM of records, CONTAINS of views, USES_RESOURCE of skills.

    records: related_ids and revision_ids; views: artifact_id, members; skills: skill_id, resources.
    """
    out = lambda df, key, column, relation: df.select(F.col(key).alias("source_id"), F.explode(column).alias("target_id"), F.lit(relation).alias("relation"))
    edges = [out(records, "object_id", "related_ids", "RELATED_TO"), out(records, "object_id", "revision_ids", "DERIVED_FROM"), out(views, "artifact_id", "members", "CONTAINS"), out(skills, "skill_id", "resources", "USES_RESOURCE")]
    whole = reduce(DataFrame.unionByName, edges)
    columns = ["source_id", "target_id", "relation"]
    return whole.repartition(task_parts(whole), *columns).dropDuplicates(columns)


def neighbours(links: DataFrame, ids: DataFrame, relation: str | None = None) -> DataFrame:
    """Edges that touch any of the ids (object_id) at either end, each once."""
    e = links if relation is None else links.where(F.col("relation") == relation)
    i = ids.select("object_id").distinct()
    at = lambda side: e.join(i, F.col(side) == F.col("object_id"), "left_semi")
    return at("source_id").union(at("target_id")).distinct()


def drill_down(ids: DataFrame, records: DataFrame, history: DataFrame) -> DataFrame:
    """(object_id, kind, found, missing, sequences) for wanted ids: which related ids exist or not, and the ledger entries that name the object."""
    r = records.join(ids.select("object_id"), "object_id", "left_semi")
    rel = r.select("object_id", F.explode("related_ids").alias("other")).join(records.select(F.col("object_id").alias("other"), F.lit(True).alias("there")), "other", "left")
    rel = rel.groupBy("object_id").agg(F.array_sort(F.collect_set(F.when(F.col("there"), F.col("other")))).alias("found"), F.array_sort(F.collect_set(F.when(F.col("there").isNull(), F.col("other")))).alias("missing"))
    h = history.join(ids.select("object_id"), "object_id", "left_semi").groupBy("object_id").agg(F.array_sort(F.collect_set("seq")).alias("sequences"))
    j = r.select("object_id", "kind").join(rel, "object_id", "left").join(h, "object_id", "left")
    return j.select("object_id", "kind", F.coalesce("found", none()).alias("found"), F.coalesce("missing", none()).alias("missing"), F.coalesce("sequences", F.array().cast("array<bigint>")).alias("sequences"))


def source_map(records: DataFrame) -> DataFrame:
    """Source revisions by id."""
    return records.where("kind = 'SOURCE_REVISION'").select("object_id", "title").orderBy("object_id")


def current_skills(skills: DataFrame, approved_only: bool = False) -> DataFrame:
    """The latest version of each skill, or its approved one."""
    rows = skills.where("status = 'APPROVED'") if approved_only else skills
    w = Window.partitionBy("skill_id").orderBy(F.desc("version"))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def fold_skills(operations: DataFrame) -> DataFrame:
    """(skill_id, version, status) by CREATE, REVISE, TEST, APPROVE (which demotes an earlier approved version) and DEPRECATE.

    operations: skill_id, seq, op, version. A version's status is its last operation's, unless another version was approved later.
    """
    status = F.when(F.col("op") == "TEST", "TESTED").when(F.col("op") == "APPROVE", "APPROVED").when(F.col("op") == "DEPRECATE", "DEPRECATED").otherwise("DRAFT")
    own = operations.groupBy("skill_id", "version").agg(F.max_by(status, "seq").alias("status"))
    best = operations.where("op = 'APPROVE'").groupBy("skill_id").agg(F.max_by("version", "seq").alias("approved"))
    j = own.join(best, "skill_id", "left")
    return j.select("skill_id", "version", F.when((F.col("status") == "APPROVED") & (F.col("version") != F.col("approved")), "DEPRECATED").otherwise(F.col("status")).alias("status"))


def skill_version_reuse(skills: DataFrame) -> DataFrame:
    """(skill_id, version, contents) of versions with several contents."""
    return skills.groupBy("skill_id", "version").agg(F.countDistinct("content_hash").alias("contents")).where("contents > 1")


def telemetry(events: DataFrame, event_type: str | None = None) -> DataFrame:
    """Events of a type, each id once (the earliest by time), by time and id."""
    w = Window.partitionBy("event_id").orderBy("ts")
    once = (events if event_type is None else events.where(F.col("event_type") == event_type)).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return once.orderBy("ts", "event_id")


def telemetry_stream(events: DataFrame, event_type: str | None = None, delay: str = "1 hour") -> DataFrame:
    """V26 over a stream: events of a type, each id once if its repeats come within `delay` of it by ts; state older than that goes. A stream has no order by time."""
    kept = events if event_type is None else events.where(F.col("event_type") == event_type)
    return kept.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def view_id(scope: Column) -> Column:
    return short_id("artifact_", scope, 16)
