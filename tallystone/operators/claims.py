"""Claims, evidence and conflicts.

A claim row: claim_id, subject_id, subject_type, predicate, object_kind, object_value, object_type, polarity, component,
environment, region, tenant, valid_from, valid_to, status, version, seq. A registry row: key, subject_types, object_kind,
object_types, enum_values, scope_allowed, scope_required, temporal, cardinality, family_fields, rules, min_links,
interpretations. Rules with null arguments don't fire; ties are broken by ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.canon import canonical, digest, first_code, short_id, utc_text
from tallystone.functions.trees import tree_digest
from tallystone.operators.intervals import least_of_others
from tallystone.sources.scratch import task_parts, written

SCOPE = ("component", "environment", "region", "tenant")


def _registered(claims: DataFrame, registry: DataFrame, how: str = "inner") -> DataFrame:
    """The registry is a dimension of one row for each predicate in use. It is broadcast by a hint: made of local rows it has no size to plan by, and a join dealt by predicate would bring all claims of one predicate into one task."""
    return claims.join(F.broadcast(registry.withColumnRenamed("key", "predicate")), "predicate", how)


def conformance(claims: DataFrame, registry: DataFrame, interpretations: DataFrame | None = None) -> DataFrame:
    """(claim_id, code): the first rule of its predicate that a claim breaks, null if none.

    interpretations: (claim_id, interpretations array) of its evidence, optional.
    """
    c = _registered(claims, registry.withColumn("known", F.lit(True)).withColumnRenamed("object_kind", "want_kind"), "left")
    if interpretations is not None:
        c = c.join(interpretations.withColumnRenamed("interpretations", "used"), "claim_id", "left")
    else:
        c = c.withColumn("used", F.array().cast("array<string>"))
    given = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in SCOPE]))
    code = first_code(
        (F.col("known").isNull(), "UNKNOWN_PREDICATE"),
        (~F.array_contains("subject_types", F.col("subject_type")), "SUBJECT_TYPE_MISMATCH"),
        (F.col("object_kind") != F.col("want_kind"), "OBJECT_KIND_MISMATCH"),
        ((F.col("want_kind") == "entity") & ~F.array_contains("object_types", F.col("object_type")), "OBJECT_ENTITY_TYPE_MISMATCH"),
        ((F.col("want_kind") == "enum") & ~F.array_contains("enum_values", F.col("object_value")), "OBJECT_ENUM_VALUE_NOT_ALLOWED"),
        (F.size(F.array_except(given, "scope_allowed")) > 0, "SCOPE_FIELD_NOT_ALLOWED"),
        (F.size(F.array_except("scope_required", given)) > 0, "REQUIRED_SCOPE_MISSING"),
        ((F.col("temporal") == "REQUIRED") & F.col("valid_from").isNull(), "VALID_TIME_REQUIRED"),
        ((F.col("temporal") == "FORBIDDEN") & (F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull()), "VALID_TIME_FORBIDDEN"),
        (F.col("valid_from") >= F.col("valid_to"), "INVALID_VALID_TIME_RANGE"),
        (F.size(F.array_except(F.coalesce("used", F.array().cast("array<string>")), F.col("interpretations"))) > 0, "EVIDENCE_INTERPRETATION_NOT_ALLOWED"),
    )
    return c.select("claim_id", code.alias("code"))


def proposition_json() -> Column:
    """The canonical JSON of a claim's proposition."""
    obj = F.when(F.col("object_kind") == "entity", canonical(F.struct(F.col("object_value").alias("entity_id"), F.col("object_type").alias("entity_type"), F.col("object_kind").alias("kind"))))
    obj = obj.otherwise(canonical(F.struct(F.col("object_kind").alias("kind"), F.col("object_value").alias("value"))))
    rest = canonical(F.struct("polarity", "predicate", F.lit(1).alias("proposition_version"), F.struct(*SCOPE).alias("scope"), F.struct(F.col("subject_id").alias("entity_id"), F.col("subject_type").alias("entity_type")).alias("subject"), F.struct(utc_text(F.col("valid_from")).alias("from"), utc_text(F.col("valid_to")).alias("to")).alias("valid_time")))
    return F.concat(F.lit('{"object":'), obj, F.lit(","), F.substring(rest, 2, 1 << 30))


def with_proposition_hash(claims: DataFrame) -> DataFrame:
    return claims.withColumn("proposition_hash", digest(proposition_json()))


def proposition_hash_check(claims: DataFrame) -> DataFrame:
    """(claim_id) whose declared_hash is not that of their proposition."""
    return claims.where(~F.col("declared_hash").eqNullSafe(digest(proposition_json()))).select("claim_id")


def with_family_key(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """Claims with family_key, the digest of the registry's family fields in order; absent fields count as null."""
    names = {"subject.entity_id": "subject_id", "predicate": "predicate", **{f"scope.{s}": s for s in SCOPE}}
    # a chain of comparisons: a map would be built anew for each field of each claim
    field = lambda f: reduce(lambda rest, n: F.when(f == n[0], F.col(n[1])).otherwise(rest), names.items(), F.lit(None).cast("string"))
    joined = _registered(claims, registry.select("key", "family_fields"))
    return joined.withColumn("family_key", digest(F.to_json(F.transform("family_fields", field)))).drop("family_fields")


def verify_evidence(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """(evidence_id, code) with SOURCE_NOT_FOUND, RANGE_INVALID, EXCERPT_MISMATCH or OK. Offsets are bytes, half open."""
    joined = evidence.join(sources.select("revision_id", F.col("content").alias("__content")), "revision_id", "left")
    part = F.expr("substring(__content, cast(start_byte + 1 as int), cast(end_byte - start_byte as int))")
    bad_range = (F.col("start_byte") < 0) | (F.col("end_byte") <= F.col("start_byte")) | (F.col("end_byte") > F.octet_length("__content")) | F.col("start_byte").isNull() | F.col("end_byte").isNull()
    code = first_code((F.col("__content").isNull(), "SOURCE_NOT_FOUND"), (bad_range, "RANGE_INVALID"), (~F.col("excerpt_hash").eqNullSafe(digest(part)), "EXCERPT_MISMATCH"))
    return joined.select("evidence_id", F.coalesce(code, F.lit("OK")).alias("code"))


def insufficient_evidence(claims: DataFrame, evidence: DataFrame, registry: DataFrame) -> DataFrame:
    """(claim_id, links, min_links) of claims with fewer evidence links than their predicate asks for."""
    counted = evidence.groupBy("claim_id").agg(F.count("*").alias("links"))
    joined = _registered(claims.select("claim_id", "predicate"), registry.select("key", "min_links")).join(counted, "claim_id", "left").na.fill(0, ["links"])
    return joined.where("links < min_links").select("claim_id", "links", "min_links")


def valid_time_overlap(from_a: Column, to_a: Column, from_b: Column, to_b: Column) -> Column:
    """Half-open intervals share an instant; null is unbounded, touching ends don't overlap."""
    never = lambda a, b: F.coalesce(a >= b, F.lit(False))
    return ~(never(from_a, to_b) | never(from_b, to_a) | never(from_a, to_a) | never(from_b, to_b))


def _active(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """ACTIVE claims with their family and, as flags, the rules of their predicate."""
    has = lambda rule: F.coalesce(F.array_contains("rules", rule), F.lit(False))
    exclusive = has("EXCLUSIVE_OBJECT") & F.coalesce(F.col("cardinality") == "ONE", F.lit(False))
    rules = registry.select("key", has("OPPOSITE_POLARITY").alias("opposes"), exclusive.alias("excludes"), has("TEMPORAL_OVERLAP").alias("timed"))
    active = _registered(with_family_key(claims.where("status = 'ACTIVE'"), registry), rules)
    return active.select("family_key", "claim_id", "object_value", "polarity", "valid_from", "valid_to", "seq", "opposes", "excludes", "timed")


def _contestable(active: DataFrame) -> DataFrame:
    """The claims of `_active` without the families of one object and polarity."""
    # hashed by keys: the least and largest of strings would be sorted where claims are read
    open_ = active.select("family_key", "object_value", "polarity").distinct().groupBy("family_key").count().where("count > 1").select("family_key")
    return active.join(open_, "family_key", "left_semi")


def _pairs(active: DataFrame) -> DataFrame:
    a, b = active.alias("a"), active.drop("opposes", "excludes", "timed").alias("b")
    overlap = valid_time_overlap(F.col("a.valid_from"), F.col("a.valid_to"), F.col("b.valid_from"), F.col("b.valid_to"))
    same = F.col("a.object_value") == F.col("b.object_value")
    kind = F.when(F.col("a.opposes") & same & (F.col("a.polarity") != F.col("b.polarity")), "POLARITY_CONFLICT")
    kind = kind.when(F.col("a.excludes") & (F.col("a.polarity") == "POSITIVE") & (F.col("b.polarity") == "POSITIVE") & ~same, "EXCLUSIVE_VALUE_CONFLICT")
    met = a.join(b, (F.col("a.family_key") == F.col("b.family_key")) & (F.col("a.claim_id") < F.col("b.claim_id")) & (~F.col("a.timed") | overlap))
    return met.select(F.col("a.family_key").alias("family_key"), kind.alias("kind"), F.col("a.claim_id").alias("claim_a"), F.col("b.claim_id").alias("claim_b"), F.greatest("a.seq", "b.seq").alias("opened_seq")).where("kind is not null")


def conflict_pairs(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """(family_key, kind, claim_a, claim_b, opened_seq) of ACTIVE claims that contradict each other, claim_a < claim_b.

    Opposite polarity about one object comes first, else different objects of a predicate of cardinality ONE; both need
    overlapping time where the predicate says so. Families with one object and polarity leave before the join;
    a hot family's join is split by Spark's skew handling as nothing above needs it whole. Pairs are the result here; what only asks who is in conflict uses `conflict_members`.
    """
    return _pairs(_contestable(_active(claims, registry)))


#: Members of a family up to which its pairs are formed.
PAIRED_FAMILY = 64


def conflict_members(claims: DataFrame, registry: DataFrame, paired: int = PAIRED_FAMILY) -> DataFrame:
    """(family_key, kind, member, since): who contradicts anyone, and from which sequence on, as over `conflict_pairs` but without the pairs of large families.

    since: the larger of a claim's own sequence and its partners' least. Families of up to `paired` members form their pairs, which is at most so many for each member; in larger ones
    every claim finds the least sequence of its partners by `least_of_others`, so the work grows with members and not with pairs.
    """
    # families are digests, which a plan that reads claims more than once would make more than once
    active = written(_contestable(written(_active(claims, registry), "active-claims")), "contestable")
    large = written(active.groupBy("family_key").count().where(F.col("count") > paired).select("family_key"), "large-families")
    pairs = _pairs(active.join(large, "family_key", "left_anti"))
    seen = pairs.select("family_key", "kind", "opened_seq", F.explode(F.array("claim_a", "claim_b")).alias("member")).groupBy("family_key", "kind", "member").agg(F.min("opened_seq").alias("since"))
    if large.limit(1).count() == 0:
        return seen
    rest = active.join(large, "family_key", "left_semi").where("object_value is not null and polarity is not null")
    # where time plays no part, all intervals are unbounded
    timed = {c: F.when(F.col("timed"), F.col(c)) for c in ("valid_from", "valid_to")}
    opposite = rest.where("opposes").select("family_key", F.lit("POLARITY_CONFLICT").alias("kind"), F.col("object_value").alias("about"), F.col("polarity").alias("side"), "claim_id", "seq", "timed", "valid_from", "valid_to")
    exclusive = rest.where(F.col("excludes") & (F.col("polarity") == "POSITIVE"))
    exclusive = exclusive.select("family_key", F.lit("EXCLUSIVE_VALUE_CONFLICT").alias("kind"), F.lit("").alias("about"), F.col("object_value").alias("side"), "claim_id", "seq", "timed", "valid_from", "valid_to")
    sides = written(opposite.unionByName(exclusive).withColumns(timed).drop("timed"), "conflict-sides")
    least = least_of_others(sides, ["family_key", "kind", "about"], "claim_id", "side", "valid_from", "valid_to", "seq")
    joined = least.join(sides.select("family_key", "kind", "about", "claim_id", "seq"), ["family_key", "kind", "about", "claim_id"])
    return seen.unionByName(joined.select("family_key", "kind", F.col("claim_id").alias("member"), F.greatest("seq", "least").alias("since")))


def _episodes(seen: DataFrame) -> DataFrame:
    told = seen.groupBy("family_key", "kind").agg(F.min("since").alias("opened_seq"), F.array_sort(F.collect_list(F.struct("member", "since"))).alias("told"))
    opening = F.filter("told", lambda x: x["since"] == F.col("opened_seq"))
    sets = told.select("family_key", "kind", "opened_seq", F.col("told.member").alias("members"), F.transform(opening, lambda x: x["member"]).alias("opening"))
    name = short_id("conflict_", F.concat_ws("|", "family_key", "kind", digest(F.to_json("opening"))))
    return sets.select(name.alias("conflict_id"), "family_key", "kind", "members", digest(F.to_json("members")).alias("member_digest"), "opened_seq", F.lit("OPEN").alias("status"), F.lit(1).alias("episode"))


def conflict_episodes(claims: DataFrame, registry: DataFrame, paired: int = PAIRED_FAMILY) -> DataFrame:
    """One OPEN conflict per (family, kind): conflict_id, members array, member_digest, opened_seq.

    Members are all claims that contradict another; the id comes from the members of the first opening, so later members extend a
    conflict without renaming it.
    """
    return _episodes(conflict_members(claims, registry, paired))


def episodes_of_pairs(pairs: DataFrame) -> DataFrame:
    """C08 from the pairs of C07."""
    ends = pairs.select("family_key", "kind", "opened_seq", F.explode(F.array("claim_a", "claim_b")).alias("member"))
    return _episodes(ends.groupBy("family_key", "kind", "member").agg(F.min("opened_seq").alias("since")))


def resolution_check(resolutions: DataFrame, conflicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(resolution_id, code): the first reason why a resolution can't be applied, null if it can.

    resolutions: resolution_id, conflict_id, member_digest, episode, selected array, rejected array, evidence_ids array.
    """
    joined = resolutions.join(conflicts.select("conflict_id", "status", "members", F.col("member_digest").alias("have_digest"), F.col("episode").alias("have_episode")), "conflict_id", "left")
    cited = resolutions.select("resolution_id", "conflict_id", F.explode("evidence_ids").alias("evidence_id"))
    owned = cited.join(evidence.select("evidence_id", "claim_id"), "evidence_id", "left").join(conflicts.select("conflict_id", "members"), "conflict_id", "left")
    stray = owned.where(~F.coalesce(F.array_contains("members", F.col("claim_id")), F.lit(False))).select("resolution_id").distinct().withColumn("stray", F.lit(True))
    joined = joined.join(stray, "resolution_id", "left")
    union = F.array_sort(F.array_union("selected", "rejected"))
    code = first_code(
        (F.col("members").isNull(), "CONFLICT_NOT_FOUND"),
        (F.col("status") != "OPEN", "CONFLICT_NOT_OPEN"),
        (F.col("member_digest") != F.col("have_digest"), "MEMBER_DIGEST_MISMATCH"),
        (F.col("episode") != F.col("have_episode"), "EPISODE_MISMATCH"),
        (F.arrays_overlap("selected", "rejected") | (union != F.array_sort("members")), "RESOLUTION_NOT_A_PARTITION"),
        (F.col("stray"), "EVIDENCE_NOT_OF_MEMBERS"),
    )
    return joined.select("resolution_id", code.alias("code"))


def authority_check(operations: DataFrame, records: DataFrame) -> DataFrame:
    """(op_id, allowed): a HUMAN actor may act on any record, others on what they asserted themselves."""
    joined = operations.join(records.select("record_id", "asserted_by"), "record_id", "left")
    return joined.select("op_id", ((F.col("actor_type") == "HUMAN") | F.coalesce(F.col("actor_id") == F.col("asserted_by"), F.lit(False))).alias("allowed"))


def active_set_digest(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """C11: (family_key, members, digest) over the (claim_id, proposition_hash, version) of ACTIVE claims, by levels of buckets, so that no family is ever one list."""
    active = with_proposition_hash(with_family_key(claims.where("status = 'ACTIVE'"), registry))
    row = active.select("family_key", "claim_id", F.sha2(canonical(F.struct("claim_id", "proposition_hash", "version")), 256).alias("h"))
    return tree_digest(row, ["family_key"], "claim_id", "h", 2).select("family_key", F.col("rows").alias("members"), "digest")


def epistemic_context(claims: DataFrame, evidence: DataFrame, conflicts: DataFrame, keys: DataFrame) -> DataFrame:
    """ACTIVE claims for (subject_id, predicate, environment) keys, with sorted evidence_ids and open conflict_ids."""
    wanted = claims.where("status = 'ACTIVE'").join(keys, ["subject_id", "predicate", "environment"], "left_semi")
    n = task_parts(claims, evidence)
    wanted = wanted.repartition(n, "claim_id")
    links = evidence.repartition(n, "claim_id").join(wanted.select("claim_id"), "claim_id", "left_semi").groupBy("claim_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    touching = conflicts.where("status = 'OPEN'").select("conflict_id", F.explode("members").alias("claim_id")).repartition(n, "claim_id").groupBy("claim_id").agg(F.array_sort(F.collect_set("conflict_id")).alias("conflict_ids"))
    empty = F.array().cast("array<string>")
    joined = wanted.join(links, "claim_id", "left").join(touching, "claim_id", "left")
    return joined.withColumns({"evidence_ids": F.coalesce("evidence_ids", empty), "conflict_ids": F.coalesce("conflict_ids", empty)})


def reference_check(refs: DataFrame, namespace: DataFrame) -> DataFrame:
    """(ref_id, code) of typed references that don't hold: REFERENCE_NOT_FOUND or REFERENCE_TYPE_MISMATCH."""
    joined = refs.join(namespace.select(F.col("object_id").alias("target"), F.col("kind").alias("have")), "target", "left")
    code = first_code((F.col("have").isNull(), "REFERENCE_NOT_FOUND"), (F.col("have") != F.col("record_type"), "REFERENCE_TYPE_MISMATCH"))
    return joined.select("ref_id", code.alias("code")).where("code is not null")


def list_conflicts(conflicts: DataFrame, status: str | None = None) -> DataFrame:
    """C14: conflicts of a status, by id."""
    return (conflicts if status is None else conflicts.where(F.col("status") == status)).orderBy("conflict_id")


def resolution_preservation(before: DataFrame, after: DataFrame) -> DataFrame:
    """(conflict_id, failures array) for each conflict of `before`: what a resolution failed to preserve or to record.

    before, after: conflict_id, episode, member_digest, members, version; after also status, selected, rejected, rationale, resolved_by, evidence_ids, resolved_at.
    """
    a = after.select("conflict_id", *[F.col(c).alias(f"new_{c}") for c in after.columns if c != "conflict_id"])
    j = before.join(a, "conflict_id", "left")
    checks = [
        (F.col("new_episode").isNull(), "CONFLICT_LOST"),
        (F.col("episode") != F.col("new_episode"), "EPISODE_CHANGED"),
        (F.col("member_digest") != F.col("new_member_digest"), "DIGEST_CHANGED"),
        (F.array_sort("members") != F.array_sort("new_members"), "MEMBERS_CHANGED"),
        (F.col("new_version") != F.col("version") + 1, "VERSION_NOT_INCREMENTED"),
        (F.array_sort(F.array_union("new_selected", "new_rejected")) != F.array_sort("members"), "PARTITION_INCOMPLETE"),
        (F.length(F.coalesce("new_rationale", F.lit(""))) == 0, "RATIONALE_MISSING"),
        (F.col("new_resolved_by").isNull(), "RESOLVER_MISSING"),
        (F.size(F.coalesce("new_evidence_ids", F.array().cast("array<string>"))) == 0, "EVIDENCE_MISSING"),
        (F.col("new_resolved_at").isNull(), "TIME_MISSING"),
    ]
    failures = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in checks]))
    return j.select("conflict_id", failures.alias("failures"))
