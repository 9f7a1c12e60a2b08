"""Quality metrics (M01-M13). Rates over nothing are 0, recalls over nothing 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.operators.prefix import last_before

# Weights of the continuity dimensions and penalties, and what the score may be.
WEIGHTS = {"project_purpose": 10, "decision_and_rationale": 20, "settled_claim_and_evidence_locator": 20, "open_conflict_and_all_members": 25, "open_question": 10, "actionable_work": 15}
PENALTIES = {"HALLUCINATED_ID": 50, "CONFLICT_SETTLED": 25, "EVIDENCE_MISSING": 25}


def rate(condition: Column, empty: float = 0.0) -> Column:
    """The share of rows for which a condition holds."""
    return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("int")), F.lit(empty))


def recall(actual: Column, expected: Column) -> Column:
    """The share of expected ids among the actual ones, of two arrays."""
    want = F.array_distinct(expected)
    return F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(want, actual)) / F.size(want))


def memory_quality(evidence: DataFrame, members: DataFrame, views: DataFrame, records: DataFrame, drafts: DataFrame) -> DataFrame:
    """One row: evidence_validity, conflict_member_recall, stale_view_rate, provenance_completeness, duplicate_drafts.

    evidence: code; members: present; views: status; records: revision_ids; drafts: batch_key, digest, draft_kind.
    """
    one = [evidence.agg(rate(F.col("code") == "OK", 1.0).alias("evidence_validity")), members.agg(rate(F.col("present"), 1.0).alias("conflict_member_recall")), views.agg(rate(F.col("status") == "STALE").alias("stale_view_rate")), records.agg(rate(F.size("revision_ids") > 0, 1.0).alias("provenance_completeness"))]
    twice = drafts.groupBy("batch_key", "digest", "draft_kind").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_drafts"))
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [*one, twice])  # one row each


def routing_metrics(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, parity, recall, irrelevant_rate, bytes) over repeated runs (case_id, run, hash, ids, bytes) and expectations (case_id, ids)."""
    r = runs.groupBy("case_id").agg((F.countDistinct("hash") == 1).alias("parity"), F.min_by(F.struct("ids", "bytes"), "run").alias("first"))
    j = r.join(expected.withColumnRenamed("ids", "want"), "case_id")
    stray = F.size(F.array_except("first.ids", "want")) / F.size("first.ids")
    return j.select("case_id", "parity", recall(F.col("first.ids"), F.col("want")).alias("recall"), F.when(F.size("first.ids") == 0, 0.0).otherwise(stray).alias("irrelevant_rate"), F.col("first.bytes").alias("bytes"))


def pollution(memories: DataFrame, truth: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(scope, total, duplicate, irrelevant, stale, wrong, confidently_wrong) rates. A duplicate is the second or later row of a semantic key by `position`.

    memories: scope, position, memory_id, semantic_key, value, lifecycle, relevant, confidence; truth: scope, semantic_key, value.
    """
    first = memories.groupBy("scope", "semantic_key").agg(F.min("position").alias("first"))
    j = memories.join(first, ["scope", "semantic_key"]).join(truth.withColumnRenamed("value", "true_value"), ["scope", "semantic_key"], "left")
    wrong = F.col("value") != F.col("true_value")
    return j.groupBy("scope").agg(F.count("*").alias("total"), rate(F.col("position") > F.col("first")).alias("duplicate"), rate(~F.col("relevant")).alias("irrelevant"), rate(F.col("lifecycle") == "STALE").alias("stale"), rate(wrong).alias("wrong"), rate(wrong & (F.col("confidence") >= threshold)).alias("confidently_wrong"))


def zero_relearning(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, continuity_accuracy, decision_recall, question_recall, conflict_recall, evidence_traceability, wrong_rate, missing_rate, irrelevant_rate, failures).

    Both: case_id, purpose, decision_ids, question_ids, conflict_ids, work_item_id, source_ids, and maps memory (observed) and truth (expected); observed also
    included_ids, expected critical_ids, relevant_ids and min_accuracy.
    """
    e = expected.select("case_id", *[F.col(c).alias(f"x_{c}") for c in expected.columns if c != "case_id"])
    j = observed.join(e, "case_id")
    recalls = {n: recall(F.col(c), F.col(f"x_{c}")) for n, c in (("decision_recall", "decision_ids"), ("question_recall", "question_ids"), ("conflict_recall", "conflict_ids"), ("evidence_traceability", "source_ids"))}
    keys = F.map_keys("x_truth")
    same = F.filter(keys, lambda k: F.col("memory")[k].eqNullSafe(F.col("x_truth")[k]))
    semantic = F.when(F.size(keys) == 0, 1.0).otherwise(F.size(same) / F.size(keys))
    wrong = F.size(F.filter(F.map_keys("memory"), lambda k: ~F.col("memory")[k].eqNullSafe(F.col("x_truth")[k])))
    seen = F.array_distinct(F.concat("decision_ids", "question_ids", "conflict_ids", F.array("work_item_id"), "source_ids"))
    missing = F.size(F.array_except("x_critical_ids", seen)) + F.size(F.array_except(keys, F.map_keys("memory")))
    critical = F.size(F.array_distinct("x_critical_ids")) + F.size(keys)
    stray = F.size(F.array_except("included_ids", F.when(F.size("x_relevant_ids") > 0, F.col("x_relevant_ids")).otherwise(F.col("x_critical_ids"))))
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    accuracy = ((F.col("purpose") == F.col("x_purpose")).cast("int") + (F.col("work_item_id") == F.col("x_work_item_id")).cast("int") + sum(recalls.values(), F.lit(0.0)) + semantic) / 7
    out = j.select("case_id", accuracy.alias("continuity_accuracy"), *[v.alias(n) for n, v in recalls.items()], share(wrong, F.size("memory")).alias("wrong_rate"), share(missing, critical).alias("missing_rate"), share(stray, F.size(F.array_distinct("included_ids"))).alias("irrelevant_rate"), "x_min_accuracy")
    fails = F.array_compact(F.array(F.when(F.col("continuity_accuracy") < F.col("x_min_accuracy"), F.lit("CONTINUITY_ACCURACY")), F.when(F.col("wrong_rate") > 0, F.lit("WRONG_MEMORY")), F.when(F.col("missing_rate") > 0, F.lit("MISSING_CRITICAL_MEMORY"))))
    return out.withColumn("failures", fails).drop("x_min_accuracy")


def context_quality(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """M04's accuracy, traceability and irrelevant rate, with relevant_recall of the included ids."""
    rel = observed.select("case_id", "included_ids").join(expected.select("case_id", "relevant_ids"), "case_id").select("case_id", recall(F.col("included_ids"), F.col("relevant_ids")).alias("relevant_recall"))
    return zero_relearning(observed, expected).select("case_id", "continuity_accuracy", "evidence_traceability", "irrelevant_rate").join(rel, "case_id")


def reduction(baseline: Column, candidate: Column) -> Column:
    """(b - c) / b, not clamped; null for a baseline of 0."""
    return F.when(baseline != 0, (baseline - candidate) / baseline)


def paired_reduction(runs: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(pair_id, one reduction per resource, quality_preserved, passed). runs: pair_id, arm (baseline, candidate), quality, and the resources in thresholds."""
    side = lambda arm: runs.where(F.col("arm") == arm).select("pair_id", *[F.col(c).alias(f"{arm}_{c}") for c in (*thresholds, "quality")])
    j = side("baseline").join(side("candidate"), "pair_id")
    parts = {c: reduction(F.col(f"baseline_{c}"), F.col(f"candidate_{c}")) for c in thresholds}
    kept = F.col("candidate_quality") >= F.col("baseline_quality")
    enough = reduce(lambda a, b: a & b, [F.coalesce(parts[c] >= t, F.lit(False)) for c, t in thresholds.items()])
    return j.select("pair_id", *[v.alias(c) for c, v in parts.items()], kept.alias("quality_preserved"), (kept & enough).alias("passed"))


def cold_start(handoffs: DataFrame) -> DataFrame:
    """(handoff_id, byte_reduction, recall) of context against the manual text. handoffs: handoff_id, manual, context, included_ids, expected_ids."""
    return handoffs.select("handoff_id", reduction(F.octet_length("manual"), F.octet_length("context")).alias("byte_reduction"), recall(F.col("included_ids"), F.col("expected_ids")).alias("recall"))


def continuity_score(responses: DataFrame) -> DataFrame:
    """(response_id, score, fact_accuracy) from one boolean column per dimension and penalty_codes; weighted points less penalties, 0 to 100."""
    points = reduce(lambda a, b: a + b, [F.when(F.col(c), w).otherwise(0) for c, w in WEIGHTS.items()])
    lost = F.aggregate(F.array_distinct("penalty_codes"), F.lit(0), lambda a, c: a + reduce(lambda x, kv: F.when(c == kv[0], kv[1]).otherwise(x), PENALTIES.items(), F.lit(0)))
    right = reduce(lambda a, b: a + b, [F.col(c).cast("int") for c in WEIGHTS])
    return responses.select("response_id", F.greatest(F.lit(0), F.least(F.lit(100), points - lost)).alias("score"), F.round(right / len(WEIGHTS), 12).alias("fact_accuracy"))


def hallucinated_ids(used: DataFrame, context: DataFrame, conflict_members: DataFrame) -> DataFrame:
    """(response_id, object_id, code): ids that the context (scenario_id, object_id) lacks, and open conflicts' members given as settled. used: response_id, scenario_id, object_id, settled."""
    absent = used.join(context, ["scenario_id", "object_id"], "left_anti").select("response_id", "object_id", F.lit("HALLUCINATED_ID").alias("code"))
    settled = used.where("settled").join(conflict_members, ["scenario_id", "object_id"], "left_semi").select("response_id", "object_id", F.lit("CONFLICT_SETTLED").alias("code"))
    return absent.unionByName(settled).distinct()


def conflict_member_recall(expected: DataFrame, recalled: DataFrame) -> DataFrame:
    """(scenario_id, recall) of expected (scenario_id, conflict_id, claim_id) pairs, to 12 decimals."""
    got = recalled.select("scenario_id", "conflict_id", "claim_id").distinct().withColumn("hit", F.lit(True))
    j = expected.distinct().join(got, ["scenario_id", "conflict_id", "claim_id"], "left")
    return j.groupBy("scenario_id").agg(F.round(rate(F.col("hit"), 1.0), 12).alias("recall"))


def live_comparison(arms: DataFrame, resources: list[str], clamp: bool = False, target: float = 0.5) -> DataFrame:
    """(scenario_id, 1 - candidate / baseline per resource, meets_target). arms: scenario_id, arm (baseline, candidate) and resources; clamp keeps 0 to 1."""
    wide = arms.groupBy("scenario_id").agg(*[F.max(F.when(F.col("arm") == a, F.col(r))).alias(f"{a}_{r}") for a in ("baseline", "candidate") for r in resources])
    def part(r: str) -> Column:
        x = 1 - F.col(f"candidate_{r}") / F.nullif(F.col(f"baseline_{r}"), F.lit(0))
        return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) if clamp else x, 12)

    meets = reduce(lambda a, b: a & b, [F.coalesce(part(r) >= target, F.lit(False)) for r in resources])
    return wide.select("scenario_id", *[part(r).alias(r) for r in resources], meets.alias("meets_target"))


def latency_summary(samples: DataFrame) -> DataFrame:
    """(series, samples, min, median, max, p95 by nearest rank). samples: series, value; null values are samples without a value.

    Values get their place in their series by ranges of the order, and the few places that count are picked, so a series of any size is dealt over all tasks.
    """
    whole = samples.groupBy("series").agg(F.count("*").alias("samples"), F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"))
    placed = last_before(samples.select("series", "value").where("value is not null"), "series", "value", F.lit(None).cast("long"), "none", "k").select(F.col("series").alias("of"), "value", "k")
    nearest, low, high = F.ceil(F.col("n") * 95 / 100), F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    picked = placed.join(whole, F.col("of").eqNullSafe(F.col("series"))).where((F.col("k") == nearest) | (F.col("k") == low) | (F.col("k") == high))
    middle = F.avg(F.when((F.col("k") == low) | (F.col("k") == high), F.col("value")))
    told = picked.groupBy("of").agg(middle.alias("median"), F.max(F.when(F.col("k") == nearest, F.col("value"))).alias("p95"))
    return whole.join(told, F.col("of").eqNullSafe(F.col("series")), "left").select("series", "samples", "min", "median", "max", "p95")


def skill_rule_check(outputs: DataFrame, rules: DataFrame) -> DataFrame:
    """(skill_id, rules, passed): CONTAINS, EQUALS and NON_EMPTY over recorded outputs; passed with at least one rule and all of them met. outputs: skill_id, output; rules: skill_id, type, value."""
    o = F.coalesce("output", F.lit(""))
    ok = F.when(F.col("type") == "CONTAINS", F.contains(o, F.col("value"))).when(F.col("type") == "EQUALS", o == F.col("value")).when(F.col("type") == "NON_EMPTY", F.length(F.trim(o)) > 0).otherwise(False)
    j = outputs.join(rules, "skill_id", "left")
    return j.groupBy("skill_id").agg(F.count("type").alias("rules"), (F.coalesce(F.bool_and(F.when(F.col("type").isNotNull(), F.coalesce(ok, F.lit(False)))), F.lit(False)) & (F.count("type") > 0)).alias("passed"))


def duplicates_by_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Second and later rows of a key by an explicit order."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n > 1").drop("__n")
