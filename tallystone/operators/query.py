"""Structured query over all kinds of records (Q01-Q06)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.sources.scratch import task_parts

# Fixed value: the order of kinds in a page.
KINDS = ["SOURCE_REVISION", "CLAIM", "EVIDENCE_LINK", "CONFLICT", "DECISION_RECORD", "OPEN_QUESTION", "WORK_ITEM"]


def query_candidates(sources: DataFrame, claims: DataFrame, evidence: DataFrame, conflicts: DataFrame, continuity: DataFrame) -> DataFrame:
    """Q01: (kind, object_id, title, status, predicates, source_ids, revision_ids): evidence and references are followed to predicates and sources.

    continuity: kind, object_id, title, status, related_ids (claims or revisions).
    """
    none = F.array().cast("array<string>")
    rev = sources.select("revision_id", "source_id")
    n = task_parts(claims, evidence)
    link = evidence.select("claim_id", "evidence_id", "revision_id").join(rev, "revision_id", "left").repartition(n, "claim_id")
    of_claim = link.groupBy("claim_id").agg(F.collect_set("source_id").alias("source_ids"), F.collect_set("revision_id").alias("revision_ids"))
    own = claims.select("claim_id", "predicate", "status").repartition(n, "claim_id")
    c = own.join(of_claim, "claim_id", "left")
    facets = c.select(F.col("claim_id").alias("target"), F.array("predicate").alias("p"), F.coalesce("source_ids", none).alias("s"), F.coalesce("revision_ids", none).alias("r"))
    facets = facets.unionByName(rev.select(F.col("revision_id").alias("target"), none.alias("p"), F.array("source_id").alias("s"), F.array("revision_id").alias("r")))

    def followed(rows: DataFrame) -> DataFrame:
        """rows (kind, object_id, title, status, refs) with the facets of what they refer to."""
        # references of few bytes on disk are very many rows: no broadcast by their size
        met = rows.select("object_id", F.explode("refs").alias("target")).hint("merge").join(facets, "target").groupBy("object_id")
        agg = met.agg(*[F.array_distinct(F.flatten(F.collect_list(x))).alias(y) for x, y in (("p", "predicates"), ("s", "source_ids"), ("r", "revision_ids"))])
        return rows.drop("refs").hint("merge").join(agg, "object_id", "left")

    parts = [
        sources.select(F.lit("SOURCE_REVISION").alias("kind"), F.col("revision_id").alias("object_id"), "title", F.lit("IMMUTABLE").alias("status"), none.alias("predicates"), F.array("source_id").alias("source_ids"), F.array("revision_id").alias("revision_ids")),
        c.select(F.lit("CLAIM").alias("kind"), F.col("claim_id").alias("object_id"), F.lit(None).cast("string").alias("title"), "status", F.array("predicate").alias("predicates"), "source_ids", "revision_ids"),
        link.join(own.select("claim_id", "predicate"), "claim_id", "left").select(F.lit("EVIDENCE_LINK").alias("kind"), F.col("evidence_id").alias("object_id"), F.lit(None).cast("string").alias("title"), F.lit("IMMUTABLE").alias("status"), F.array_compact(F.array("predicate")).alias("predicates"), F.array_compact(F.array("source_id")).alias("source_ids"), F.array("revision_id").alias("revision_ids")),
        followed(conflicts.select(F.lit("CONFLICT").alias("kind"), F.col("conflict_id").alias("object_id"), F.lit(None).cast("string").alias("title"), "status", F.col("members").alias("refs"))),
        followed(continuity.select("kind", "object_id", "title", "status", F.col("related_ids").alias("refs"))),
    ]
    whole = reduce(DataFrame.unionByName, parts)
    return whole.withColumns({x: F.array_sort(F.coalesce(x, none)) for x in ("predicates", "source_ids", "revision_ids")})


def _tests(spec: dict) -> dict[str, Column]:
    """The condition of each field that a spec uses."""
    def meets(column: str) -> Column:
        return F.arrays_overlap(column, F.array(*map(F.lit, spec[column])))

    tests = {"kinds": lambda: F.col("kind").isin(spec["kinds"]), "ids": lambda: F.col("object_id").isin(spec["ids"]), "statuses": lambda: F.col("status").isin(spec["statuses"]), "title_contains": lambda: F.lower("title").contains(spec["title_contains"].lower())}
    tests |= {c: (lambda c=c: meets(c)) for c in ("predicates", "source_ids", "revision_ids")}
    return {name: test() for name, test in tests.items() if spec.get(name)}


def query(candidates: DataFrame, spec: dict) -> DataFrame:
    """Q02: candidates that meet every field of spec; a field is met by any of its values."""
    return reduce(lambda df, t: df.where(F.coalesce(t, F.lit(False))), _tests(spec).values(), candidates)


def page(hits: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Q03: one page by kind order and id, with total and truncated. limit 1 to 1000."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1..1000 and offset at least 0")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    total = hits.agg(F.count("*").alias("total"))
    rows = hits.withColumn("kind_order", order).orderBy("kind_order", "object_id").offset(offset).limit(limit).drop("kind_order")
    return rows.join(F.broadcast(total)).withColumn("truncated", F.col("total") > offset + limit)


def matched_fields(hits: DataFrame, spec: dict) -> DataFrame:
    """Q04: hits with matched_fields, the spec's fields in use, in order."""
    return hits.withColumn("matched_fields", F.array(*[F.lit(x) for x in sorted(_tests(spec))]).cast("array<string>"))


def list_drafts(drafts: DataFrame, status: str | None = None, kind: str | None = None, batch: str | None = None) -> DataFrame:
    """Q05: drafts by optional status, draft_kind and batch_key, by id."""
    wanted = {"status": status, "draft_kind": kind, "batch_key": batch}
    return reduce(lambda df, kv: df if kv[1] is None else df.where(F.col(kv[0]) == kv[1]), wanted.items(), drafts).orderBy("draft_id")


def list_work_items(records: DataFrame, status: str | None = None) -> DataFrame:
    """Q06: work items, of a status if given, by id."""
    rows = records.where("kind = 'WORK_ITEM'")
    return (rows if status is None else rows.where(F.col("status") == status)).orderBy("object_id")
