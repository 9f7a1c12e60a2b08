"""Domain tables derived from the given ones, in Spark and as DuckDB CTEs that compute the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions.canon import digest

# The two predicates that derived claims use.
REGISTRY_ROWS = [
    ("order.priority@1", ["customer"], "enum", [], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], ["environment", "region"], ["environment"], "REQUIRED", "ONE", ["subject.entity_id", "predicate", "scope.environment", "scope.component", "scope.region", "scope.tenant"], ["OPPOSITE_POLARITY", "EXCLUSIVE_OBJECT", "TEMPORAL_OVERLAP"], 1, ["DIRECT", "REPORTED"]),
    ("order.supplier@1", ["customer", "supplier"], "entity", ["supplier"], [], ["environment"], [], "OPTIONAL", "MANY", ["subject.entity_id", "predicate", "scope.environment"], ["OPPOSITE_POLARITY"], 2, ["DIRECT", "REPORTED", "INFERRED"]),
]
REGISTRY_SCHEMA = "key string, subject_types array<string>, object_kind string, object_types array<string>, enum_values array<string>, scope_allowed array<string>, scope_required array<string>, temporal string, cardinality string, family_fields array<string>, rules array<string>, min_links int, interpretations array<string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY_ROWS, REGISTRY_SCHEMA)


def claims(spark: SparkSession, d: str) -> DataFrame:
    """One claim per order: which priority the customer's orders of a status have."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.concat(F.lit("claim_"), k).alias("claim_id"), F.concat(F.lit("customer:"), F.col("o_custkey")).alias("subject_id"),
        F.when(k % 101 == 0, "person").otherwise("customer").alias("subject_type"), F.when(k % 103 == 0, "order.unknown@1").otherwise("order.priority@1").alias("predicate"),
        F.lit("enum").alias("object_kind"), F.col("o_orderpriority").alias("object_value"), F.lit(None).cast("string").alias("object_type"),
        F.when(k % 7 == 0, "NEGATIVE").otherwise("POSITIVE").alias("polarity"), F.when(k % 107 == 0, "api").alias("component"),
        F.when(k % 109 != 0, F.col("o_orderstatus")).alias("environment"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("tenant"),
        F.when(k % 113 != 0, F.col("o_orderdate")).alias("valid_from"), (F.col("o_orderdate") + F.expr("interval 90 days")).alias("valid_to"),
        F.when(k % 10 == 0, "SUPERSEDED").otherwise("ACTIVE").alias("status"), (F.lit(1) + k % 3).cast("int").alias("version"), k.alias("seq"),
    )


CLAIMS = """claims AS (SELECT 'claim_' || o_orderkey AS claim_id, 'customer:' || o_custkey AS subject_id,
  CASE WHEN o_orderkey % 101 = 0 THEN 'person' ELSE 'customer' END AS subject_type, CASE WHEN o_orderkey % 103 = 0 THEN 'order.unknown@1' ELSE 'order.priority@1' END AS predicate,
  o_orderpriority AS object_value, CASE WHEN o_orderkey % 7 = 0 THEN 'NEGATIVE' ELSE 'POSITIVE' END AS polarity, CASE WHEN o_orderkey % 107 = 0 THEN 'api' END AS component,
  CASE WHEN o_orderkey % 109 <> 0 THEN o_orderstatus END AS environment, CASE WHEN o_orderkey % 113 <> 0 THEN o_orderdate END AS valid_from, o_orderdate + INTERVAL 90 DAY AS valid_to,
  CASE WHEN o_orderkey % 10 = 0 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status, (1 + o_orderkey % 3)::INTEGER AS version, o_orderkey AS seq FROM orders)"""

FAMILIES = """families AS (SELECT *, 'sha256:' || sha256('["' || subject_id || '","' || predicate || '",' || coalesce('"' || environment || '"', 'null') || ',' || coalesce('"' || component || '"', 'null') || ',null,null]') AS family_key
  FROM claims WHERE predicate = 'order.priority@1')"""

PAIRS = """pairs AS (SELECT a.family_key, CASE WHEN a.object_value = b.object_value THEN 'POLARITY_CONFLICT' ELSE 'EXCLUSIVE_VALUE_CONFLICT' END AS kind, a.claim_id AS claim_a, b.claim_id AS claim_b, greatest(a.seq, b.seq) AS opened_seq
  FROM families a JOIN families b ON a.family_key = b.family_key AND a.claim_id < b.claim_id
  WHERE a.status = 'ACTIVE' AND b.status = 'ACTIVE' AND ((a.object_value = b.object_value AND a.polarity <> b.polarity) OR (a.object_value <> b.object_value AND a.polarity = 'POSITIVE' AND b.polarity = 'POSITIVE'))
    AND greatest(coalesce(a.valid_from, TIMESTAMP '0001-01-01'), coalesce(b.valid_from, TIMESTAMP '0001-01-01')) < least(a.valid_to, b.valid_to))"""

CONFLICTS = """since AS (SELECT family_key, kind, member, min(opened_seq) AS since FROM (SELECT family_key, kind, opened_seq, unnest([claim_a, claim_b]) AS member FROM pairs) GROUP BY ALL),
conflicts AS (SELECT 'conflict_' || substr(sha256(family_key || '|' || kind || '|sha256:' || sha256('["' || string_agg(member, '","' ORDER BY member) FILTER (WHERE since = first_seq) || '"]')), 1, 24) AS conflict_id,
  family_key, kind, list(member ORDER BY member) AS members, 'sha256:' || sha256('["' || string_agg(member, '","' ORDER BY member) || '"]') AS member_digest, min(since) AS opened_seq, 'OPEN' AS status, 1 AS episode
  FROM (SELECT *, min(since) OVER (PARTITION BY family_key, kind) AS first_seq FROM since) GROUP BY family_key, kind)"""


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents as immutable revisions."""
    docs = table(spark, d, "documents")
    return docs.select(F.concat(F.lit("revision_"), "doc_id").alias("revision_id"), F.concat(F.lit("document:"), "doc_id").alias("source_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), "doc_id", "source", "lang", "n_chars")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """One link from each claim to a line of a document, which one by the claim; some hashes are wrong, some ranges or sources impossible."""
    docs = table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("ls"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    n = docs.agg(F.count("*").alias("n"))
    k = F.col("o_orderkey")
    links = table(spark, d, "orders").select("o_orderkey").join(F.broadcast(n)).withColumn("doc_id", k % F.col("n")).join(docs, "doc_id").withColumn("i", (k % F.size("ls")).cast("int"))
    at = F.when(F.col("i") > 0, F.octet_length(F.array_join(F.slice("ls", F.lit(1), F.col("i")), "\n")) + 1).otherwise(0)
    links = links.select("o_orderkey", "doc_id", "size", at.cast("long").alias("at"), F.get("ls", F.col("i")).alias("line"))
    end = F.when(k % 17 == 0, F.col("size") + 1).otherwise(F.col("at") + F.octet_length("line"))
    code = F.when(k % 13 == 0, F.lit("sha256:bad")).otherwise(digest(F.col("line")))
    return links.where(k % 19 != 0).select(
        F.concat(F.lit("evidence_"), k).alias("evidence_id"), F.concat(F.lit("claim_"), k).alias("claim_id"), F.when(k % 23 == 0, F.lit("revision_none")).otherwise(F.concat(F.lit("revision_"), "doc_id")).alias("revision_id"),
        F.col("at").alias("start_byte"), end.cast("long").alias("end_byte"), code.alias("excerpt_hash"), F.when(k % 29 == 0, "INFERRED").otherwise("DIRECT").alias("interpretation"),
    )


EVIDENCE = """evidence AS (SELECT 'evidence_' || o_orderkey AS evidence_id, 'claim_' || o_orderkey AS claim_id, CASE WHEN o_orderkey % 23 = 0 THEN 'revision_none' ELSE 'revision_' || doc_id END AS revision_id,
  CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE strlen(ls[o_orderkey % len(ls) + 1]) END AS n_bytes, o_orderkey AS k,
  CASE WHEN o_orderkey % 29 = 0 THEN 'INFERRED' ELSE 'DIRECT' END AS interpretation
  FROM orders JOIN (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) ON doc_id = o_orderkey % (SELECT count(*) FROM documents) WHERE o_orderkey % 19 <> 0)"""


def resolutions(conflicts: DataFrame) -> DataFrame:
    """One attempted resolution per conflict: the first member wins; some cite a wrong digest, episode, partition or foreign evidence."""
    k = F.col("opened_seq")
    first, rest = F.slice("members", 1, 1), F.expr("slice(members, 2, size(members))")
    return conflicts.select(
        F.concat(F.lit("resolution_"), F.substring("conflict_id", 10, 24)).alias("resolution_id"), "conflict_id", F.when(k % 5 == 0, "sha256:old").otherwise(F.col("member_digest")).alias("member_digest"),
        F.when(k % 7 == 0, 2).otherwise(1).alias("episode"), first.alias("selected"), F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(rest).alias("rejected"),
        F.transform(F.when(k % 3 == 0, F.array(F.lit("claim_1"))).otherwise(first), lambda c: F.replace(c, F.lit("claim"), F.lit("evidence"))).alias("evidence_ids"),
    )
