"""Digests of many rows by levels of buckets, so that no task gets a whole list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tree_digest(rows: DataFrame, scope: list[str], key: str, value: str, digits: int = 4) -> DataFrame:
    """(scope, digest, rows): one hash of the values of each scope's rows, in order of key, through buckets of the key's hash.

    Buckets are named by the first `digits` hex digits of the key's SHA-256; two digits fewer with each level, up to one node. With four,
    a task sees a 65,536th of a scope's rows, or 256 nodes of the level below.
    """
    at = rows.select(*scope, F.sha2(F.col(key), 256).alias("b"), F.col(key).alias("k"), F.col(value).alias("h"), F.lit(1).cast("long").alias("rows"))
    for n in range(digits, -1, -2):
        node = F.substring("b", 1, n).alias("b") if n else F.lit("").alias("b")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "")
        at = at.select(*scope, node, "k", "h", "rows").groupBy(*scope, "b").agg(F.sha2(joined, 256).alias("h"), F.sum("rows").alias("rows"))
        at = at.withColumn("k", F.col("b"))
    return at.select(*scope, F.concat(F.lit("sha256:"), "h").alias("digest"), "rows")


#: Level of the rows themselves, whose bucket is the whole hash of their key.
ROWS = 64


def tree_nodes(rows: DataFrame, scope: list[str], key: str, value: str, digits: int = 4) -> DataFrame:
    """All nodes of `tree_digest`, to be kept: (scope, level, b, k, h, rows). level: hex digits of the bucket b, ROWS for the rows themselves; the root's is 0."""
    at = rows.select(*scope, F.lit(ROWS).alias("level"), F.sha2(F.col(key), 256).alias("b"), F.col(key).alias("k"), F.col(value).alias("h"), F.lit(1).cast("long").alias("rows"))
    every = at
    for n in range(digits, -1, -2):
        at = _parents(at, scope, n)
        every = every.unionByName(at)
    return every


def _parents(nodes: DataFrame, scope: list[str], n: int) -> DataFrame:
    """The nodes of level n above nodes of the level below: a hash over their hashes, in order."""
    node = F.substring("b", 1, n) if n else F.lit("")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "")
    up = nodes.groupBy(*scope, node.alias("p")).agg(F.sha2(joined, 256).alias("h"), F.sum("rows").alias("rows"))
    return up.select(*scope, F.lit(n).alias("level"), F.col("p").alias("b"), F.col("p").alias("k"), "h", "rows")


def changed_nodes(nodes: DataFrame, changes: DataFrame, scope: list[str], key: str, value: str, digits: int = 4) -> DataFrame:
    """New versions of the nodes that a few changed rows touch, rows included: only the nodes on their ways to the root are hashed again, from their kept children.

    nodes: a kept table of `tree_nodes`; changes: scope, key and the new value, null where the row goes; each key once. A node without rows left has a null h.
    """
    new = changes.select(*scope, F.lit(ROWS).alias("level"), F.sha2(F.col(key), 256).alias("b"), F.col(key).alias("k"), F.col(value).alias("h"), F.when(F.col(value).isNotNull(), 1).otherwise(0).cast("long").alias("rows"))
    every, below = new, ROWS
    for n in range(digits, -1, -2):
        parent = F.substring("b", 1, n) if n else F.lit("")
        touched = new.select(*scope, parent.alias("p")).distinct()
        kept = nodes.where(F.col("level") == below).withColumn("p", parent).join(touched, [*scope, "p"], "left_semi").drop("p")
        children = kept.join(new.select(*scope, "b", "k"), [*scope, "b", "k"], "left_anti").unionByName(new.where("h is not null"))
        up = _parents(children, scope, n)
        gone = touched.join(up.select(*scope, F.col("b").alias("p")), [*scope, "p"], "left_anti")
        new = up.unionByName(gone.select(*scope, F.lit(n).alias("level"), F.col("p").alias("b"), F.col("p").alias("k"), F.lit(None).cast("string").alias("h"), F.lit(0).cast("long").alias("rows")))
        every, below = every.unionByName(new), n
    return every


def with_changes(nodes: DataFrame, changed: DataFrame, scope: list[str]) -> DataFrame:
    """The kept table with the new versions in place of the old ones."""
    at = [*scope, "level", "b", "k"]
    return nodes.join(changed.select(*at), at, "left_anti").unionByName(changed.where("h is not null"))


def roots(nodes: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, digest, rows) of `tree_digest` from kept nodes."""
    return nodes.where("level = 0").select(*scope, F.concat(F.lit("sha256:"), "h").alias("digest"), "rows")
