"""Kept nodes of digests against digests made anew."""

import hashlib

from pyspark.sql import functions as F

from tallystone.functions import trees


def table(spark, rows):
    return spark.createDataFrame(rows, "scope string, key string, value string").repartition(3)


def digests(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_changed_row_hashes_its_own_way_to_the_root_again(spark, tmp_path):
    rows = [(f"s{k % 2}", f"k{k}", hashlib.sha256(b"%d" % k).hexdigest()) for k in range(800)] + [("lone", "k", "v")]
    path = str(tmp_path / "nodes")
    trees.tree_nodes(table(spark, rows), ["scope"], "key", "value").write.parquet(path)
    nodes = spark.read.parquet(path)
    assert digests(trees.roots(nodes, ["scope"])) == digests(trees.tree_digest(table(spark, rows), ["scope"], "key", "value"))

    one = trees.changed_nodes(nodes, table(spark, [("s1", "k7", "new")]), ["scope"], "key", "value")
    assert sorted(r["level"] for r in one.collect()) == [0, 2, 4, trees.ROWS]

    changes = [("s1", "k7", "new"), ("s0", "k8", None), ("s0", "added", "x"), ("lone", "k", None), ("fresh", "k", "v"), ("s1", "never there", None)]
    changed = trees.changed_nodes(nodes, table(spark, changes), ["scope"], "key", "value")
    kept = trees.with_changes(nodes, changed, ["scope"])
    now = {(s, k): v for s, k, v in rows} | {(s, k): v for s, k, v in changes}
    want = trees.tree_digest(table(spark, [(*sk, v) for sk, v in now.items() if v is not None]), ["scope"], "key", "value")
    assert digests(trees.roots(kept, ["scope"])) == digests(want)
    # what is kept is what would have been made anew, so it can be changed again
    anew = trees.tree_nodes(table(spark, [(*sk, v) for sk, v in now.items() if v is not None]), ["scope"], "key", "value")
    assert digests(kept.select(*anew.columns)) == digests(anew)
    assert kept.where(F.col("h").isNull()).count() == 0
