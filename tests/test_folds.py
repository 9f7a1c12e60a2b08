"""Folds over long and odd histories."""

import hashlib

from pyspark.sql import functions as F

from tallystone.functions.trees import tree_digest
from tallystone.operators import ledger
from tallystone.streaming import traces


def test_one_object_with_most_of_the_history(spark):
    n = 30_000
    e = spark.range(1, n + 1).selectExpr("if(id % 10 = 0, id % 7, -1) k", "id seq", "if(id = 29999 and id % 10 <> 0, null, concat('p', id)) payload")
    got = {r["seq"]: r for r in ledger.hash_chain_build(e, "k").collect()}
    assert len(got) == n
    heads = {}
    for i in range(1, n + 1):
        k = i % 7 if i % 10 == 0 else -1
        before = heads.get(k, ledger.GENESIS)
        assert got[i]["prev_hash"] == before
        heads[k] = hashlib.sha256(f"{before}|p{i}".encode()).hexdigest() if i != 29999 and before else None
        assert got[i]["entry_hash"] == heads[k]


def test_first_writer_wins_in_order_of_arrival(spark):
    rows = [("a", 3, "p3", 2), ("a", 1, "p1", 1), ("a", 2, "p2", 1), ("b", 1, "q1", 2), (None, 1, "r1", 1), (None, 2, "r2", 2), ("a", 4, "p4", None)]
    df = spark.createDataFrame(rows, "aggregate_id string, arrival long, proposal_id string, base_version long")
    got = {r["proposal_id"]: r["admitted"] for r in ledger.first_writer_wins(df).collect()}
    assert got == {"p1": True, "p2": False, "p3": True, "p4": False, "q1": False, "r1": True, "r2": True}
    assert ledger.first_writer_wins(df.where("arrival > 9")).count() == 0


def test_sessions_accept_sequences_in_order_of_arrival(spark):
    rows = [("s", i, i, q) for i, q in enumerate([2, 1, 1, 2, 4, 3, None, 4])]
    df = spark.createDataFrame(rows, "session_id string, arrival long, event_id long, sequence long").repartition(3)
    got = {r["event_id"]: r["accepted"] for r in traces.ordered_append_batch(df).collect()}
    assert [i for i, ok in sorted(got.items()) if ok] == [1, 3, 5, 7]


def test_digests_by_levels_follow_content_and_not_order(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("value"), (F.col("id") % 3).alias("s"))
    digest = lambda x: {r["s"]: (r["digest"], r["rows"]) for r in tree_digest(x, ["s"], "key", "value").collect()}
    first = digest(df)
    assert first == digest(df.orderBy(F.desc("key")).repartition(7)) and sum(n for _, n in first.values()) == 5000
    other = digest(df.withColumn("value", F.when(F.col("key") == "k7", "x").otherwise(F.col("value"))))
    assert [s for s in first if first[s] != other[s]] == [1]
    assert digest(df.where("s > 5")) == {}
