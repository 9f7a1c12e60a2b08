"""Conflicts without pairs against those of the pairs, and numbering in parallel."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from tallystone.operators import claims, intervals, ledger, prefix
from tallystone.plans.derive import registry

SCHEMA = """claim_id string, subject_id string, subject_type string, predicate string, object_kind string, object_value string, object_type string, polarity string, component string,
    environment string, region string, tenant string, valid_from timestamp, valid_to timestamp, status string, version int, seq long"""
START = datetime.datetime(2024, 1, 1)


def day(n):
    return None if n is None else START + datetime.timedelta(days=n)


def claim(k, draw, subjects, objects, days=400):
    low = draw.choice([None] + [draw.randrange(days)] * 8)
    high = draw.choice([None] + [(low or 0) + draw.randrange(-1, 60)] * 8)
    predicate = draw.choice(["order.priority@1"] * 3 + ["order.supplier@1"])
    return (f"c{k:06}", f"customer:{draw.randrange(subjects)}", "customer", predicate, "enum", draw.choice([*objects, None]), None, draw.choice(["POSITIVE"] * 4 + ["NEGATIVE", None]), None, "F", None, None, day(low), day(high), draw.choice(["ACTIVE"] * 5 + ["RETRACTED"]), 1, draw.randrange(50) if k % 2 else k)


@pytest.mark.parametrize(("seed", "paired"), [(1, 0), (2, 3), (3, 64)])
def test_members_are_those_of_the_pairs(spark, seed, paired):
    draw = random.Random(seed)
    df = spark.createDataFrame([claim(k, draw, 12, ["1-URGENT", "2-HIGH", "3-MEDIUM", "supplier:1"]) for k in range(400)], SCHEMA).repartition(3)
    rules = registry(spark)
    rows = lambda x: sorted(map(repr, (tuple(r) for r in x.collect())))
    want = rows(claims.episodes_of_pairs(claims.conflict_pairs(df, rules)))
    assert rows(claims.conflict_episodes(df, rules, paired)) == want and len(want) > 5


def test_a_large_family_costs_its_members(spark):
    """A family of so many claims has a hundred million pairs."""
    draw = random.Random(4)
    rows = [claim(k, draw, 1, ["1-URGENT", "2-HIGH"], 3000) for k in range(20_000)]
    began = time.time()
    found = claims.conflict_members(spark.createDataFrame(rows, SCHEMA).repartition(4), registry(spark)).count()
    assert found > 5_000 and time.time() - began < 240


def test_least_of_others_of_small_cases(spark):
    rows = [("g", "a", "x", 0, 10, 5), ("g", "b", "y", 10, 20, 1), ("g", "c", "y", 9, 11, 7), ("g", "d", "x", None, None, 9), ("g", "e", "z", 5, 5, 0), ("h", "f", "x", 0, 10, 3), ("g", "g", None, 0, 99, 0)]
    df = spark.createDataFrame(rows, "k string, item string, color string, low int, high int, value long")
    got = {r["item"]: r["least"] for r in intervals.least_of_others(df, ["k"], "item", "color", "low", "high", "value").collect()}
    assert got == {"a": 7, "b": 9, "c": 5, "d": 1}
    assert intervals.least_of_others(df.where("value > 99"), ["k"], "item", "color", "low", "high", "value").count() == 0


def test_places_in_one_long_order(spark):
    values = random.Random(5).sample(range(100_000), 3_000)
    df = spark.createDataFrame([(v, str(v)) for v in values], "v int, name string").repartition(5)
    assert [(r["place"], r["v"]) for r in prefix.numbered(df, ["v"], "place").orderBy("place").collect()] == list(enumerate(sorted(values)))
    assert prefix.numbered(df.where("v < 0"), ["v"], "place").count() == 0


@pytest.mark.parametrize("keys", [1, 30])
def test_looking_back_over_ranges(spark, keys):
    draw = random.Random(keys)
    rows = [(draw.choice([None, *range(keys)]), k, draw.choice([None, "a", "b"])) for k in range(2_000)]
    df = spark.createDataFrame(rows, "k int, at long, v string").repartition(5)
    told = prefix.last_before(df, "k", "at", F.col("v"), "prior", "n")
    assert told.columns == ["k", "at", "v", "prior", "n"]
    got = {r["at"]: (r["prior"], r["n"]) for r in told.collect()}
    last, n, want = {}, {}, {}
    for k, at, v in rows:
        n[k] = n.get(k, 0) + 1
        want[at] = last.get(k), n[k]
        last[k] = v if v is not None else last.get(k)
    assert got == want


def test_one_long_log_is_checked_by_all_tasks(spark):
    """Rejected receipts of one log keep its head; every eighth doesn't."""
    head = lambda k: F.concat(F.lit("h"), F.floor(k / 10).cast("string"))
    k = F.col("id")
    receipts = spark.range(100_000).select(F.lit("log").alias("log"), k.alias("receipt_id"), F.when(k % 10 == 0, "COMMITTED").otherwise("VALIDATION_ERROR").alias("outcome"), F.when(k % 8 == 3, "x").otherwise(head(k)).alias("head_before"), head(k).alias("head_after"))
    assert ledger.rejected_head_check(receipts, "log").count() == sum(i % 8 == 3 and i % 10 != 0 for i in range(100_000))
    told = prefix.last_before(receipts, "log", "receipt_id", F.col("head_after"), "prior")
    assert max(r["count"] for r in told.groupBy(F.spark_partition_id()).count().collect()) < 60_000


def test_history_index_walks_json(spark):
    docs = [
        '{ "claim_id" : "c1", "deep": [ {"a": {"object_id": "o\\u00e91"}}, ["x", {"id": "i1"}] ], "id": 7, "evidence_ids": ["no"], "identity": "no" }',
        '{"versions": {"id": "hidden", "deep": {"claim_id": "hidden"}}, "next": {"versions": [{"id": "hidden"}], "x_id": "say \\"id\\":\\"no\\""}, "id": null}',
        "not json", None, "[]", '"id"', '[{"id": "i1"}, {"id": "i1"}, {"id": ""}]',
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "seq int, document string")
    got = sorted((r["seq"], r["object_id"]) for r in ledger.history_index(df).collect())
    assert got == [(0, "c1"), (0, "i1"), (0, "oé1"), (1, 'say "id":"no"'), (6, ""), (6, "i1")]
    assert ledger.history_index(df.where("seq > 99")).count() == 0
