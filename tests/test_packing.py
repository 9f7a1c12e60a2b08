"""Packing over one shared order against packing of every candidate of every request."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tallystone.operators import context as X


def rows_of(seed):
    draw = random.Random(seed)
    shared = {("record", f"i{k:03}"): (draw.choice([3, 8, 15, 18, 30]), draw.choice([1, 5, 40, 100, 300])) for k in range(80)}
    requests = [(f"r{k}", draw.choice([40, 200, 900, 3000, 9000, 60_000]), draw.random() < 0.3) for k in range(8)]
    own = {}
    for name, _, plain in requests[:-1]:
        for _ in range(0 if plain else draw.randrange(25)):
            kind, at = draw.choice([("record", draw.randrange(80)), ("record", 100 + draw.randrange(9)), ("skill", draw.randrange(9)), ("scenario", draw.randrange(9))])
            key = (kind, f"i{at:03}")
            base, size = shared.get(key, (0, draw.choice([1, 5, 40, 100, 300])))
            must = draw.random() < 0.1
            own[name, *key] = (base + (10_000 if must else 0) + 10 * draw.randrange(0, 4), size, must)
    return shared, own, requests


def expected(shared, own, requests, skip):
    included, codes = set(), {}
    for name, budget, _ in requests:
        mine = {key[1:]: v for key, v in own.items() if key[0] == name}
        items = sorted(((-v[0], *key, v[1] + X.ENVELOPE, len(v) > 2 and v[2]) for key, v in ({k: v for k, v in shared.items() if k not in mine} | mine).items()), key=lambda r: r if skip else (not r[4], *r))
        must = sum(r[3] for r in items if r[4])
        left, code = budget, "CONTEXT_BUDGET_EXCEEDED" if not skip and must > budget else None
        for _, kind, id_, size, mandatory in items:
            if size <= left and not code:
                left -= size
                included.add((name, kind, id_))
            elif not skip:
                break
            elif mandatory:
                codes[name] = "CONTEXT_REFERENCE_EXCEEDS_BUDGET"
        codes.setdefault(name, code)
    return included, codes


@pytest.mark.parametrize(("seed", "head"), [(1, 4096), (2, 7), (3, 1), (4, 30)])
def test_shared_order_packs_what_full_lists_pack(spark, seed, head):
    shared, own, requests = rows_of(seed)
    base = spark.createDataFrame([(*k, *v) for k, v in shared.items()], "kind string, id string, score long, bytes long").repartition(3)
    mine = spark.createDataFrame([(*k, *v) for k, v in own.items()], "request_id string, kind string, id string, score long, bytes long, mandatory boolean").repartition(3)
    asked = spark.createDataFrame([r[:2] for r in requests], "request_id string, budget long")
    for skip in (True, False):
        included, told = X.pack_shared(base, mine, asked, skip, head)
        want, codes = expected(shared, own, requests, skip)
        got = [tuple(r) for r in included.collect()]
        assert set(got) == want and len(got) == len(want)
        assert {r["request_id"]: r["code"] for r in told.collect()} == codes
    counts = collections.defaultdict(lambda: [0, 0, []])
    for name, _, _ in requests:
        for kind, id_ in set(shared) | {k[1:] for k in own if k[0] == name}:
            ok = (name, kind, id_) in want
            counts[name, kind][not ok] += 1
            counts[name, kind][2] += [] if ok else [id_]
    report = X.report_shared(base, mine, included, asked)
    assert {(r["request_id"], r["section"]): (r["included"], r["omitted"], r["first_omitted"]) for r in report.collect()} == {k: (a, b, min(ids, default=None)) for k, (a, b, ids) in counts.items()}


def test_nothing_to_pack(spark):
    asked = spark.createDataFrame([("r", 100)], "request_id string, budget long")
    base = spark.createDataFrame([], "kind string, id string, score long, bytes long")
    mine = base.withColumn("request_id", F.lit("r")).withColumn("mandatory", F.lit(False))
    included, told = X.pack_shared(base, mine, asked, True)
    assert included.count() == 0 and [tuple(r) for r in told.collect()] == [("r", None)]
