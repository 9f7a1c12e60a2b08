"""Mixing sources to target weights by entropy balancing.

Documents get rates r = min(cap, exp(lambda_s * size / mean size of the source)): of all rates that give each
source its target of words, those closest to 1 in Kullback-Leibler distance. The lambdas solve the convex
dual; each Newton iteration is one distributed aggregation of the constraint and its slope per source, with
a bracket that keeps steps safe where the cap bends the dual. Rates are then rounded into whole copies.

Driver and broadcasts hold one row per source, never per document. Documents of a source meet only as
counts by size, so a source with a third of all rows is no larger than any other.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import words_column, written
from tallystone.operators.prefix import last_before

#: Constraints are summed in whole units of this part of a word, so that sums don't depend on their order.
UNIT = 1 << 16
#: Documents of one source that are rounded together.
BLOCK = 1000


def targets(sizes: list[tuple[str | None, int]], weights: list[float], cap: float) -> dict[str | None, float]:
    """A share of all words for each source: sources by code point, null last, with weights in turn.

    A target stops at cap times its source's size; the excess is shared again by weight until none is above.
    """
    names = sorted((n for n, _ in sizes if n is not None)) + [None] * any(n is None for n, _ in sizes)
    size, weight = dict(sizes), {n: weights[i % len(weights)] for i, n in enumerate(names)}
    out: dict[str | None, float] = {}
    left, open_ = float(sum(size.values())), [n for n in names if size[n] > 0]
    out |= {n: 0.0 for n in names if not size[n] > 0}
    while open_:
        total = sum(weight[n] for n in open_)
        over = [n for n in open_ if left * weight[n] / total > cap * size[n]]
        if not over:
            out |= {n: left * weight[n] / total for n in open_}
            break
        for n in over:
            out[n] = cap * size[n]
        left, open_ = left - sum(out[n] for n in over), [n for n in open_ if n not in over]
    return out


def _rate(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(lam * size / mean))


def solve(spark: SparkSession, histogram: DataFrame, want: dict, cap: float, tolerance: float = 1e-6, most: int = 60) -> dict:
    """lambda of each source, from counts (source, size, n). Sources without words, or with target 0, have none."""
    stats = {r["source"]: r for r in histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n")).collect()}
    state = {}
    for name, r in stats.items():
        if r["words"] and want.get(name, 0) > 0:
            state[name] = {"lam": math.log(min(cap, max(want[name] / r["words"], 1e-12))), "low": -math.inf, "high": math.inf, "mean": r["words"] / r["n"], "done": want[name] >= cap * r["words"] * (1 - 1e-12)}
            if state[name]["done"]:
                state[name]["lam"] = math.inf
    for _ in range(most):
        todo = [(n, s["lam"], s["mean"]) for n, s in state.items() if not s["done"]]
        if not todo:
            break
        now = spark.createDataFrame(todo, "source string, lam double, mean double")
        joined = histogram.join(F.broadcast(now), histogram["source"].eqNullSafe(now["source"])).select(now["source"], "size", "n", "lam", "mean")
        size, rate = F.col("size").cast("double"), _rate(F.col("lam"), F.col("size"), F.col("mean"), cap)
        slope = F.when(rate < cap, rate * size * size / F.col("mean")).otherwise(0.0)
        whole = lambda x: F.sum(F.round(x * F.col("n") * UNIT).cast("decimal(38,0)"))
        for r in joined.groupBy("source").agg(whole(rate * size).alias("value"), whole(slope).alias("slope")).collect():
            s, gap = state[r["source"]], float(r["value"]) / UNIT - want[r["source"]]
            if abs(gap) <= tolerance * want[r["source"]]:
                s["done"] = True
                continue
            s["low" if gap < 0 else "high"] = s["lam"]
            step = s["lam"] - gap / (float(r["slope"]) / UNIT) if r["slope"] else math.nan
            if not s["low"] < step < s["high"]:
                bounded = [x for x in (s["low"], s["high"]) if math.isfinite(x)]
                step = sum(bounded) / 2 if len(bounded) == 2 else bounded[0] + (1 if gap < 0 else -1) * max(1.0, abs(bounded[0]))
            s["lam"] = step
    return {n: (s["lam"], s["mean"]) for n, s in state.items()}


def _round_block(block: pd.DataFrame) -> pd.DataFrame:
    """Copies of documents whose words come as near to the rates' words as whole copies can.

    From the largest to the smallest document, each takes one copy more than its whole part if the words owed so
    far make up at least half of it; what is owed in the end is about half the smallest document.
    """
    block = block.sort_values(["size", "key"], ascending=[False, True], kind="stable")
    size, rate = block["size"].to_numpy(), block["rate"].to_numpy()
    base = np.floor(rate)
    owed, extra = 0.0, np.zeros(len(block), np.int64)
    for i, (s, f) in enumerate(zip(size.tolist(), (rate - base).tolist(), strict=True)):
        owed += s * f
        if f > 0 and s > 0 and 2 * owed >= s:
            extra[i], owed = 1, owed - s
    return pd.DataFrame({"rid": block["rid"], "copies": base.astype(np.int64) + extra})


def _numbered(docs: DataFrame, *more: Column) -> DataFrame:
    """Rows with a number of their own and what decides about them, and `more`; to be written once, as numbers hold for one reading only."""
    return docs.select(F.monotonically_increasing_id().alias("rid"), docs["doc_id"], docs["source"].alias("source"), F.size(words_column(docs["text"])).cast("long").alias("size"), F.xxhash64(docs["doc_id"], docs["text"]).alias("key"), *more)


def _spread_copies(rated: DataFrame) -> DataFrame:
    """rated, where more than a block of rows that are alike in source, id and text fill blocks of their own, BLOCK rows each."""
    alike = F.xxhash64("sh", "key")
    many = written(rated.groupBy(alike.alias("like")).count().where(F.col("count") > BLOCK).select("like"), "mix-copies")
    if many.limit(1).count() == 0:
        return rated
    told = rated.withColumn("like", alike).join(F.broadcast(many), "like", "left_semi").select("like", "rid")  # a BLOCK-th of the rows at most
    numbered = last_before(told, "like", "rid", F.lit(None).cast("long"), "none", "n").select("rid", F.xxhash64("like", F.floor((F.col("n") - 1) / BLOCK)).alias("own"))
    return rated.join(numbered, "rid", "left").withColumn("block", F.coalesce("own", "block")).drop("own")


def _copies(sized: DataFrame, weights: list[float] | None, cap: float) -> DataFrame:
    """(rid, doc_id, size, source_size, target, copies) of every numbered row."""
    weights = weights or [1.0, 2.0, 3.0]
    spark = sized.sparkSession
    histogram = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    totals = [(r["source"], int(r["words"]), r["n"]) for r in histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n")).collect()]
    want = targets([(n, w) for n, w, _ in totals], weights, cap)
    solved = solve(spark, histogram, want, cap)
    rows = [(n, w, want[n], *(solved.get(n, (-math.inf, 1.0))), max(1, math.ceil(k / BLOCK))) for n, w, k in totals]
    plan = F.broadcast(spark.createDataFrame(rows, "s string, source_size long, target double, lam double, mean double, blocks int"))
    joined = sized.join(plan, sized["source"].eqNullSafe(plan["s"]))
    lam = F.col("lam")
    rate = F.when(lam == math.inf, float(cap)).when(lam == -math.inf, 0.0).otherwise(F.round(_rate(lam, F.col("size"), F.col("mean"), cap), 9))
    rated = joined.select("rid", "key", "doc_id", "size", "source_size", "target", rate.alias("rate"), F.xxhash64("s").alias("sh"), F.pmod("key", "blocks").alias("block"))
    rated = _spread_copies(rated)
    copies = rated.select("rid", "key", "size", "rate", "sh", "block").groupBy("sh", "block").applyInPandas(_round_block, "rid long, copies long")
    return rated.select("rid", "doc_id", "size", "source_size", "target").join(copies, "rid")


def mix(docs: DataFrame, weights: list[float] | None = None, cap: float = 3.0) -> DataFrame:
    """(doc_id, size, source_size long, target double, copies long from 0 to cap) of every row of docs.

    Size counts words; a null text has none, and its copies are the whole part of its rate. A null
    source is a source of its own, the last. Rows that repeat a doc_id are documents of their own. Reruns over
    the same rows agree.
    """
    return _copies(written(_numbered(docs), "mix-sizes"), weights, cap).drop("rid")


def mixed(docs: DataFrame, weights: list[float] | None = None, cap: float = 3.0) -> DataFrame:
    """docs itself mixed: each row as often as its own copies say, whatever ids it shares, with its columns."""
    rows = written(_numbered(docs, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")), "mix-rows")
    taken = _copies(rows.drop("row"), weights, cap).where("copies > 0").select("rid", "copies")
    joined = rows.select("rid", "row").join(taken, "rid")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
