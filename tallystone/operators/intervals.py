"""Overlapping intervals without pairs: for each interval what its partners' least value is.

Ends become ranks in one order. An interval is the union of few dyadic nodes (its cover), and an instant lies in one node of each size (its line). Two intervals
overlap if one begins within the other: if the line of a beginning meets the other's cover. So every interval leaves its value at the nodes of its
cover and of its beginning's line, values are summed up by node, and every interval asks the nodes of its line and its cover. Each costs a logarithm
of the number of instants in rows, however many partners it has, and a large group is dealt to tasks by nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.operators.prefix import numbered
from tallystone.sources.scratch import written


def _line(at: Column, levels: Column) -> Column:
    return F.transform(levels, lambda v: F.struct(v.alias("level"), F.call_function("shiftright", at, v).alias("node")))


def _cover(low: Column, high: Column, levels: Column) -> Column:
    """The largest nodes that make up [low, high): at each level at most one at either end."""

    def at(v: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), v)
        l, r = F.call_function("shiftright", low + size - 1, v), F.call_function("shiftright", high, v)
        node = lambda n: F.struct(v.alias("level"), n.alias("node"))
        return F.array(F.when((l < r) & (l % 2 == 1), node(l)), F.when((l < r) & (r % 2 == 1), node(r - 1)))

    return F.array_compact(F.flatten(F.transform(levels, at)))


def least_of_others(rows: DataFrame, group: list[str], item: str, color: str, low: str, high: str, value: str) -> DataFrame:
    """(group, item, least): the least value of a row of the same group and another color whose interval [low, high) overlaps, for rows that have such. A null end is unbounded; empty intervals overlap nothing."""
    rows = written(rows.select(*group, F.col(item).alias("item"), F.col(color).alias("color"), F.col(low).alias("low"), F.col(high).alias("high"), F.col(value).alias("value")).where("color is not null and (low is null or high is null or low < high)"), "intervals")
    ends = reduce(DataFrame.union, [rows.select(F.col(c).alias("end")) for c in ("low", "high")]).where("end is not null").distinct()
    ranks = written(numbered(ends, ["end"], "rank"), "interval-ends")
    most = ranks.count() + 1
    levels = F.sequence(F.lit(0), F.lit(most.bit_length()))
    rank = lambda c: ranks.select(F.col("end").alias(c), (F.col("rank") + 1).alias(f"{c}_at"))
    placed = rows.join(rank("low"), "low", "left").join(rank("high"), "high", "left")
    placed = placed.select(*group, "item", "color", "value", F.coalesce("low_at", F.lit(0)).cast("long").alias("l"), F.coalesce("high_at", F.lit(most)).cast("long").alias("h"))
    placed = written(placed.withColumns({"line": _line(F.col("l"), levels), "cover": _cover(F.col("l"), F.col("h"), levels)}), "interval-nodes")

    def at(nodes: str, side: str) -> DataFrame:
        return placed.select(*group, F.lit(side).alias("side"), F.explode(nodes).alias("n"), "item", "color", "value").select(*group, "side", "n.level", "n.node", "item", "color", "value")

    place = [*group, "side", "level", "node"]
    left = at("cover", "cover").unionByName(at("line", "line")).groupBy(*place, "color").agg(F.min("value").alias("value"))
    left = written(left, "interval-left")
    # the least value of a node, and the least of all colors but that value's
    first = left.groupBy(*place).agg(F.min(F.struct("value", "color")).alias("first"))
    second = left.join(first, place).where(F.col("color") != F.col("first.color")).groupBy(*place).agg(F.min("value").alias("second"))
    told = first.join(second, place, "left")
    asked = at("line", "cover").unionByName(at("cover", "line")).join(told, place)
    least = F.when(F.col("color") != F.col("first.color"), F.col("first.value")).otherwise(F.col("second"))
    return asked.groupBy(*group, "item").agg(F.min(least).alias("least")).where("least is not null").withColumnRenamed("item", item)
