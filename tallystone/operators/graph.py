"""Symbols and dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.canon import short_id
from tallystone.sources.scratch import written

DEFINITION = r"^([ \t]*)(class|def)\s+([A-Za-z_]\w*)"


def symbols(lines: DataFrame) -> DataFrame:
    """(symbol_id, path, kind, name, qualified_name, start_line, end_line): a MODULE per file, classes, functions and methods, by lines.

    lines: path, line_no (from 1), line. Approximate by design: a definition is a line that starts one; an indented def after an unindented class is its
    method; a definition ends before the next one that is not deeper, else with the file.
    """
    d = lines.withColumn("word", F.regexp_extract("line", DEFINITION, 2)).where("word <> ''")
    d = d.select("path", "line_no", "word", F.regexp_extract("line", DEFINITION, 3).alias("name"), F.length(F.regexp_extract("line", DEFINITION, 1)).alias("indent"))
    order = Window.partitionBy("path").orderBy("line_no")
    top = F.last(F.when(F.col("indent") == 0, F.struct("word", "name")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = order.rowsBetween(1, Window.unboundedFollowing)
    size = lines.groupBy("path").agg(F.max("line_no").alias("size"))
    j = d.withColumn("top", top).withColumn("next_top", F.min(F.when(F.col("indent") == 0, F.col("line_no"))).over(later)).withColumn("next_any", F.lead("line_no").over(order)).join(size, "path")
    method = (F.col("indent") > 0) & (F.col("top.word") == "class")
    end = F.coalesce(F.when(F.col("indent") == 0, F.col("next_top")).otherwise(F.col("next_any")) - 1, F.col("size"))
    kind = F.when(F.col("word") == "class", "CLASS").when(F.coalesce(method, F.lit(False)), "METHOD").otherwise("FUNCTION")
    found = j.select("path", kind.alias("kind"), "name", F.when(F.coalesce(method, F.lit(False)), F.concat_ws(".", "top.name", "name")).otherwise(F.col("name")).alias("qualified_name"), F.col("line_no").alias("start_line"), end.alias("end_line"))
    modules = size.select("path", F.lit("MODULE").alias("kind"), F.col("path").alias("name"), F.col("path").alias("qualified_name"), F.lit(1).alias("start_line"), F.col("size").alias("end_line"))
    whole = modules.unionByName(found)
    return whole.select(short_id("symbol_", F.concat_ws("|", "path", "qualified_name", "start_line")).alias("symbol_id"), "*")


def resolve_edges(symbols: DataFrame, mentions: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_kind): names resolve to the smallest symbol id; CALLS first, REFERENCES unless to itself or already a call. mentions: source_id, name, is_call."""
    first = symbols.groupBy("name").agg(F.min("symbol_id").alias("target_id"))
    e = mentions.join(first, "name").select("source_id", "target_id", "is_call")
    calls = e.where("is_call").select("source_id", "target_id").distinct()
    refs = e.where("not is_call and source_id <> target_id").select("source_id", "target_id").distinct().join(calls, ["source_id", "target_id"], "left_anti")
    return calls.withColumn("edge_kind", F.lit("CALLS")).unionByName(refs.withColumn("edge_kind", F.lit("REFERENCES")))


def known_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with both ends among the symbols."""
    at = lambda side: symbols.select(F.col("symbol_id").alias(side))
    return edges.join(at("source_id"), "source_id", "left_semi").join(at("target_id"), "target_id", "left_semi")


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """(u, w): which steps the edges allow."""
    forward = edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("w"))
    reverse = edges.select(F.col("target_id").alias("u"), F.col("source_id").alias("w"))
    return {"FORWARD": forward, "REVERSE": reverse, "BOTH": forward.union(reverse)}[direction].distinct()


def impact(edges: DataFrame, start: DataFrame, max_depth: int = 4, direction: str = "BOTH") -> DataFrame:
    """(start_id, object_id, depth, via): what each start (object_id) reaches within max_depth steps, breadth first; via is the smallest predecessor.

    Each step joins the frontier with the edges and leaves out what is visited; frontiers are written, so plans stay short. Steps: 1 to 16.
    """
    if not 1 <= max_depth <= 16 or direction not in ("FORWARD", "REVERSE", "BOTH"):
        raise ValueError("max_depth must be 1..16, direction FORWARD, REVERSE or BOTH")
    steps = _steps(edges, direction)
    visited = written(start.select(F.col("object_id").alias("start_id"), "object_id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")).distinct(), "impact")
    frontier = visited
    for depth in range(1, max_depth + 1):
        near = frontier.join(steps, F.col("object_id") == F.col("u")).groupBy("start_id", F.col("w").alias("object_id")).agg(F.min("u").alias("via"))
        frontier = written(near.join(visited.select("start_id", "object_id"), ["start_id", "object_id"], "left_anti").select("start_id", "object_id", F.lit(depth).alias("depth"), "via"), "impact")
        if frontier.limit(1).count() == 0:
            break
        visited = visited.union(frontier)
    return visited.where("depth > 0")


def impact_steps(edges: DataFrame, start: DataFrame, reached: DataFrame, max_depth: int = 4, direction: str = "BOTH") -> DataFrame:
    """The steps that an impact result (reached) walks: (start_id, u, w, depth), from each node nearer than max_depth, also back to visited nodes; depth is that of w on this path."""
    own = start.select(F.col("object_id").alias("start_id"), F.col("object_id").alias("u"), F.lit(0).alias("depth")).distinct()
    nodes = own.union(reached.select("start_id", F.col("object_id").alias("u"), "depth")).where(F.col("depth") < max_depth)
    return nodes.join(_steps(edges, direction), "u").select("start_id", "u", "w", (F.col("depth") + 1).alias("depth"))


def induced_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """The edges of an impact result among what a start and its reached objects are: (start_id, source_id, target_id, edge_kind)."""
    nodes = reached.select("start_id", "object_id").union(reached.select("start_id", F.col("start_id").alias("object_id"))).distinct()
    a = edges.join(nodes.withColumnRenamed("object_id", "source_id"), "source_id")
    return a.join(nodes.withColumnRenamed("object_id", "target_id"), ["start_id", "target_id"], "left_semi").select("start_id", "source_id", "target_id", "edge_kind")
