"""Approximate nearest neighbours: a vantage-point tree per shard, with relaxed triangle-inequality pruning.

Vectors are dealt to the cells of their nearest top vantage points, at most CELLS vectors chosen by a hash of their ids; a cell of
many vectors is several shards. Each shard has a tree, stored as one row. Queries of a cell are packed into blocks. A block first
meets one shard of its own cell, which bounds the k-th distance of each query, and then only the shards of those cells that the
triangle inequality allows. A cell or a subtree is left out when the distance that this inequality guarantees, times `factor`,
exceeds the k-th distance found so far: with factor 1 the search is exact, larger factors leave out more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm.common import partitions, written

LEAF = 64
#: Top vantage points at most; the driver and each task hold these vectors, the size and the radii of their cells, and nothing else of the index.
CELLS = 1024
#: Distances are rounded: a bound by the triangle inequality is lowered by this share of the distances that it is made of.
SLACK = 1e-12


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0), F.lit(False))


def distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added in order."""
    gap = rows - point
    return np.sqrt(np.add.accumulate(gap * gap, axis=-1)[..., -1])


def build(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes): rows in tree order; each node is (from, to, inner end, radius, outer low), its vantage point first.

    Points are halved by rank of their distance, so equal vectors make no deeper tree. Children of node i
    cover (from + 1, inner end) and (inner end, to). Nodes are in pre-order; a leaf has inner end -1.
    """
    order, nodes = np.arange(len(vectors)), []
    stack = [(0, len(vectors))]
    while stack:
        low, high = stack.pop()
        if high - low <= LEAF:
            nodes.append((low, high, -1, 0.0, 0.0))
            continue
        part = order[low + 1 : high]
        far = distances(vectors[part], vectors[order[low]])
        rank = np.argsort(far, kind="stable")
        half = len(part) // 2
        order[low + 1 : high] = part[rank]
        nodes.append((low, high, low + 1 + half, far[rank[half - 1]], far[rank[half]]))
        stack += [(low + 1 + half, high), (low + 1, low + 1 + half)]
    return order, np.array(nodes, np.float64)


class Search:
    """The k nearest of one tree for a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, nodes: np.ndarray, k: int, factor: float):
        self.ids, self.vectors, self.k, self.factor = ids, vectors, k, factor
        self.nodes = {(int(a), int(b)): (int(c), r, o) for a, b, c, r, o in nodes}

    def run(self, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of each query, padded with infinity; rows farther than its bound may be left out."""
        n = len(queries)
        self.query_ids, self.queries, self.bounds = query_ids, queries, bounds
        self.best, self.best_id = np.full((n, self.k), np.inf), np.full((n, self.k), np.iinfo(np.int64).max)
        if len(self.ids):
            self.visit(0, len(self.ids), np.arange(n))
        return self.best, self.best_id

    def offer(self, at: np.ndarray, far: np.ndarray, ids: np.ndarray) -> None:
        far = np.where(ids[None, :] == self.query_ids[at][:, None], np.inf, far)
        all_far = np.concatenate([self.best[at], far], axis=1)
        all_ids = np.concatenate([self.best_id[at], np.broadcast_to(ids, far.shape)], axis=1)
        all_ids = np.where(np.isinf(all_far), np.iinfo(np.int64).max, all_ids)
        order = np.lexsort((all_ids, all_far), axis=-1)[:, : self.k]
        self.best[at] = np.take_along_axis(all_far, order, axis=1)
        self.best_id[at] = np.take_along_axis(all_ids, order, axis=1)

    def visit(self, low: int, high: int, at: np.ndarray) -> None:
        if not len(at) or low >= high:
            return
        inner, radius, outer = self.nodes[(low, high)]
        if inner < 0:
            for part in np.array_split(at, max(1, len(at) // 256)):
                self.offer(part, distances(self.vectors[None, low:high, :], self.queries[part][:, None, :]), self.ids[low:high])
            return
        far = distances(self.queries[at], self.vectors[low])
        self.offer(at, far[:, None], self.ids[low : low + 1])
        near = far <= (radius + outer) / 2
        for inside in (True, False):
            first = near == inside
            for child_inside in (inside, not inside):
                least = far - radius if child_inside else outer - far
                edge = radius if child_inside else outer
                go = first & ~((least - SLACK * (far + edge)) * self.factor > np.minimum(self.best[at][:, -1], self.bounds[at]))
                self.visit(*((low + 1, inner) if child_inside else (inner, high)), at[go])


def _pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array, np.float64).tobytes()


def vantage_points(rows: DataFrame, most: int) -> np.ndarray:
    """Up to `most` distinct vectors, from the 4 * most rows whose ids have the smallest hashes."""
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(4 * most).select("v").collect()
    seen = dict.fromkeys(tuple(r["v"]) for r in chosen)
    return np.array(list(seen)[:most], np.float64)


def in_cells(rows: DataFrame, points, dim: int) -> DataFrame:
    """Rows with cell, the nearest vantage point, and far, the distance from it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = points.value
        with np.errstate(over="ignore", invalid="ignore"):
            half = (at * at).sum(1) / 2
            for batch in batches:
                v = np.asarray(batch.column("v").flatten()).reshape(-1, dim)
                cell = np.argmin(half - v @ at.T, axis=1) if len(v) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(distances(v, at[cell]), pa.float64())], [*batch.schema.names, "cell", "far"])

    return rows.mapInArrow(assign, "vec_id long, v array<double>, cell int, far double")


def with_part(rows: DataFrame, sizes: dict[int, int], most: int, seed: Column) -> DataFrame:
    """Rows with part: each cell is split by hash into as many parts as hold `most` rows."""
    if not sizes:
        return rows.withColumn("part", F.lit(0))
    parts = F.create_map(*(F.lit(x) for c, n in sizes.items() for x in (c, math.ceil(n / most))))
    return rows.withColumn("part", F.pmod(F.xxhash64(seed), parts[F.col("cell")]).cast("int"))


def index(rows: DataFrame, sizes: dict[int, int], shard_rows: int) -> DataFrame:
    """One tree for each shard: (cell, part, block, a, b, c), where block is -1 and a, b, c are ids, vectors and nodes. Every row is in exactly one."""

    def tree(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id", kind="stable")
        ids, vectors = part["vec_id"].to_numpy(np.int64), np.stack(part["v"].to_numpy()).astype(np.float64)
        order, nodes = build(vectors)
        return pd.DataFrame({"cell": [part["cell"].iloc[0]], "part": [part["part"].iloc[0]], "block": [-1], "a": [ids[order].tobytes()], "b": [_pack(vectors[order])], "c": [_pack(nodes)]})

    dealt = with_part(rows, sizes, shard_rows, F.col("rid")).select("cell", "part", "vec_id", "v")
    return written(dealt.groupBy("cell", "part").applyInPandas(tree, SHARD), "vp-trees")


#: A shard's tree (ids, vectors, nodes), or a block of queries that asks it (ids, vectors, bounds).
SHARD = "cell int, part int, block long, a binary, b binary, c binary"


def meet(trees: DataFrame, asked: DataFrame, salts: int, k: int, factor: float, block: int, dim: int) -> DataFrame:
    """(cell, part, block, a, b, c, near, near_ids): the k nearest in its shard for each query of a block; blocks of a shard are joined up to `block` queries.

    A shard's rows are sorted, its tree first, and stream by: a task holds one tree and one block. Shards that very many blocks ask
    have copies, one for each salt.
    """
    copies = trees.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = copies.unionByName(asked.withColumn("salt", F.pmod(F.col("block"), F.lit(salts)).cast("int")))
    dealt = rows.repartition(partitions(trees.sparkSession), "cell", "part", "salt").sortWithinPartitions("cell", "part", "salt", "block")

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, waiting, count = None, [], 0

        def answer() -> pd.DataFrame:
            ids, queries, bounds = (np.concatenate([np.frombuffer(getattr(r, c), t) for r in waiting]) for c, t in (("a", np.int64), ("b", np.float64), ("c", np.float64)))
            first = waiting[0]
            # a shard that no row was dealt to has no tree
            a, b, c = (tree.a, tree.b, tree.c) if tree is not None and (tree.cell, tree.part) == (first.cell, first.part) else (b"", b"", b"")
            search = Search(np.frombuffer(a, np.int64), np.frombuffer(b, np.float64).reshape(-1, dim), np.frombuffer(c, np.float64).reshape(-1, 5), k, factor)
            near, near_ids = search.run(ids, queries.reshape(-1, dim), bounds)
            return pd.DataFrame({"cell": [first.cell], "part": [first.part], "block": [first.block], "a": [ids.tobytes()], "b": [_pack(queries)], "c": [_pack(near[:, -1])], "near": [_pack(near)], "near_ids": [near_ids.tobytes()]})

        for batch in batches:
            for r in batch.itertuples():
                if waiting and (r.block < 0 or count >= block or (r.cell, r.part) != (waiting[0].cell, waiting[0].part)):
                    yield answer()
                    waiting, count = [], 0
                if r.block < 0:
                    tree = r
                else:
                    waiting.append(r)
                    count += len(r.a) // 8
        if waiting:
            yield answer()

    return dealt.mapInPandas(found, SHARD + ", near binary, near_ids binary")


def pairs(met: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of what blocks found."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                near, ids = np.frombuffer(r.near, np.float64), np.frombuffer(r.near_ids, np.int64)
                real = np.isfinite(near)
                yield pd.DataFrame({"query_id": np.repeat(np.frombuffer(r.a, np.int64), k)[real], "vec_id": ids[real], "score": near[real]})

    return met.select("a", "near", "near_ids").mapInPandas(unpack, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 10, factor: float = 1.0, block: int = 512, shard_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query row, itself aside, nearest first, ties to smaller ids.

    vectors: vec_id, embedding. Rows whose vector is null, empty, zero or not finite, or whose id is null, take no part, as queries or
    candidates; vectors of another length than the query's are no candidates of it. Rows that repeat an id are
    candidates each, but never of that same id; as queries they count once, by their smallest vector of a length.
    """
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    rows = written(rows.withColumn("dim", F.size("v")), "vectors")
    out = None
    for dim in sorted(r["dim"] for r in rows.select("dim").distinct().collect()):
        found = _search(rows.where(F.col("dim") == dim).select("vec_id", "v"), is_query, k, factor, block, shard_rows, dim)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out


def _search(rows: DataFrame, is_query: Column, k: int, factor: float, block: int, shard_rows: int, dim: int) -> DataFrame:
    spark = rows.sparkSession
    points = spark.sparkContext.broadcast(vantage_points(rows, min(CELLS, math.ceil(rows.count() / shard_rows))))
    # the id is written once, so shards are the same whenever a task runs again
    placed = written(in_cells(rows, points, dim).withColumn("rid", F.monotonically_increasing_id()), "cells")
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()}
    trees = index(placed, {c: r["n"] for c, r in cells.items()}, shard_rows)
    known = np.array(sorted(cells), np.int64)
    low, high, size = (np.array([cells[c][name] for c in known], np.float64) for name in ("low", "high", "n"))

    # a query's first shard is one of its own cell
    queries = written(in_cells(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), points, dim), "queries")
    asking = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    blocks = sum(math.ceil(n / block) for n in asking.values())
    salts = max(1, math.ceil(blocks / 256))

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(part["v"].to_numpy())
        return pd.DataFrame({"cell": [part["cell"].iloc[0]], "part": [0], "block": [part["part"].iloc[0]], "a": [part["vec_id"].to_numpy(np.int64).tobytes()], "b": [_pack(v)], "c": [_pack(np.full(len(v), np.inf))]})

    own = with_part(queries, asking, block, F.col("vec_id")).groupBy("cell", "part").applyInPandas(packed, SHARD)
    first = written(meet(trees, own, max(1, math.ceil(max(asking.values(), default=0) / block / 256)), k, factor, block, dim), "first-shards")

    def allowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = points.value[known]
        for batch in batches:
            for r in batch.itertuples():
                ids, asked, bounds = np.frombuffer(r.a, np.int64), np.frombuffer(r.b, np.float64).reshape(-1, dim), np.frombuffer(r.c, np.float64)
                for i, cell in enumerate(known):
                    far = distances(asked, at[i])
                    least = np.maximum(far - high[i], low[i] - far) - SLACK * (far + high[i])
                    go = ~(least * factor > bounds)
                    if go.any():
                        parts = math.ceil(size[i] / shard_rows)
                        yield pd.DataFrame({"home": [r.cell], "cell": [cell], "parts": [parts], "block": [r.block * CELLS + r.cell], "a": [ids[go].tobytes()], "b": [_pack(asked[go])], "c": [_pack(bounds[go])]})

    visits = first.select("cell", "block", "a", "b", "c").mapInPandas(allowed, "home int, cell int, parts int, block long, a binary, b binary, c binary")
    visits = visits.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).where("not (home = cell and part = 0)").select("cell", "part", "block", "a", "b", "c")
    near = pairs(first, k).unionByName(pairs(meet(trees, visits, salts, k, factor, block, dim), k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
