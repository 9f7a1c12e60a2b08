"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is a set of word shingles, weighted by how often each occurs. Darts fall on the plane (weight, rank) of each shingle, one per
unit area on average, at places that only the shingle decides; a dart counts if it lands below the shingle's
weight. The darts of least rank per coordinate are the signature: two documents agree in a coordinate with
probability equal to their weighted Jaccard similarity. Throwing stops at a rank that leaves about
k ln k + 3k darts in all, so a signature costs no more for short documents than for long ones.

Bands of coordinates meet in joins. Per bucket one member, the centre, is compared with the others, by exact
weighted Jaccard similarity: the sum of the smaller weights over that of the larger ones. Buckets that then lie within one class are done, as are centres; after `turns` such
steps what is left is compared block against block, in tasks that return only links between classes not yet joined. So no bucket is capped and no group is expanded into all its pairs. Copies with equal weighted sets are one
representative from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import BROADCAST_ROWS, FEW_ROWS, mix, owners, rolling, slices, split_words, spread_join, word_hashes, written

BANDS, ROWS = 40, 6
#: Members of a bucket that are compared at once.
BLOCK = 512
#: What a row is told by: a number of its own, its id, a hash of its text.
ROW = ["rid", "doc_id", "text_hash"]
#: Poisson(1) distribution function: how many darts a unit cell has.
_DARTS = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320], float))
_UNIT = 2.0**-53


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * _UNIT


def throw(elements: np.ndarray, weights: np.ndarray, low: int, high: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts (coordinate, rank, id) of the elements with low <= rank < high that land below the weights."""
    layers = np.ceil(weights).astype(np.int64)
    which = np.repeat(np.arange(len(elements)), layers)
    layer = np.arange(len(which)) - np.repeat(np.cumsum(layers) - layers, layers)
    ranks = np.arange(low, high, dtype=np.uint64)
    seed = mix(elements[which] + layer.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    cell = mix(seed[:, None] ^ mix(ranks * np.uint64(0xD1342543DE82EF95) + np.uint64(1))[None, :]).ravel()
    count = np.searchsorted(_DARTS, _uniform(cell), side="right")
    at = np.repeat(np.arange(len(cell)), count)
    turn = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    dart = mix(cell[at] + (turn.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
    rank = low + at % len(ranks) + _uniform(mix(dart ^ np.uint64(0x1F83D9ABFB41BD6B)))
    of = at // len(ranks)
    height = layer[of] + _uniform(mix(dart ^ np.uint64(0x5BE0CD19137E2179)))
    hit = height < weights[which[of]]
    dart = dart[hit]
    return (dart % np.uint64(k)).astype(np.int64), rank[hit], dart


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The dart of least rank of each of k coordinates; ranks beyond the first throw only for coordinates still without one."""
    out, missing = np.zeros(k, np.uint64), np.ones(k, bool)
    low, high = 0, int(np.ceil(k * (np.log(k) + 3) / weights.sum()))
    while missing.any():
        coordinate, rank, dart = throw(elements, weights, low, high, k)
        order = np.flatnonzero(missing[coordinate])
        order = order[np.argsort(-rank[order], kind="stable")]
        out[coordinate[order]] = dart[order]
        missing[coordinate] = False
        low, high = high, 2 * high
    return out


def _elements(batch: pa.RecordBatch, n: int, weight: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """The shingles of each text with their weights: counts, or 1 each. A text too short for one is a single element, unless it has no words."""
    flat, offsets = split_words(batch.column("text"))
    hashes, owner = word_hashes(flat), owners(offsets)
    grams = rolling(hashes, n)
    valid = owner[: len(grams)] == owner[n - 1 :] if len(grams) else np.zeros(0, bool)
    of, grams = owner[: len(grams)][valid], grams[valid]
    at = np.searchsorted(of, np.arange(batch.num_rows + 1))
    out = []
    for i in range(batch.num_rows):
        own = grams[at[i] : at[i + 1]]
        if not len(own) and offsets[i + 1] > offsets[i]:
            words = mix(hashes[offsets[i] : offsets[i + 1]])
            own = mix((words * (np.arange(len(words), dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)))
        elements, counts = np.unique(own, return_counts=True)
        out.append((elements, counts if weight == "count" else np.ones_like(counts)))
    return out


def _prints(elements: np.ndarray, weights: np.ndarray) -> list[np.uint64]:
    """128 bits that tell a weighted set."""
    return [(mix(elements + np.uint64(salt)) * weights.astype(np.uint64)).sum(dtype=np.uint64) for salt in (1, 7)]


def _sign(n: int, bands: int, rows: int, weight: str):
    k = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sizes, keys, prints = [], [], []
                for elements, weights in _elements(batch, n, weight):
                    sizes.append(int(weights.sum()))
                    prints.append(_prints(elements, weights))
                    keys.append(signature(elements, weights.astype(float), k).astype(np.uint32).tobytes() if len(elements) else b"")
                prints = np.array(prints, np.uint64).reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ROW), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary())], [*ROW, "p1", "p2", "n", "darts"])

    return sign


def _sets(n: int, weight: str):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                own = _elements(batch, n, weight)
                # weights of 1 throughout are left out
                weights = [w.astype(np.uint32).tobytes() if (w > 1).any() else b"" for _, w in own]
                prints = np.array([_prints(e, w) for e, w in own], np.uint64).reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([int(w.sum()) for _, w in own], pa.int32()), pa.array([e.tobytes() for e, _ in own], pa.binary()), pa.array(weights, pa.binary())], ["p1", "p2", "n", "elements", "weights"])

    return sets


def _bands(rows: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            keys = [mix((np.frombuffer(b.as_buffer(), np.uint32).reshape(-1, rows).astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)).astype(np.int64) for b in batch.column("darts")]
            n = [len(x) for x in keys]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("rep")), n)), pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in n] + [np.zeros(0, np.int32)])), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]))], ["rep", "band", "key"])

    return explode


class Weighted:
    """A weighted set as it is stored."""

    def __init__(self, elements: pa.Scalar, weights: pa.Scalar):
        self.elements, self.weights = np.frombuffer(elements.as_buffer(), np.uint64), np.frombuffer(weights.as_buffer(), np.uint32).astype(np.int64)
        self.total = int(self.weights.sum()) if len(self.weights) else len(self.elements)

    def similar(self, other: Weighted, threshold: float) -> bool:
        """Whether the weighted Jaccard similarity reaches the threshold."""
        if len(self.weights) or len(other.weights):
            _, x, y = np.intersect1d(self.elements, other.elements, assume_unique=True, return_indices=True)
            own, its = (w[at] if len(w) else np.ones(len(at), np.int64) for w, at in ((self.weights, x), (other.weights, y)))
            common = int(np.minimum(own, its).sum())
        else:
            common = len(np.intersect1d(self.elements, other.elements, assume_unique=True))
        return common >= threshold * (self.total + other.total - common) - 1e-9


def _across(least: float, threshold: float):
    """Links between classes within one block, or between two blocks, of a bucket.

    Signatures tell which pairs can be similar, the shingle sets which are. Classes that a link has joined are one from
    there on, so at most as many links come out as there are members.
    """

    def across(key: tuple, block: pa.Table) -> pa.Table:
        rep, side = np.asarray(block.column("rep")), np.asarray(block.column("block"))
        root = np.unique(np.asarray(block.column("root")), return_inverse=True)[1]
        darts = np.stack([np.frombuffer(x.as_buffer(), np.uint32) for x in block.column("darts")])
        sets = [Weighted(x, w) for x, w in zip(block.column("elements"), block.column("weights"), strict=True)]
        single, pairs = side.min() == side.max(), []
        for x in range(len(rep)):
            others = np.flatnonzero((rep > rep[x]) & (root != root[x]) & ((side != side[x]) | single))
            for y in others[(darts[others] == darts[x]).mean(axis=1) >= least] if len(others) else ():
                if root[y] == root[x]:
                    continue
                if sets[x].similar(sets[y], threshold):
                    pairs.append((rep[x], rep[y]))
                    root[root == root[y]] = root[x]
        pairs = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return across


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (a, wa, b, wb) in enumerate(zip(*(batch.column(c) for c in ("ea", "wa", "eb", "wb")), strict=True)):
                good[i] = Weighted(a, wa).similar(Weighted(b, wb), threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    return verify


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes that have links; rounds of joins, each written.

    Every node hooks onto the smallest root among its neighbours, then roots are shortened.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        # the smallest root that any neighbour has, for the node's root as well as for itself
        seen = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        now = written(roots.join(seen, "node").select("node", "root", F.least("root", "near").alias("near")), "roots")
        hooks = now.groupBy(F.col("root").alias("at")).agg(F.min("near").alias("to"))
        new = written(spread_join(now, hooks.withColumnRenamed("at", "root"), ["root"], FEW_ROWS).select("node", F.least("near", "to").alias("root")), "roots")
        # a root is a node that has links, so it has a root itself
        jump = new.select(F.col("node").alias("root"), F.col("root").alias("to"))
        new = written(spread_join(new, jump, ["root"], FEW_ROWS).select("node", F.least("root", "to").alias("root")), "roots")
        moved = new.join(roots.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count()
        roots = new
        if not moved:
            return roots


def classes(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, weight: str = "count", turns: int = 2) -> DataFrame:
    """(doc_id, class_id, n_shingles), one row per row of docs: documents linked by chains of similar pairs share the smallest doc_id of them.

    Words are split at ASCII white space and used unchanged. Similarity is the weighted Jaccard of the `shingle`-word
    shingles, in signatures, filters and verification alike; n_shingles is the sum of a document's weights. weight: "count" weighs
    each shingle by its occurrences, "set" by 1. A text of fewer words is one element, so it only equals copies of itself. Null texts and
    texts without words are alone. Texts are compared, not ids: rows that repeat an id, or have none, stand for their own texts, and a class without any id has a null class_id.
    A pair at the threshold is missed by all bands with a probability of (1 - 0.8 ** rows) ** bands, 5e-6 by default; where blocks of a bucket meet,
    by a signature that is six standard deviations too low with one of about 1e-9.
    """
    return _classes(docs, shingle, threshold, bands, rows, weight, turns).select("doc_id", "class_id", "n_shingles")


def _classes(docs: DataFrame, shingle: int, threshold: float, bands: int, rows: int, weight: str, turns: int) -> DataFrame:
    """(doc_id, text_hash, class_id, n_shingles, first) of each row; first: which row of its class stays, by id and hash of the text."""
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"), docs["text"].alias("text"))
    signed = written(numbered.mapInArrow(_sign(shingle, bands, rows, weight), "rid long, doc_id long, text_hash long, p1 long, p2 long, n int, darts binary"), "near-signed")
    same = ["p1", "p2", "n"]
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    # a text is told by its weighted set, whatever ids its rows have; its representative is one of its rows
    reps = written(signed.where("n > 0").groupBy(*same).agg(F.min("rid").alias("rep"), F.min(first).alias("first")), "near-reps")
    real = reps.select(F.col("rep").alias("rid"))
    distinct = signed.join(F.broadcast(real) if real.count() <= BROADCAST_ROWS else real, "rid", "left_semi").select(F.col("rid").alias("rep"), "doc_id", *same, "darts")
    buckets = written(distinct.select("rep", "darts").mapInArrow(_bands(rows), "rep long, band int, key long"), "near-bands")
    shared = buckets.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1").select("band", "key")
    open_ = written(spread_join(buckets, shared, ["band", "key"], FEW_ROWS), "near-buckets")
    # shingle sets are made again, only for texts that share a bucket
    members = written(distinct.drop("darts").join(open_.select("rep").distinct(), "rep", "left_semi"), "near-members")
    few = members.count() <= BROADCAST_ROWS
    ids = members.select(F.col("doc_id").alias("id")).distinct()
    wanted = numbered.where("text is not null").select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    made = wanted.select("text").mapInArrow(_sets(shingle, weight), "p1 long, p2 long, n int, elements binary, weights binary")
    told = members.select("rep", *same)
    sets = written(made.join(F.broadcast(told) if few else told, same).select("rep", "n", "elements", "weights").dropDuplicates(["rep"]), "near-sets")
    distinct = distinct.select("rep", "darts")

    links = roots = None
    for turn in range(turns):
        if open_.limit(1).count() == 0:
            break
        centre = written(open_.groupBy("band", "key").agg(F.min_by("rep", F.xxhash64("rep", F.lit(turn))).alias("centre")), "near-centres")
        centred = written(spread_join(open_, centre, ["band", "key"], FEW_ROWS), "near-centred")
        faced = centred
        if roots is not None:
            named = roots.select(F.col("node").alias("centre"), F.col("root").alias("centre_root"))
            faced = faced.join(named, "centre", "left").where(F.coalesce("centre_root", "centre") != F.col("root"))
        pairs = faced.where("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
        found = written(_similar(pairs, sets, threshold), "near-links")
        links = found if links is None else links.union(found)
        roots = components(links)
        # a centre has met its whole bucket; a bucket within one class is done
        left = centred.select("rep", "band", "key", "centre").where("rep <> centre").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        left = written(left, "near-left")
        undecided = left.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("lo <> hi").select("band", "key", "members")
        open_ = written(spread_join(left, undecided, ["band", "key"], FEW_ROWS).select("rep", "band", "key", "root", "members"), "near-buckets")
    if roots is not None and open_.limit(1).count():
        # the rest of the buckets, block against block; 6 standard deviations below the threshold no similar pair is lost
        k = bands * rows
        blocks = F.ceil(F.col("members") / BLOCK).cast("int")
        dealt = open_.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(99)), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).join(distinct, "rep").join(sets.select("rep", "elements", "weights"), "rep")
        least = threshold - 6 * (threshold * (1 - threshold) / k) ** 0.5
        found = dealt.select("band", "key", "i", "j", "rep", "root", "block", "darts", "elements", "weights").groupBy("band", "key", "i", "j").applyInArrow(_across(least, threshold), "a long, b long").distinct()
        links = links.union(written(found, "near-links"))
        roots = components(links)
    named = reps.select(*same, "rep", "first")
    if roots is not None:
        named = written(named.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")), "near-named")
        least = named.groupBy("root").agg(F.min("first").alias("least"))
        named = spread_join(named, least, ["root"], FEW_ROWS).select(*same, F.col("least").alias("first"))
    named = written(named.select(*same, "first"), "near-named")
    own = signed.select("doc_id", "text_hash", *same)
    every = spread_join(own.where("n > 0"), named, same, FEW_ROWS).unionByName(own.where("n = 0").withColumn("first", first))
    return every.select("doc_id", "text_hash", F.col("first.doc_id").alias("class_id"), F.col("n").cast("long").alias("n_shingles"), "first")


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets are similar enough. Sizes decide first, then the sets themselves."""
    sizes = sets.select("rep", "n")
    sized = pairs.join(sizes.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b")
    near = sized.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9).select("a", "b")
    of = lambda side: sets.select(F.col("rep").alias(side), F.col("elements").alias("e" + side), F.col("weights").alias("w" + side))
    return near.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ea", "wa", "eb", "wb").mapInArrow(_verify(threshold), "a long, b long")


def keep_one(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, weight: str = "count", turns: int = 2) -> DataFrame:
    """docs without the near-duplicates: one row of each class of texts stays, that of the smallest doc_id (null last; ties: the smallest hash of the text), with all columns.

    Rows of one id with different texts are kept or dropped each by its own text; of rows that repeat id and text one stays. Texts without words all stay.
    """
    told = written(_classes(docs, shingle, threshold, bands, rows, weight, turns), "near-told")
    chosen = (F.col("n_shingles") == 0) | F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash"))
    kept = told.where(chosen).select(F.col("doc_id").alias("id"), "text_hash", "n_shingles")
    stay = kept.select("id", "text_hash").distinct()
    is_row = lambda other: docs["doc_id"].eqNullSafe(other["id"]) & (F.xxhash64(docs["text"]) == other["text_hash"])
    once = docs.join(stay, is_row(stay), "left_semi")
    repeated = written(kept.where("n_shingles > 0").groupBy("id", "text_hash").count().where("count > 1").select("id", "text_hash"), "near-repeated")
    if repeated.limit(1).count() == 0:
        return once
    alone = once.join(repeated, is_row(repeated), "left_anti")
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    many = docs.join(repeated, is_row(repeated)).select(repeated["id"].alias("id"), repeated["text_hash"].alias("text_hash"), row.alias("row"))
    return alone.unionByName(many.groupBy("id", "text_hash").agg(F.first("row").alias("row")).select("row.*"))
