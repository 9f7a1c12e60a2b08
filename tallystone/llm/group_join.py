"""Set-similarity join of documents' word shingles by a token-group matrix.

Sets that are similar go to one group; the matrix says which tokens the union of each group's sets holds. A set can only be similar to a member of a group whose union
shares enough tokens with it, so the count of shared tokens bounds the similarity to all members at once, and only groups that reach the bound are
opened: there the shingles that a set shares with the union of the group's bound it once more, and the sets left are compared exactly.

The matrix is kept small by its tokens: a set's shingles are dealt to k parts by their hash, and the content of a part is a token. Similar sets differ in a bounded
number of shingles, d, so at least k - d of their tokens agree. Dissimilar sets hardly share any, even if they have long passages in common. k
follows the sets' sizes, which are cut into bands so wide that similar sets lie in one band or in neighbouring ones; a set asks with the tokens of its own band's k and is
found by those of its own and the next band's.

Copies of one set are one from the start. A group is led by the token that most sets share. Pairs within a group are compared first, then the centre of each group, which shares most tokens with its members, asks all other groups,
then all other sets ask the groups that share enough tokens with their own group; what is joined by then is not compared again. So a group of copies is not expanded into all its pairs, and no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import BROADCAST_ROWS, FEW_ROWS, mix, owners, partitions, rolling, slices, split_words, spread_join, word_hashes, written
from tallystone.llm.near_dup import components

#: Members of a group, and shingles of its sets (one set at least).
GROUP, GROUP_SHINGLES = 1024, 1 << 21
#: Sets that a task remembers to have made.
SEEN = 1 << 20
#: Smallest hashes of a set that tell which sets are kept together.
LOWS = 4
_EMPTY = np.uint64(0x5851F42D4C957F2D)


@lru_cache(8)
def bands(percent: int, most: int = 1 << 32) -> tuple[np.ndarray, np.ndarray]:
    """The least size of each band, and how many parts a set is dealt to where the larger set of a pair is in that band (0: only equal sets are similar).

    One part more than may differ, and one more for a part that both sets leave empty.
    """
    starts = [1]
    while starts[-1] < most:
        starts.append(max(starts[-1] + 1, 100 * (starts[-1] - 1) // percent + 1))
    starts = np.array(starts, np.int64)
    differ = 2 * (starts[1:] - 1) * (100 - percent) // (100 + percent)
    return starts, np.append(np.where(differ > 0, differ + 2, 0), 0)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one text after the other, and where each text's end. A-Z are lower-cased; fewer than n words are one shingle, no words none."""
    flat, offsets = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes, owner = word_hashes(flat), owners(offsets)
    grams = rolling(hashes, n)
    inside = owner[: len(grams)] == owner[n - 1 :] if len(grams) else np.zeros(0, bool)
    short = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < n))
    whole = [mix((mix(hashes[offsets[i] : offsets[i + 1]]) * np.arange(1, 2 * (offsets[i + 1] - offsets[i]), 2, dtype=np.uint64)).sum(dtype=np.uint64, keepdims=True) + np.uint64(offsets[i + 1] - offsets[i])) for i in short]
    of = np.concatenate([owner[: len(grams)][inside], short])
    grams = np.concatenate([grams[inside], *whole, np.zeros(0, np.uint64)])
    order = np.lexsort((grams, of))
    of, grams = of[order], grams[order]
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (grams[1:] != grams[:-1])
    of, grams = of[fresh], grams[fresh]
    return grams, np.searchsorted(of, np.arange(1, len(offsets)))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of each stretch, modulo 2 ** 64."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[ends] - total[np.concatenate(([0], ends[:-1]))]


def _prints(grams: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return [_sums(mix(grams + np.uint64(salt)), ends).astype(np.int64) for salt in (1, 7)]


def part_tokens(grams: np.ndarray, ends: np.ndarray, parts: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of each set dealt to so many parts, where each set's end, and how many parts are empty. Sets with two empty parts and more have tokens for these, too."""
    n = np.diff(ends, prepend=0)
    of = np.repeat(np.arange(len(ends)), n)
    use = parts[of] > 0
    of, grams = of[use], grams[use]
    begin = np.cumsum(parts) - parts
    scrambled = mix(grams ^ mix(slot.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))[of])
    at = begin[of] + (scrambled % parts[of].astype(np.uint64)).astype(np.int64)
    sums, filled = np.zeros(parts.sum(), np.uint64), np.zeros(parts.sum(), bool)
    np.add.at(sums, at, mix(scrambled))
    filled[at] = True
    owner = np.repeat(np.arange(len(ends)), parts)
    gaps = parts - np.bincount(owner[filled], minlength=len(ends))
    place = np.arange(len(sums)) - begin[owner]
    keys = mix(np.where(filled, sums, _EMPTY) + mix(slot.astype(np.uint64))[owner] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keep = filled | (gaps[owner] > 1)
    return keys[keep], np.searchsorted(owner[keep], np.arange(1, len(ends) + 1)), gaps


SIGNED = "rid long, doc_id long, p1 long, p2 long, n long, band int, parts int, gaps int, low binary, own binary, next binary"


def _sign(n: int, percent: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, parts = bands(percent)
        for whole in batches:
            for batch in slices(whole, "text"):
                grams, ends = shingle_sets(batch.column("text"), n)
                begins = np.concatenate(([0], ends[:-1]))
                size = ends - begins
                band = np.maximum(np.searchsorted(starts, size, side="right") - 1, 0)
                k = np.where(size > 0, parts[band], 0)
                own, own_at, gaps = part_tokens(grams, ends, k, band)
                more, more_at, _ = part_tokens(grams, ends, np.where(size > 0, parts[band + 1], 0), band + 1)
                blobs = lambda values, at: pa.array([values[a:b].tobytes() for a, b in zip(np.concatenate(([0], at[:-1])), at, strict=True)], pa.binary())
                low = pa.array([grams[a : min(a + LOWS, b)].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary())
                columns = [batch.column("rid"), batch.column("doc_id"), *map(pa.array, _prints(grams, ends)), pa.array(size), *(pa.array(x.astype(np.int32)) for x in (band, k, gaps)), low, blobs(own, own_at), blobs(more, more_at)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SIGNED.split(", ")])

    return sign


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for column, asks in (("own", True), ("next", False)):
            blobs = batch.column(column)
            n = np.asarray(pc.binary_length(blobs)) // 8
            keys = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in blobs), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("rid")), n)), pa.array(keys), pa.array(np.full(len(keys), asks))], ["rep", "key", "asks"])


def _sets(n: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Most copies within a task are passed on once."""
        seen: set[tuple[int, int]] = set()
        for whole in batches:
            for batch in slices(whole, "text"):
                grams, ends = shingle_sets(batch.column("text"), n)
                begins, prints, fresh = np.concatenate(([0], ends[:-1])), _prints(grams, ends), []
                for k, own in enumerate(zip(*(p.tolist() for p in prints), strict=True)):
                    if own not in seen:
                        fresh.append(k)
                        seen.add(own)
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([*(pa.array(p[fresh]) for p in prints), pa.array((ends - begins)[fresh]), pa.array([grams[begins[k] : ends[k]].tobytes() for k in fresh], pa.binary())], ["p1", "p2", "n", "elements"])

    return sets


def _cut_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets sorted by band, leading token and smallest hashes become groups: a new one where band or token change, or where it would be too large."""
    group, last, members, shingles = TaskContext.get().partitionId() << 33, None, 0, 0
    for batch in batches:
        out = np.empty(batch.num_rows, np.int64)
        for k, (band, lead, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("band", "lead", "n")), strict=True)):
            if (band, lead) != last or members >= GROUP or shingles + n > GROUP_SHINGLES:
                group, last, members, shingles = group + 1, (band, lead), 0, 0
            members, shingles = members + 1, shingles + n
            out[k] = group
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(out)], ["rep", "group"])


class Postings:
    """The union of a group's sets: for each shingle the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.of = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.union, self.at = np.unique(flat[order], return_index=True)
        self.at = np.append(self.at, len(flat))

    def held(self, own: np.ndarray) -> np.ndarray:
        """Places in the union of the shingles that it holds."""
        at = np.minimum(np.searchsorted(self.union, own), max(0, len(self.union) - 1))
        return at[self.union[at] == own]

    def common(self, held: np.ndarray) -> np.ndarray:
        """How many shingles each set shares."""
        n = self.at[held + 1] - self.at[held]
        ends = np.cumsum(n)
        flat = np.repeat(self.at[held] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.of[flat], minlength=len(self.sizes))


def _read(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    pairs = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _linked_within(rep: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links within a group; sets that a link has joined are not compared again."""
    given, root, pairs = Postings(sets), np.arange(len(rep)), []
    for x in range(len(rep)):
        if (root == root[x]).all():
            break
        common = given.common(given.held(sets[x]))
        similar = 100 * common >= percent * (given.sizes + len(sets[x]) - common)
        for y in np.flatnonzero(similar & (root != root[x])):
            if root[y] != root[x]:
                pairs.append((rep[x], rep[y]))
                root[root == root[y]] = root[x]
    return pairs


def _within(percent: int):
    """Of rows sorted by (group, rep): the links within each group, and each set once, for the steps to come."""

    def told(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        group, rep = np.asarray(batch.column("group")), np.asarray(batch.column("rep"))
        once = np.ones(len(rep), bool)
        once[1:] = (rep[1:] != rep[:-1]) | (group[1:] != group[:-1])
        batch = batch.filter(pa.array(once))
        group, rep, pairs = group[once], rep[once], []
        heads = np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(group))
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            if b - a > 1:
                pairs += _linked_within(rep[a:b], _read(batch.column("elements").slice(a, b - a)), percent)
        none = pa.nulls(len(rep), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, batch.column("rep"), batch.column("elements")], ["a", "b", "rep", "elements"])
        links = np.array(pairs, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1]), pa.nulls(len(links), pa.int64()), pa.nulls(len(links), pa.binary())], ["a", "b", "rep", "elements"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group that a batch cuts off is carried into the next one."""
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            group = np.asarray(batch.column("group"))
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield from told(batch.slice(0, last))
            rest = batch.slice(last)
        if rest is not None:
            yield from told(rest)

    return stream


def _across(percent: int):
    """Links between the members of one group and the sets that ask it."""

    def across(block: pa.Table) -> pa.Table:
        asks = np.asarray(block.column("asks"))
        rep, root, sets = np.asarray(block.column("rep")), np.unique(np.asarray(block.column("root")), return_inverse=True)[1], _read(block.column("elements"))
        members = np.flatnonzero(~asks)
        given, pairs = Postings([sets[m] for m in members]), []
        for x in np.flatnonzero(asks):
            held = given.held(sets[x])
            # what the union lacks no member has
            if 100 * len(held) < percent * len(sets[x]) or (root[members] == root[x]).all():
                continue
            common = given.common(held)
            similar = 100 * common >= percent * (given.sizes + len(sets[x]) - common)
            for y in members[similar & (root[members] != root[x])]:
                if root[y] != root[x]:
                    pairs.append((rep[x], rep[y]))
                    root[root == root[y]] = root[x]
        return _links(pairs)

    return across


def _with_roots(df: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return df.withColumn("root", F.col("rep"))
    return df.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def _centres(tokens: DataFrame, members: DataFrame) -> DataFrame:
    """(group, centre): the member whose tokens are those of most other members."""
    own = tokens.where("asks").join(members.select("rep", "group"), "rep").select("group", "key", "rep")
    many = own.groupBy("group", "key").agg(F.count("*").alias("holders"))
    held = own.join(many, ["group", "key"]).groupBy("group", "rep").agg(F.sum("holders").alias("held"))
    held = members.select("group", "rep").join(held, ["group", "rep"], "left")
    return held.groupBy("group").agg(F.max_by("rep", F.struct(F.coalesce("held", F.lit(0)), F.xxhash64("rep"))).alias("centre"))


def _meeting(tokens: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(rep, group) of the sets of each group and the earlier groups, of its band or the one below, whose tokens their own group shares often enough for any two of their sets to be similar. Groups joined to each other are left out."""
    named = tokens.join(members.select("rep", "group"), "rep").select("key", "group", "asks")
    stats = members.groupBy("group").agg(F.first("band").alias("band"), F.first("parts").alias("parts"), F.max(F.least("gaps", F.lit(1))).alias("gaps"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    side = lambda df, x: df.select(*[F.col(c) if c == "key" else F.col(c).alias(c + x) for c in df.columns])
    asked = side(named.where("asks").select("key", "group").distinct().join(stats, "group"), "1")
    given = side(named.select("key", "group").distinct().join(stats, "group"), "2")
    met = asked.join(given, "key").where("band2 < band1 or band2 = band1 and group2 < group1").where((F.col("r01") != F.col("r02")) | (F.col("r01") != F.col("r11")) | (F.col("r02") != F.col("r12")))
    met = met.where((100 * F.col("hi2") >= percent * F.col("lo1")) & (F.col("lo2") <= F.floor(100 * F.col("hi1") / percent)))
    shared = met.groupBy("group1", "group2").agg(F.count("*").alias("shared"), *[F.first(c).alias(c) for c in ("hi1", "hi2", "parts1", "gaps1")])
    differ = F.floor((F.col("hi1") + F.least("hi2", F.floor(100 * F.col("hi1") / percent))) * (100 - percent) / (100 + percent))
    pairs = shared.where(F.col("shared") >= F.col("parts1") - differ - F.col("gaps1")).select(F.col("group1").alias("asker"), F.col("group2").alias("group"))
    return pairs.join(members.select("rep", F.col("group").alias("asker")), "asker").select("rep", "group")


def _qualifying(asking: DataFrame, tokens: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(rep, group) of the asking sets and the groups of other sets whose tokens they share often enough; members has a root, and groups that are joined to the set are left out."""
    groups = members.groupBy("group").agg(F.first("band").alias("g_band"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    matrix = tokens.join(members.select("rep", "group"), "rep").select("key", F.col("group")).distinct().join(groups, "group")
    asked = tokens.where("asks").select("rep", "key").join(asking.select("rep", "n", "parts", "gaps", "band", F.col("group").alias("own"), "root"), "rep")
    reach: Column = F.floor(100 * F.col("n") / percent)
    met = asked.join(matrix, "key").where((F.col("g_band") < F.col("band")) | ((F.col("g_band") == F.col("band")) & (F.col("group") != F.col("own"))))
    met = met.where((F.col("lo") <= reach) & (100 * F.col("hi") >= percent * F.col("n")) & ((F.col("r0") != F.col("r1")) | (F.col("r0") != F.col("root"))))
    shared = met.groupBy("rep", "group").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("hi").alias("hi"), F.first("parts").alias("parts"), F.first("gaps").alias("gaps"))
    differ = F.floor((F.col("n") + F.least("hi", F.floor(100 * F.col("n") / percent))) * (100 - percent) / (100 + percent))
    return shared.where(F.col("shared") >= F.col("parts") - differ - F.least("gaps", F.lit(1))).select("rep", "group")


def _open_groups(met: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between sets and members of the groups that they open. Sets that ask one group come in blocks."""
    met = written(met.join(members.select("rep", "n", "root"), "rep"), "group-met")
    blocks = met.groupBy("group").agg(F.ceil(F.greatest(F.sum("n") / GROUP_SHINGLES, F.count("*") / (4 * GROUP))).cast("int").alias("blocks"))
    asking = met.join(blocks, "group").select("group", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), "rep", "root", F.lit(True).alias("asks"))
    given = members.join(blocks, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "root", F.lit(False).alias("asks"))
    rows = written(asking.unionByName(given), "group-asked")
    rows = sets.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, "rep")
    return rows.groupBy("group", "block").applyInArrow(_across(percent), "a long, b long").distinct()


def linked(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs: documents linked by chains of similar pairs share the smallest doc_id of them.

    A document's set: its distinct runs of `shingle` words, A-Z lower-cased, words split at ASCII white space; fewer words are one element. Two documents
    link when 100 * intersection >= percent * union. Texts that are null or without words are alone. Rows that repeat an id, or have none, stand for their own texts; a component without
    any id has a null component_id. Shingles are compared by 64 bits of hash, copies of a set by 128. Empty tables give no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = written(rows.mapInArrow(_sign(shingle, percent), SIGNED), "group-signed")
    same = ["p1", "p2", "n"]
    reps = written(signed.where("n > 0").groupBy(*same).agg(F.min("rid").alias("rep"), F.min("doc_id").alias("first_id")), "group-reps")
    one = reps.select(F.col("rep").alias("rid"))
    distinct = signed.where("parts > 0 or length(next) > 0").join(F.broadcast(one) if one.count() <= BROADCAST_ROWS else one, "rid", "left_semi")
    tokens = written(distinct.select("rid", "own", "next").mapInArrow(_explode, "rep long, key long, asks boolean"), "group-tokens")
    shared = tokens.groupBy("key").agg(F.count("*").alias("sets"), F.max("asks").alias("asked")).where("sets > 1 and asked").select("key")
    shared = written(shared, "group-keys")
    tokens = written(tokens.join(F.broadcast(shared), "key") if shared.count() <= BROADCAST_ROWS else spread_join(tokens, shared, ["key"], FEW_ROWS), "group-shared")
    open_ = written(tokens.select("rep").distinct(), "group-open")
    few = open_.count() <= BROADCAST_ROWS
    small = F.broadcast(open_) if few else open_

    # sets that share a token: sorted into groups by the token that most sets share, and their shingles made again
    holders = written(tokens.groupBy("key").agg(F.count("*").alias("sets")), "group-holders")
    lead = spread_join(tokens, holders, ["key"], FEW_ROWS).groupBy("rep").agg(F.max_by("key", F.struct("sets", "key")).alias("lead"))
    light = signed.select(F.col("rid").alias("rep"), "doc_id", *same, "band", "parts", "gaps", "low").join(small, "rep", "left_semi")
    light = written(light.join(lead, "rep"), "group-light")
    part = lambda k: F.substring("low", 8 * k + 1, 8)
    order = ["band", "lead", *[part(k) for k in range(LOWS)], "rep"]
    grouped = light.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("rep", "band", "lead", "n").mapInArrow(_cut_groups, "rep long, group long")
    members = written(light.drop("low", "lead", "doc_id").join(written(grouped, "group-cut"), "rep"), "group-members")
    ids = light.select(F.col("doc_id").alias("id")).distinct()
    texts = rows.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    made = texts.where("text is not null").select("text").mapInArrow(_sets(shingle), "p1 long, p2 long, n long, elements binary")
    told = members.select("group", "rep", *same)
    placed = made.join(F.broadcast(told) if few else told, same).select("group", "rep", "elements")
    dealt = placed.repartition(partitions(docs.sparkSession), "group").sortWithinPartitions("group", "rep")
    within = written(dealt.mapInArrow(_within(percent), "a long, b long, rep long, elements binary"), "group-sets")
    sets, links = within.where("rep is not null").select("rep", "elements"), within.where("a is not null").select("a", "b")

    roots = components(links) if links.limit(1).count() else None
    centres = written(_centres(tokens, members), "group-centres")
    for only_centres in (True, False):
        now = written(_with_roots(members, roots), "group-rooted")
        if only_centres:
            met = _qualifying(now.join(centres, "group").where("rep = centre").drop("centre"), tokens, now, percent)
        else:
            met = _meeting(tokens, now, percent).join(centres.select(F.col("centre").alias("rep")), "rep", "left_anti")
        found = written(_open_groups(met, now, sets, percent), "group-links")
        if found.limit(1).count():
            links = links.union(found)
            roots = components(links)

    named = written(_with_roots(reps, roots), "group-named")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = written(spread_join(named, least, ["root"], FEW_ROWS).select(*same, "component_id"), "group-named")
    out = spread_join(signed.where("n > 0").select("doc_id", *same), named, same, FEW_ROWS).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
