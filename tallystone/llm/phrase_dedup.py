"""Substring dedup: words inside passages that also start earlier in the corpus, by repeated-phrase automata.

1. Anchors nominate. Of the `gram`-word runs in each `window`-word window the one with the smallest hash is the
   window's anchor, so equal windows have equal anchors wherever they stand. An anchor serves about seven windows.
   Anchors meet by hash; those met once are dropped, as no window around them recurs.
2. Automata. The words around the other anchors, of every document, are sharded by (anchor, part); a frequent anchor has
   many parts, so no common passage lands in one task. A shard confirms which window phrases recur in it, compiles them into
   an Aho-Corasick automaton over words, and streams its passages through it; those of the same words pass once, for all that hold
   them. Every occurrence comes from the automaton, and so is exact in words; all but the first of a phrase are to be removed.
3. Parts of one frequent anchor meet once more by the words of each distinct phrase's first occurrence.

Each window of each document that may recur reaches exactly one shard: nothing is sampled or cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm.common import BROADCAST_ROWS, hash_strings, mix, owners, partitions, rolling, slices, split_words, word_hashes, words_column, written

#: Occurrences of one anchor in a task that stay in the anchor's common part, and cells in which a task counts them.
COMMON, CELLS = 48, 1 << 22
#: Passages of an automaton, at least.
SHARD = 512
#: Stands for a null id, as the smallest.
NO_ID = -(1 << 63)
#: What tells a document: its id and, where some rows share one or have none, for those a hash of the text.
ROW = ["doc_id", "sub"]
#: A place packs where a passage begins (from bit 32), its words (from bit 1) and whether its part has others elsewhere (bit 0).
ANCHOR = "anchor long, part long, place long"
RECURRING = "route long, place long"
#: A run packs its first window (from bit 32) and its last.
RUNS = "run long, phrase string"


def _longs(names: list[str]) -> str:
    return "".join(f", {name} long" for name in names)


def _anchors(window: int, gram: int, row: list[str]):
    span = window - gram + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        met = np.zeros(CELLS, np.uint8)
        for whole in batches:
            for batch in slices(whole, "text"):
                number += 1
                flat, offsets = split_words(batch.column("text"))
                if len(flat) < window:
                    continue
                grams = rolling(word_hashes(flat), gram)
                owner = owners(offsets)
                starts = np.flatnonzero(owner[: len(flat) - window + 1] == owner[window - 1 :])
                if not len(starts):
                    continue
                best = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1)[starts] + starts
                # windows of one anchor are consecutive
                new = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (starts[1:] != starts[:-1] + 1))))
                ends = np.concatenate((new[1:], [len(starts)])) - 1
                place, first, last = best[new], starts[new], starts[ends]
                key, doc = grams[place].astype(np.int64), owner[place]
                begin = offsets[doc]
                # occurrences of one anchor beyond COMMON in this task go to parts of their own; one of each slice stays, to tell of them
                order = np.argsort(key, kind="stable")
                ordered = key[order]
                head = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
                times = np.diff(np.concatenate((head, [len(key)])))
                cell = ordered[head] & (CELLS - 1)
                before = met[cell].astype(np.int64)
                np.maximum.at(met, cell, np.minimum(before + times, 255).astype(np.uint8))
                rank, count = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
                rank[order] = np.arange(len(key)) - np.repeat(head, times)
                seen = np.empty(len(key), np.int64)
                seen[order], count[order] = np.repeat(before, times), np.repeat(before + times, times)
                part = np.where((seen + rank < COMMON) | (rank == 0), 0, 1 + ((np.int64(task) << 24) + number) * 256 + rank // 1024)
                packed = ((first - begin) << 32) | ((last - first + window) << 1) | (count > COMMON)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part), pa.array(packed), *(pa.array(np.asarray(batch.column(c))[doc]) for c in row)], ["anchor", "part", "place", *row])

    return find


def _recurring(row: list[str]):
    """Of rows sorted by (anchor, part): those in groups of two or more, with a hash of anchor and part as their route to a shard.

    Groups at the edges of a batch are passed on as they may go on beyond it.
    """

    def recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            anchor, part, place = (np.asarray(batch.column(i)) for i in range(3))
            hot = (place & 1).astype(bool)
            head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))))
            size = np.diff(np.concatenate((head, [len(anchor)])))
            edge = np.zeros(len(head), bool)
            edge[[0, -1]] = True
            many = edge | (part[head] != 0) | np.logical_or.reduceat(hot, head)
            keep = np.repeat((size > 1) | many, size)
            group = ((np.int64(task) << 32) + number).repeat(len(anchor)) * 2 + 1
            many = np.repeat(many, size)
            part = np.where(many, np.where(part != 0, part * 2, group), 0)
            route = mix(anchor.astype(np.uint64) ^ mix(part.astype(np.uint64)))
            place = (place & ~np.int64(1)) | many
            yield pa.RecordBatch.from_arrays([pa.array(route.astype(np.int64)), pa.array(place), *(batch.column(c) for c in row)], ["route", "place", *row]).filter(pa.array(keep))

    return recurring


def _letters(codes: np.ndarray) -> str:
    """One character for each code, none of them a surrogate or code point 0."""
    return np.where(codes + 1 < 0xD800, codes + 1, codes + 1 + 0x800).astype("<u4").tobytes().decode("utf-32-le")


def _members(kinds: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (index in kinds, index in of) of equal values; of is sorted."""
    low, high = np.searchsorted(of, kinds), np.searchsorted(of, kinds, side="right")
    n = high - low
    return np.repeat(np.arange(len(kinds)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _locate(window: int, row: list[str]):
    def shard(batch: pa.RecordBatch) -> pa.RecordBatch:
        import ahocorasick

        # passages of the same words go through the automaton once, and what it finds holds for each of them
        texts = batch.column("passage").dictionary_encode()
        text, n_texts = np.asarray(texts.indices).astype(np.int64), len(texts.dictionary)
        flat, offsets = split_words(texts.dictionary)
        coded = flat.dictionary_encode()
        codes, owner = np.asarray(coded.indices).astype(np.int64), owners(offsets)
        hashes = rolling(hash_strings(coded.dictionary)[codes], window)
        starts = np.flatnonzero(owner[: len(codes) - window + 1] == owner[window - 1 :])
        own = owner[starts]
        doc, place = (np.asarray(batch.column(c)) for c in ("doc_id", "place"))
        sub = np.asarray(batch.column("sub")) if "sub" in row else np.zeros(len(doc), np.int64)
        first, hot = place >> 32, (place & 1).astype(bool)
        # the passages' order in the corpus (equal for rows that repeat id and text), and each text's first holder in it
        order = np.lexsort((first, sub, doc))
        step = np.concatenate(([0], (np.diff(doc[order]) != 0) | (np.diff(sub[order]) != 0) | (np.diff(first[order]) != 0)))
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.cumsum(step)
        holder = np.full(n_texts, len(doc), np.int64)
        np.minimum.at(holder, text, rank)
        # confirm: one window of each phrase that recurs here goes into the automaton
        _, lead, phrase = np.unique(hashes[starts], return_index=True, return_inverse=True)
        count = np.bincount(phrase, weights=np.bincount(text, minlength=n_texts)[own], minlength=len(lead))
        phrases = starts[lead[count > 1]].tolist()
        recurs, leads = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
        if phrases:
            letters = _letters(codes)
            automaton = ahocorasick.Automaton()
            for number, at in enumerate(phrases):
                automaton.add_word(letters[at : at + window], number)
            automaton.make_automaton()
            # texts follow each other; matches across two of them are no windows
            found = np.fromiter(chain.from_iterable(automaton.iter(letters)), np.int64).reshape(-1, 2)
            at, phrase = found[:, 0] - window + 1, found[:, 1]
            inside = owner[at] == owner[at + window - 1]
            at, phrase = at[inside], phrase[inside]
            # a phrase begins first in the first holder of one of its texts; the windows of a document's passages don't overlap
            when = (holder[owner[at]] << 32) | (at - offsets[owner[at]])
            earliest = np.full(len(phrases), np.iinfo(np.int64).max)
            np.minimum.at(earliest, phrase, when)
            window_of = np.searchsorted(starts, at)
            recurs[window_of], leads[window_of] = True, when == earliest[phrase]
        # a text's first holder keeps the windows that lead their phrase, its other holders none that recur
        kind = 2 * text + (rank > holder[text])
        late, of = np.concatenate((recurs & ~leads, recurs)), np.concatenate((2 * own, 2 * own + 1))
        where = np.tile(starts - offsets[own], 2)
        # a run of windows to remove has no phrase
        gone = np.flatnonzero(late)
        gone = gone[np.argsort(of[gone], kind="stable")]
        g, p = of[gone], where[gone]
        new = np.flatnonzero(np.concatenate(([True] * bool(len(gone)), (g[1:] != g[:-1]) | (p[1:] != p[:-1] + 1))))
        end = np.concatenate((new[1:], [len(g)] * bool(len(g)))).astype(np.int64) - 1
        r, k = _members(kind, g[new])
        rows = [(doc[r], sub[r], first[r] + p[new][k], first[r] + p[end][k])]
        # first occurrences in a part that has others elsewhere, with their words
        left = np.flatnonzero(~late)
        left = left[np.argsort(of[left], kind="stable")]
        holders = np.flatnonzero(hot)
        r, k = _members(kind[holders], of[left])
        r, left = holders[r], left[k]
        words = flat.take(pa.array((np.tile(starts, 2)[left][:, None] + np.arange(window)).ravel()))
        phrases = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, window, dtype=np.int32)), words), " ")
        rows.append((doc[r], sub[r], first[r] + where[left], first[r] + where[left]))
        d, u, a, b = (np.concatenate([x[i] for x in rows]) for i in range(4))
        told = dict(zip(ROW, (d, u), strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(told[c]) for c in row), pa.array((a << 32) | b), pa.concat_arrays([pa.nulls(len(rows[0][0]), pa.string()), phrases])], [*row, "run", "phrase"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by route: a group that a batch cuts off is carried into the next one."""
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            route = np.asarray(batch.column("route"))
            heads = np.flatnonzero(np.concatenate(([True], route[1:] != route[:-1])))
            # whole groups, of SHARD passages or more: a small automaton has few branches at its root
            at = 0
            while (k := int(np.searchsorted(heads, at + SHARD))) < len(heads):
                yield shard(batch.slice(at, int(heads[k]) - at))
                at = int(heads[k])
            if at < heads[-1]:
                yield shard(batch.slice(at, int(heads[-1]) - at))
            rest = batch.slice(int(heads[-1]))
        if rest is not None:
            yield shard(rest)

    return stream


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc_id, sub, text) and what tells its rows: sub tells those apart that share an id or have none, by a hash of their text; other rows have 0. Where no row needs it, there is no sub.

    All steps read one exchange of it, so texts are shuffled once.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    shared = own.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 or doc_id is null").select(F.col("doc_id").alias("id"), F.lit(True).alias("shared"))
    shared = written(shared, "phrase-shared")
    n = shared.count()
    if not n:
        # never null, so that no join adds a filter of its own, which would need another exchange
        return own.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text"), ROW[:1]
    named = shared.where("id is not null")
    own = own.join(F.broadcast(named) if n <= BROADCAST_ROWS else named, F.col("doc_id") == F.col("id"), "left")
    told = F.col("doc_id").isNull() | F.coalesce("shared", F.lit(False))
    return own.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.when(told, F.xxhash64("text")).otherwise(0).alias("sub"), "text"), ROW


def repeats(docs: DataFrame, window: int = 20, gram: int = 8) -> DataFrame:
    """Runs (doc_id, sub, first, last) of window starts whose word sequence also starts earlier. Runs may touch or repeat.

    Earlier: in a smaller doc_id, or in the same document before. Rows that share an id are documents of their own, in the order of `sub`, a hash
    of their texts; those that repeat the text as well are one. A null id, here the smallest long, comes first. A null or short text has no windows.
    """
    texts, row = _keyed(docs)
    found = _repeats(texts, window, gram, row)
    found = found if "sub" in row else found.withColumn("sub", F.lit(0).cast("long"))
    return found.select(*ROW, F.shiftright("run", 32).cast("int").alias("first"), F.col("run").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("last"))


def _repeats(texts: DataFrame, window: int, gram: int, row: list[str]) -> DataFrame:
    n = partitions(texts.sparkSession)
    anchors = texts.mapInArrow(_anchors(window, gram, row), ANCHOR + _longs(row))
    anchors = anchors.repartition(n, "anchor", "part").sortWithinPartitions("anchor", "part", *row, "place")
    recurring = anchors.mapInArrow(_recurring(row), RECURRING + _longs(row))
    # rows that repeat id and text have the same places
    gathered = F.collect_set if "sub" in row else F.collect_list
    wanted = recurring.groupBy(*row).agg(gathered(F.struct("route", "place")).alias("places"))
    split = texts.join(wanted, row).select(*row, "places", words_column(F.col("text")).alias("words"))
    first = lambda p: F.shiftright(p["place"], 32).cast("int")
    n_words = lambda p: F.shiftright(p["place"], 1).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    passage = F.transform("places", lambda p: F.struct(p["route"], p["place"], F.array_join(F.slice("words", first(p) + 1, n_words(p)), " ").alias("passage")))
    passages = split.select(*row, F.explode(passage).alias("p")).select(*row, "p.*")
    shards = passages.repartition(n, "route").sortWithinPartitions("route", *row, "place")
    located = shards.select("route", *row, "place", "passage").mapInArrow(_locate(window, row), _longs(row)[2:] + ", " + RUNS)
    # a row without phrase is a run to remove; the others meet those of the same words
    run = F.col("phrase").isNull()
    keyed = located.withColumn("key", F.when(run, F.xxhash64(*row) if "sub" in row else F.col("doc_id")).otherwise(F.xxhash64("phrase")))
    place = F.struct(*row, "run")
    lead = F.first(place).over(Window.partitionBy("key", "phrase").orderBy(*row, "run"))
    met = keyed.withColumn("late", run | (place != lead)).where("late")
    return met.select(*row, "run")


def _cut(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, offsets = split_words(batch.column("text"))
                runs = batch.column("runs")
                at = np.asarray(runs.offsets).astype(np.int64)
                packed = np.asarray(runs.values)[int(at[0]) : int(at[-1])]
                n_runs = np.diff(at)
                begin = np.repeat(offsets[:-1], n_runs)
                first, last = packed >> 32, packed & ((1 << 32) - 1)
                # a run never reaches beyond the last window of its text; texts without windows have no runs
                most = np.repeat(np.diff(offsets) - window, n_runs)
                last = np.minimum(last, most)
                real = last >= first
                edge = np.zeros(len(flat) + 1, np.int64)
                np.add.at(edge, (begin + first)[real], 1)
                np.add.at(edge, (begin + last + window)[real], -1)
                keep = np.cumsum(edge)[:-1] == 0
                kept = np.concatenate(([0], np.cumsum(keep)))[offsets]
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), flat.filter(pa.array(keep))), " ")
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(n - np.diff(kept)), texts], ["doc_id", "n_words", "n_removed", "kept_text"])

    return cut


def dedup_passages(docs: DataFrame, window: int = 20, gram: int = 8) -> DataFrame:
    """(doc_id, n_words, n_removed long, kept_text) of every row of docs: kept words joined by one space.

    A word goes if a window of `window` words over it also starts earlier; windows are those of the input. Rows that share an
    id are documents of their own, in the order of a hash of their texts, and only lose words of their own; those that also repeat the text are cut alike. A null id comes first.
    """
    texts, row = _keyed(docs)
    runs = _repeats(texts, window, gram, row).groupBy(*row).agg(F.collect_set("run").alias("runs"))
    none = F.array().cast("array<long>")
    joined = texts.join(runs, row, "left")
    joined = joined.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("runs", none).alias("runs"))
    return joined.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_text string")
