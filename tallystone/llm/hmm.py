"""A hidden Markov language model over words, trained by Baum-Welch, scoring by the scaled forward recursion.

States emit word classes, and a class emits its words. The most frequent words and the end token are classes of
their own; every other word, known or not, belongs to a class by its last letters. Within a class
a word has probability (c + 0.1) / (n + 0.1 (v + 1)) for its training count c and the class's n tokens and v
words, one unknown word included, so the model is a distribution over all texts. The states' tables have a fixed size
whatever the vocabulary; the word counts themselves stay a distributed table. A bounded head of that table is broadcast,
words beyond it meet their counts in a join.

A whole text is one observation sequence, in training as in scoring. Its recursions are vectorized over segments of `SEGMENT`
tokens: the transfer matrix of each segment carries the forward state into the next one and the backward state into the one
before, so no transition is lost and a long text is as fast as many short ones. Expected counts are summed over all partitions
in each iteration, in whole units, so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import hash_strings, mix, owners, slices, split_words, written

#: Words with a class of their own, words whose counts are broadcast at most, classes of word ends, tokens of a segment, segments at once.
OWN, HEAD, ENDINGS, SEGMENT, ROWS = 4095, 65_536, 1024, 64, 1024
#: Expected counts are summed in whole units of this part of a token.
UNIT = 1 << 16
CLASSES = 1 + OWN + ENDINGS
SMOOTH = 0.1


def _ending(words: pa.Array) -> np.ndarray:
    """The class of a word that has none of its own: by its last three characters."""
    ends = pc.utf8_slice_codeunits(words, -3, None).dictionary_encode()
    if not len(words):
        return np.zeros(0, np.int64)
    return 1 + OWN + (hash_strings(ends.dictionary) % np.uint64(ENDINGS)).astype(np.int64)[np.asarray(ends.indices)]


@dataclass
class Vocabulary:
    """The bounded part of the word counts: the head, most frequent first, and totals by class."""

    head: pa.Array
    counts: np.ndarray
    train_docs: int
    tokens: int
    words: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    @property
    def log_total(self) -> float:
        return float(np.log10(self.tokens + SMOOTH * (self.words + 1)))

    def class_mass(self) -> np.ndarray:
        """For each class its tokens with smoothing: n, or n + 0.1 (v + 1) for classes of many words."""
        mass = self.class_tokens.astype(np.float64)
        mass[1 + OWN :] += SMOOTH * (self.class_words[1 + OWN :] + 1)
        mass[: 1 + OWN] += SMOOTH * (mass[: 1 + OWN] == 0)
        return mass


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 16 << 20):
            flat, _ = split_words(pc.ascii_lower(batch.column("text")))
            coded = flat.dictionary_encode()
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary)))], ["word", "c"])


def _class_totals(own: pa.Array):
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            at = pc.index_in(batch.column("word"), value_set=own)
            k = np.where(np.asarray(at.is_valid()), 1 + np.asarray(at.fill_null(0)), _ending(batch.column("word")))
            np.add.at(n, k, np.asarray(batch.column("c")))
            np.add.at(v, k, 1)
        used = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(v[used])], ["k", "n", "v"])

    return totals


def _least_count(counts: DataFrame, cells: int = 1024) -> int:
    """The smallest count that at most HEAD words reach. Each step splits the range that holds it into `cells` and counts the words of each."""
    low, high, above = 1, (counts.agg(F.max("c")).first()[0] or 0) + 1, 0
    while high > low:
        width = -(-(high - low) // cells)
        cell = F.floor((F.col("c") - low) / width).alias("cell")
        words = dict(counts.where((F.col("c") >= low) & (F.col("c") < high)).groupBy(cell).count().collect())  # at most `cells` rows
        at = max(words, default=0)
        while at >= 0 and above + words.get(at, 0) <= HEAD:
            above, at = above + words.get(at, 0), at - 1
        if at < 0 or width == 1:
            return low + (at + 1) * width
        low, high = low + at * width, min(high, low + (at + 1) * width)
    return low


def count_words(texts: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """The counts (word, c) of all words of the texts as a table, and their bounded summary. Nothing is cut: rare words stay in the table."""
    counted = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_count, "word string, c long")
    counts = written(counted.groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")
    head = counts.where(F.col("c") >= _least_count(counts)).collect()  # HEAD rows at most
    head.sort(key=lambda r: (-r["c"], r["word"]))
    names = pa.array([r["word"] for r in head], pa.string())
    docs = texts.count()
    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    own = names.slice(0, OWN)
    sums = counts.mapInArrow(_class_totals(own), "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    for r in sums.collect():  # one row for each class
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    n[0], v[0] = docs, int(docs > 0)
    return counts, Vocabulary(names, np.array([r["c"] for r in head], np.int64), docs, int(n.sum()), int(v.sum()), n, v)


CODED = "rid long, doc_id long, held_out boolean, n_tokens long, classes binary, n_known long, own_log double, mid_log double, tail array<string>, tail_n array<int>"


def _code(shared: Broadcast):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        logs = np.log10(vocabulary.counts + SMOOTH)
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = batch.num_rows
                flat, offsets = split_words(pc.ascii_lower(batch.column("text")))
                coded, owner = flat.dictionary_encode(), owners(offsets)
                at = pc.index_in(coded.dictionary, value_set=vocabulary.head)
                place = np.where(np.asarray(at.is_valid()), np.asarray(at.fill_null(0)), -1)
                k = np.where((place >= 0) & (place < OWN), place + 1, _ending(coded.dictionary))
                log = np.where(place >= 0, logs[place] if len(logs) else 0.0, 0.0)
                codes = np.asarray(coded.indices)
                own, known = (place >= 0) & (place < OWN), place >= 0
                own_log = np.bincount(owner, (log * own)[codes], rows)
                mid_log = np.bincount(owner, (log * (known & ~own))[codes], rows)
                n_known = np.bincount(owner, known[codes], rows).astype(np.int64)
                # the end token
                own_log += np.log10(vocabulary.train_docs + SMOOTH)
                n_known += vocabulary.train_docs > 0
                classes = np.insert(k[codes], offsets[1:], 0).astype(np.uint16)
                ends = offsets + np.arange(len(offsets))
                # words beyond the head, once per text with their number
                far = np.flatnonzero(~known[codes])
                pairs, n = np.unique(owner[far].astype(np.int64) * max(1, len(place)) + codes[far], return_counts=True)
                of = pairs // max(1, len(place))
                tail_at = pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32))
                tail = pa.ListArray.from_arrays(tail_at, coded.dictionary.take(pa.array(pairs % max(1, len(place)))))
                tail_n = pa.ListArray.from_arrays(tail_at, pa.array(n.astype(np.int32)))
                raw = [classes[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(ends)), pa.array(raw, pa.binary()), pa.array(n_known), pa.array(own_log), pa.array(mid_log), tail, tail_n], [c.split()[0] for c in CODED.split(", ")])

    return code


@dataclass
class Model:
    start: np.ndarray  # state
    move: np.ndarray  # state, next state
    emit: np.ndarray  # class, state

    @property
    def cells(self) -> int:
        """How many expected counts it is made of."""
        return self.start.size + self.move.size + self.emit.size


def first_model(mass: np.ndarray, states: int) -> Model:
    """All states near the overall class frequencies, each bent by fixed pseudo-random factors."""
    noise = (mix(np.arange(CLASSES * states, dtype=np.uint64) + np.uint64(17)) >> np.uint64(11)).astype(np.float64).reshape(CLASSES, states) * 2.0**-53
    emit = mass[:, None] * (0.4 + 1.2 * noise)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _segments(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes in rows of SEGMENT tokens, the length of each row, and how many rows each text has."""
    parts = [np.frombuffer(x, np.uint16) for x in raw]
    lengths = np.array([len(x) for x in parts], np.int64)
    rows = -(-lengths // SEGMENT)
    flat = np.concatenate([*parts, np.zeros(0, np.uint16)])
    of_row = np.repeat(np.arange(len(parts)), rows)
    turn = np.arange(len(of_row)) - np.repeat(np.cumsum(rows) - rows, rows)
    begin = (np.cumsum(lengths) - lengths)[of_row] + turn * SEGMENT
    size = np.minimum(SEGMENT, lengths[of_row] - turn * SEGMENT)
    at = np.minimum(begin[:, None] + np.arange(SEGMENT), max(0, len(flat) - 1))
    return flat[at] if len(flat) else np.zeros((0, SEGMENT), np.uint16), size, rows


def _transfers(model: Model, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row, up to a factor: how a state before the segment becomes one at its end. A first segment has no move before its first token."""
    states, emit = len(model.start), model.emit[x.T]
    out = emit[0][:, None, :] * np.where(first[:, None, None], np.eye(states), model.move)
    for t in range(1, SEGMENT):
        step = (out.reshape(-1, states) @ model.move).reshape(out.shape)
        step *= emit[t][:, None, :]
        off = np.flatnonzero(size <= t)
        step[off] = out[off]
        out = step
        if t % 8 == 0:
            out /= out.sum(axis=(1, 2), keepdims=True)
    return out / out.sum(axis=(1, 2), keepdims=True)


def _edges(model: Model, x: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: whether it is its text's first, the state before it, and the backward state behind it (both up to a factor)."""
    states, begin, most = len(model.start), np.cumsum(rows) - rows, int(rows.max()) if len(rows) else 0
    first = np.zeros(len(x), bool)
    first[begin[rows > 0]] = True
    before, behind = np.tile(model.start, (len(x), 1)), np.ones((len(x), states))
    # texts of one segment need no transfer
    long = np.flatnonzero(np.repeat(rows > 1, rows))
    over = np.zeros(len(x), np.int64)
    over[long] = np.arange(len(long))
    parts = [_transfers(model, x[part], size[part], first[part]) for part in np.array_split(long, len(long) // ROWS + 1)]
    transfer = np.concatenate(parts) if len(long) else np.zeros((0, states, states))
    for k in range(1, most):
        at = begin[rows > k] + k
        state = np.einsum("ri,rij->rj", before[at - 1], transfer[over[at - 1]])
        before[at] = state / state.sum(axis=1, keepdims=True)
    for k in range(most - 2, -1, -1):
        at = begin[rows > k + 1] + k
        state = np.einsum("rij,rj->ri", transfer[over[at + 1]], behind[at + 1])
        behind[at] = state / state.sum(axis=1, keepdims=True)
    return first, before, behind


def _counts(model: Model, x: np.ndarray, size: np.ndarray, first: np.ndarray, before: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of rows of segments between known states."""
    rows, states = len(x), len(model.start)
    real = np.arange(SEGMENT)[:, None] < size
    full = size.min() == SEGMENT
    emit = model.emit[x.T] if full else np.where(real[:, :, None], model.emit[x.T], 1.0)
    alpha, scale = np.empty((SEGMENT, rows, states)), np.empty((SEGMENT, rows, 1))
    now = np.where(first[:, None], model.start, before @ model.move) * emit[0]
    for t in range(SEGMENT):
        if t:
            now = (alpha[t - 1] @ model.move) * emit[t]
        now.sum(axis=1, keepdims=True, out=scale[t])
        np.divide(now, scale[t], out=alpha[t])
    gamma, moves = np.empty_like(alpha), np.zeros((states, states))
    # a segment with others behind it is full; behind a text's end all states count alike
    beta = behind / (alpha[-1] * behind).sum(axis=1, keepdims=True)
    for t in range(SEGMENT - 1, -1, -1):
        np.multiply(alpha[t], beta, out=gamma[t])
        back = emit[t] * beta / scale[t]
        if t:
            moves += alpha[t - 1].T @ (back if full else back * real[t][:, None])
            beta = back @ model.move.T
        else:
            moves += before[~first].T @ back[~first]
    moves *= model.move
    flat = x.T.ravel()[real.ravel()].astype(np.int64)
    weights = gamma.reshape(-1, states)[real.ravel()]
    emitted = np.stack([np.bincount(flat, weights[:, k], CLASSES) for k in range(states)], axis=1)
    return gamma[0][first].sum(axis=0), moves, emitted


def expected_counts(model: Model, raw: list[bytes]) -> np.ndarray:
    """Expected starts, moves and emissions of whole class sequences under the model, one after the other in one array."""
    x, size, rows = _segments(raw)
    edges, total = _edges(model, x, size, rows), np.zeros(model.cells)
    for at in range(0, len(x), ROWS):
        part = slice(at, at + ROWS)
        total += np.concatenate([c.ravel() for c in _counts(model, x[part], size[part], *(e[part] for e in edges))])
    return total


def train(coded: DataFrame, vocabulary: Vocabulary, states: int = 6, iterations: int = 4) -> Model:
    """Baum-Welch over all coded training texts. Each iteration sums one table of expected counts over the partitions."""
    mass = vocabulary.class_mass()
    model = first_model(mass, states)
    if not vocabulary.train_docs:
        return model
    for _ in range(iterations):
        shared = coded.sparkSession.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            given = shared.value
            total = np.zeros(given.cells)
            for batch in batches:
                for part in slices(batch, "classes", 1 << 20):
                    total += expected_counts(given, part.column("classes").to_pylist())
            whole = np.round(total * UNIT).astype(np.int64)
            used = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(whole[used])], ["cell", "n"])

        sums = np.zeros(model.cells)
        for r in coded.select("classes").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # the size of the model
            sums[r["cell"]] = r["n"] / UNIT
        model = _maximized(sums, mass, states)
        shared.destroy()
    return model


def _maximized(sums: np.ndarray, mass: np.ndarray, states: int) -> Model:
    """The model of expected counts, smoothed."""
    start, move, emit = sums[:states], sums[states : states + states * states].reshape(states, states), sums[states + states * states :].reshape(CLASSES, states)
    # half a token of the overall frequencies keeps every class possible in every state
    emit = emit + 0.5 * (mass / mass.sum())[:, None]
    return Model((start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def forward(model: Model, raw: list[bytes]) -> np.ndarray:
    """log10 of the exact probability of each class sequence; longest first, so that texts leave the batch as they end."""
    parts = [np.frombuffer(x, np.uint16).astype(np.int64) for x in raw]
    lengths = np.array([len(x) for x in parts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    flat = np.concatenate([*parts, np.zeros(0, np.int64)])
    left = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), side="right")
    out, state = np.zeros(len(parts)), np.tile(model.start, (len(parts), 1))
    for t, n in enumerate(left):
        now = state[:n] if not t else state[:n] @ model.move
        now = now * model.emit[flat[begin[:n] + t]]
        scale = now.sum(axis=1)
        out[:n] += np.log10(scale)
        state = now / scale[:, None]
    result = np.empty(len(parts))
    result[order] = out
    return result


def _score(shared: Broadcast):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, class_mass = shared.value
        inner = np.zeros(CLASSES)
        inner[1 + OWN :] = np.log10(class_mass[1 + OWN :])
        for batch in batches:
            raw = batch.column("classes").to_pylist()
            within = np.array([inner[np.frombuffer(x, np.uint16)].sum() for x in raw])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(forward(model, raw) - within)], [*batch.schema.names[:-1], "path_log"])

    return score


def score_texts(docs: DataFrame, held_out, states: int = 6, iterations: int = 4) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs, learning from rows that aren't held_out.

    A null or empty text is one end token. Rows that repeat an id, or have none, are texts of their own. With nothing to learn from
    all words are unknown and the model is its starting point.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    context = docs.sparkSession.sparkContext
    counts, vocabulary = count_words(rows.where(~F.col("held_out")).select("text"))
    coded = written(rows.mapInArrow(_code(context.broadcast(vocabulary)), CODED), "lm-coded")
    model = train(coded.where(~F.col("held_out")), vocabulary, states, iterations)
    tail = coded.select("rid", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("rid", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("n"))
    log = F.log10(F.coalesce("c", F.lit(0)) + SMOOTH) * F.col("n")
    met = tail.join(counts, "word", "left").groupBy("rid").agg(F.sum(log).alias("tail_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    keep = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "own_log", "mid_log"]
    scored = coded.select(*keep, "classes").mapInArrow(_score(context.broadcast((model, vocabulary.class_mass()))), coded.select(*keep).schema.add("path_log", "double"))
    out = scored.join(met, "rid", "left").na.fill(0, ["tail_log", "tail_known"])
    rest = F.col("mid_log") + F.col("tail_log")
    base = F.col("own_log") + rest - F.col("n_tokens") * F.lit(vocabulary.log_total)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("tail_known")).cast("long").alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("path_log") + rest).alias("score"))
