"""Spelling variants: words at one edit from each other, found by blocked Gram matrices of letter counts.

One inserted or deleted letter moves a word's vector of letter counts by a squared distance of 1, a replaced one by 2. So words are
dealt to blocks by their length; for a pair of blocks of equal or adjacent lengths one matrix product gives the squared
distances of all their pairs, |x|^2 + |y|^2 - 2 xy, and only pairs at most two apart go on to the exact comparison of their letters. An edit also changes how many
letters of any fixed set a word has by at most one: two such counts split the words of a length further, and only
blocks whose counts can be one edit apart meet.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import spread_join, written

#: Words of one block, and bytes of letters in it.
BLOCK, BLOCK_BYTES = 2048, 4 << 20
#: Distinct words that a task counts before it passes them on.
HELD = 400_000
#: Two sets of letters whose counts split the words of a length.
FIRST_LETTERS, SECOND_LETTERS = "aeghilv", "adknrsu"

_RUN = re.compile("[a-zÀ-ÿ]+")


def _count(modulus: int, least: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                # bytes.lower changes A-Z only
                runs = Counter(_RUN.findall(text.as_buffer().to_pybytes().lower().decode()))
                base = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for run, n in runs.items():
                    size = len(run)
                    if size < least:
                        continue
                    h = zlib.crc32(run.encode(), base)
                    if h % modulus == 0:
                        at = h % size
                        run = run[:at] + run[at + 1 :]
                        if size == least:
                            continue
                    held[run] = held.get(run, 0) + n
                if len(held) >= HELD:
                    yield passed_on()
                    held.clear()
        if held:
            yield passed_on()

    return count


def vocabulary(docs: DataFrame, modulus: int = 199, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n): words of at least min_length letters that occur min_count times in all texts.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. Where the crc32 h of "<doc_id>:<word>" is divisible by
    modulus, the run has lost its letter h % length. Null texts have no words; a null doc_id is written as nothing; rows that repeat an id all count.
    """
    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_count(modulus, min_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _letters(words: pa.Array, length: int) -> np.ndarray:
    """One row of letters per word; every letter has one byte in Latin-1."""
    return np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8).reshape(-1, length)


def _counts(letters: np.ndarray) -> np.ndarray:
    rows = np.repeat(np.arange(len(letters)), letters.shape[1])
    return np.bincount(rows * 256 + letters.ravel(), minlength=256 * len(letters)).reshape(-1, 256).astype(np.float32)


def near_pairs(x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of x and j of y that are one edit apart; y's words are as long as x's or longer by one. same: y is x, so i < j."""
    a = _counts(x)
    b = a if same else _counts(y)
    used = np.flatnonzero(a.any(axis=0) | b.any(axis=0))
    a, b = a[:, used], b[:, used]
    gram = a @ b.T
    distance = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * gram
    i, j = np.nonzero(distance <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    good = np.zeros(len(i), bool)
    step = max(1, (8 << 20) // x.shape[1])
    for at in range(0, len(i), step):
        p, q = x[i[at : at + step]], y[j[at : at + step]]
        if x.shape[1] == y.shape[1]:
            good[at : at + step] = (p != q).sum(axis=1) == 1
        else:
            # letters before the inserted one stand at the same place, letters behind it one place further
            head = np.logical_and.accumulate(p == q[:, :-1], axis=1)
            tail = np.logical_and.accumulate((p == q[:, 1:])[:, ::-1], axis=1)[:, ::-1]
            good[at : at + step] = (np.pad(head, ((0, 0), (1, 0)), constant_values=True) & np.pad(tail, ((0, 0), (0, 1)), constant_values=True)).any(axis=1)
    return i[good], j[good]


def _compare(key: tuple, pair: pa.Table) -> pa.Table:
    """Per word of two blocks: how many near words the other block has, and the most frequent of them."""
    sides, of = [], np.asarray(pair.column("side"))
    for s in (0, 1):
        rows = pair.filter(pa.array(of == s)).combine_chunks()
        sides.append((rows.column("word").combine_chunks() if rows.num_rows else pa.array([], pa.string()), np.asarray(rows.column("n")), rows.column("size")[0].as_py() if rows.num_rows else 1))
    (left, n_left, short), (right, n_right, long) = sides
    same = not len(right)
    x = _letters(left, short)
    y = x if same else _letters(right, long)
    i, j = near_pairs(x, y, same)
    words = np.asarray((left if same else pa.concat_arrays([left, right])).to_pylist(), dtype=object)
    n = n_left if same else np.concatenate([n_left, n_right])
    j = j if same else j + len(left)
    word, near = np.concatenate([i, j]), np.concatenate([j, i])
    # the first near word of each word: largest n, then code-point order
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=lambda k: (-n[k], words[k]))] = np.arange(len(words))
    order = np.lexsort((rank[near], word))
    word, near = word[order], near[order]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    size = np.diff(np.append(first, len(word)))
    best = near[first]
    return pa.table({"word": pa.array(words[word[first]], pa.string()), "n_near": pa.array(size, pa.int64()), "form": pa.array(words[best], pa.string()), "form_n": pa.array(n[best], pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) for words of (word, n) that have near words: how many, and the most frequent of them (ties: smallest). words is a written table."""
    of = lambda letters: F.length("word") - F.length(F.translate("word", letters, ""))
    celled = words.select("word", "n", F.length("word").alias("size"), of(FIRST_LETTERS).alias("f"), of(SECOND_LETTERS).alias("g"))
    cells = celled.groupBy("size", "f", "g").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.count("*") * F.col("size") / BLOCK_BYTES)).cast("int").alias("parts"))
    cells = written(cells, "spelling-cells")
    dealt = celled.join(cells, ["size", "f", "g"]).withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int")).drop("parts")
    dealt = written(dealt, "spelling-blocks")
    # what one edit does to (size, f, g); of cells of one size each pair is met once
    steps = [(0, 0, 0), (0, 0, 1), (0, 1, -1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)]
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("sfg", s, strict=True)]) for s in steps]))
    moved = cells.withColumn("d", step).select(F.col("size").alias("size0"), F.col("f").alias("f0"), F.col("g").alias("g0"), F.col("parts").alias("parts0"), (F.col("size") + F.col("d.s")).alias("size"), (F.col("f") + F.col("d.f")).alias("f"), (F.col("g") + F.col("d.g")).alias("g"))
    met = moved.join(cells, ["size", "f", "g"])
    met = met.withColumn("part0", F.explode(F.sequence(F.lit(0), F.col("parts0") - 1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = (F.col("size0") == F.col("size")) & (F.col("f0") == F.col("f")) & (F.col("g0") == F.col("g"))
    met = met.where(~own | (F.col("part0") <= F.col("part")))
    met = written(met.select("size0", "f0", "g0", "part0", "size", "f", "g", "part", (own & (F.col("part0") == F.col("part"))).alias("alone")), "spelling-pairs")
    place = ["size0", "f0", "g0", "part0", "size1", "f1", "g1", "part1"]
    met = met.withColumnsRenamed({"size": "size1", "f": "f1", "g": "g1", "part": "part1"})
    on = lambda side: [F.col(c) == F.col(c + side) for c in ("size", "f", "g", "part")]
    left = dealt.join(met, on("0")).select(*place, F.lit(0).alias("side"), "size", "word", "n")
    right = dealt.join(met.where("not alone"), on("1")).select(*place, F.lit(1).alias("side"), "size", "word", "n")
    found = left.unionByName(right).groupBy(*place).applyInArrow(_compare, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.w").alias("form"), (-F.col("b.m")).alias("form_n"))


def variants(docs: DataFrame, ratio: int = 5, modulus: int = 199, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word of the vocabulary with the form it is a variant of.

    Two words are near if they differ by exactly one inserted, deleted or replaced letter. A word's form is its near word of largest n (ties: the smallest),
    if that n is at least ratio times the word's own; else null. root: where the chain of forms ends, the word itself without a form.
    Empty tables give no rows; other columns of docs are not looked at.
    """
    words = written(vocabulary(docs, modulus, min_length, min_count), "spelling-words")
    known = words.join(near_words(words), "word", "left").withColumn("good", F.col("form_n") >= ratio * F.col("n"))
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("good"), F.col("form")).alias("form"), F.when(F.col("good"), F.col("form_n")).alias("form_n"))
    known = written(known.withColumn("root", F.coalesce("form", "word")), "spelling-forms")
    # a form is ratio times as frequent as its word, so chains are short and their lengths double in each round
    roots = known.where("form is not null").select("word", "root")
    while True:
        jump = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(spread_join(roots, jump, ["root"]).select("word", F.col("next").alias("root")), "spelling-roots")
        if longer.limit(1).count() == 0:
            break
        roots = written(roots.join(longer.withColumnRenamed("root", "further"), "word", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    out = known.drop("root").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
