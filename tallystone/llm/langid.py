"""Language ID by hyperdimensional profiles.

Each letter has a random +1/-1 vector. The vector of a trigram binds (multiplies) the vectors of its letters,
permuted by their place; a text's profile bundles (adds) its trigrams' vectors, and a language's prototype
bundles the texts of that language. A text gets the language whose prototype has the largest cosine.
Letters are lower-cased; anything between words counts as one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import mix, slices

DIMENSIONS = 1024
SPACE = 32
UNKNOWN = "und"
#: What a Python worker holds at once: bytes and rows of text, characters in trigrams, trigram vectors.
TEXT_BYTES, ROWS, RUN, TILE = 1 << 20, 1024, 1 << 20, 2048


@lru_cache(1)
def letter_table() -> np.ndarray:
    """For each code point: its lower-case letter, or a space."""
    table = np.full(0x110000, SPACE, np.int32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low[0])
    return table


def letter_vectors(letters: np.ndarray, dimensions: int) -> np.ndarray:
    """+1/-1 rows, a fixed function of letter and dimension."""
    cells = mix(letters.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(dimensions, dtype=np.uint64)[None, :] + np.uint64(1))
    return np.where(cells & np.uint64(1), 1, -1).astype(np.float32)


def trigram_vectors(trigrams: np.ndarray, dimensions: int) -> np.ndarray:
    """Bound vectors of trigrams, packed as three 21-bit letters: first permuted twice, second once."""
    parts = [(trigrams >> np.int64(s)) & np.int64(0x1FFFFF) for s in (42, 21, 0)]
    letters, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    base = letter_vectors(letters, dimensions)
    a, b, c = np.split(inverse, 3)
    out = np.roll(base, 2, axis=1)[a]
    out *= np.roll(base, 1, axis=1)[b]
    out *= base[c]
    return out


def trigram_runs(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text index, packed trigram) of every trigram and the number of letters of each text, for runs of at most RUN characters."""
    joined = [f" {t} " for t in pc.fill_null(texts, "").to_pylist()]
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in joined])
    table, before, before_owner = letter_table(), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(codes), RUN):
        part = codes[at : at + RUN]
        letters, owner = table[part].astype(np.int64), np.searchsorted(ends, np.arange(at, at + len(part)), side="right")
        n_letters = np.bincount(owner[letters != SPACE], minlength=len(joined))
        # the last two characters of the run before come first
        letters, owner = np.concatenate([before, letters]), np.concatenate([before_owner, owner])
        keep = np.ones(len(letters), bool)
        keep[1:] = (letters[1:] != SPACE) | (letters[:-1] != SPACE) | (owner[1:] != owner[:-1])
        letters, owner = letters[keep], owner[keep]
        before, before_owner = letters[-2:], owner[-2:]
        same = owner[2:] == owner[:-2]
        yield owner[2:][same], ((letters[:-2] << 42) | (letters[1:-1] << 21) | letters[2:])[same], n_letters


def bundle(owner: np.ndarray, packed: np.ndarray, groups: int, dimensions: int) -> np.ndarray:
    """Sums of trigram vectors by owner, a tile of distinct trigrams at a time."""
    coded = pa.array(packed).dictionary_encode()
    distinct, codes = np.asarray(coded.dictionary), np.asarray(coded.indices).astype(np.int64)
    out = np.zeros((groups, dimensions))
    order = np.argsort(codes // TILE if len(distinct) > TILE << 16 else (codes // TILE).astype(np.uint16), kind="stable")
    owner, codes = owner[order], codes[order]
    tiles = codes // TILE
    for low in range(0, len(distinct), TILE):
        vectors = trigram_vectors(distinct[low : low + TILE], dimensions)
        part = slice(*np.searchsorted(tiles, [low // TILE, low // TILE + 1]))
        cells = owner[part] * len(vectors) + codes[part] - low
        out += np.bincount(cells, minlength=groups * len(vectors)).reshape(groups, -1).astype(np.float32) @ vectors
    return out


def profiles(texts: pa.Array, of: np.ndarray, groups: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The bundled profile of each group of texts, text i being in group of[i], and the number of letters of each text."""
    out, n_letters = np.zeros((groups, dimensions)), np.zeros(len(texts), np.int64)
    for owner, packed, letters in trigram_runs(texts):
        n_letters += letters
        out += bundle(of[owner], packed, groups, dimensions)
    return out, n_letters


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The bundled profile of each non-null lang of docs, from every row; one vector per language reaches the driver."""

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, "text", TEXT_BYTES, ROWS):
                langs = batch.column("lang").dictionary_encode()
                sums, _ = profiles(batch.column("text"), np.asarray(langs.indices).astype(np.int64), len(langs.dictionary), dimensions)
                for lang, row in zip(langs.dictionary.to_pylist(), sums, strict=True):
                    totals[lang] = totals.get(lang, 0) + row
        for lang, row in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(row.astype(np.int64))], ["lang", "dim", "total"])

    rows = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(bundled, "lang string, dim int, total long")
    sums = rows.groupBy("lang", "dim").agg(F.sum("total").alias("total")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "total"))).alias("cells"))
    return {r["lang"]: np.array([c["total"] for c in r["cells"]], np.float64) for r in sums.collect()}


class Guess:
    """Languages of texts by learned prototypes, and the cosines."""

    def __init__(self, learned: dict[str, np.ndarray], dimensions: int):
        self.langs, self.dimensions = sorted(learned), dimensions
        self.matrix = np.array([learned[x] / max(np.linalg.norm(learned[x]), 1e-9) for x in self.langs]).reshape(len(self.langs), dimensions)

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        own, n_letters = profiles(texts, np.arange(len(texts)), len(texts), self.dimensions)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cosines = (own @ self.matrix.T) / np.maximum(np.linalg.norm(own, axis=1), 1e-9)[:, None]
        best = np.round(cosines, 6).argmax(axis=1)
        known = n_letters > 0
        score = np.clip(cosines[np.arange(len(best)), best], 0, 1)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def predict(docs: DataFrame, learned: dict[str, np.ndarray], columns: list[str], dimensions: int = DIMENSIONS) -> DataFrame:
    """The given columns of docs with lang_pred and score (the cosine, 0 to 1). The text alone decides.

    `und` with score 0: a null text, one without letters, or nothing learned. Equal cosines go to the
    smaller language name. Columns named lang_pred or score (in any case) are left out.
    """
    guess = Guess(learned, dimensions)
    columns = [c for c in columns if c.lower() not in ("lang_pred", "score")]
    given = docs.select(*[docs[f"`{c}`"] for c in columns], *([] if "text" in columns else ["text"]))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", TEXT_BYTES, ROWS):
                names, score = guess(batch.column("text"))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(names, pa.string()), pa.array(score)], [*columns, "lang_pred", "score"])

    return given.mapInArrow(told, docs.select(*[docs[f"`{c}`"] for c in columns]).schema.add("lang_pred", "string").add("score", "double"))


def identified(docs: DataFrame, learned: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows of docs whose language can be told, with their columns: those with a letter, if anything was learned."""
    guess = Guess(learned, dimensions)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", TEXT_BYTES, ROWS):
                yield batch.filter(pa.array([name != UNKNOWN for name in guess(batch.column("text"))[0]], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
