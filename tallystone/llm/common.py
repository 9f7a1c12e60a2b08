"""Helpers shared by the training-data operators: scratch tables, text columns, Arrow word arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.sources.scratch import new_path, written

__all__ = ["new_path", "written"]

# The white space that separates words and pads lines, and the ASCII capitals.
WHITE_SPACE = " \t\n\x0b\x0c\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows of a key that make it frequent, and rows of ids or keys that are broadcast at most.
HOT_ROWS, BROADCAST_ROWS = 1000, 1_000_000
#: Rows of a few numbers each that one task can join whole, so that no key of theirs needs to be spread.
FEW_ROWS = 100_000
#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 4 << 20


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], few: int = 0) -> DataFrame:
    """The inner join of a written table with a table of one row per key, where no task gets all rows of a frequent key.

    A table of at most `few` rows has no such key. Else keys of more than HOT_ROWS rows of big meet their rows where these are read. There are at most BROADCAST_ROWS such keys, as the bound
    rises with the table, so what is broadcast is bounded; all other keys are shuffled.
    """
    n = big.count()
    if n <= few:
        return big.join(small, keys)
    most = max(HOT_ROWS, n // BROADCAST_ROWS)
    hot = written(big.groupBy(*keys).count().where(F.col("count") > most).select(*keys), "hot-keys")
    if hot.limit(1).count() == 0:
        return big.join(small, keys)
    few = F.broadcast(small.join(F.broadcast(hot), keys, "left_semi"))
    rest = big.join(F.broadcast(hot), keys, "left_anti").join(small, keys)
    return rest.unionByName(big.join(few, keys))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII text takes the fast built-in."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def words_column(text: Column) -> Column:
    """Runs of characters other than space and \\t..\\r, in order; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most so many rows and bytes of the column (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        floor = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, floor + most, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one array, and where each text's words begin (one more entry at the end)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    keep = np.asarray(pc.binary_length(flat)) > 0
    if not keep.all():
        flat = flat.filter(pa.array(keep))
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
    return flat, offsets


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    from pandas.util import hash_array

    return hash_array(values.to_numpy(zero_copy_only=False).astype(object, copy=False), categorize=False) if len(values) else np.zeros(0, np.uint64)


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    coded = flat.dictionary_encode()
    return hash_strings(coded.dictionary)[np.asarray(coded.indices)]


def rolling(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of n consecutive values (runs may cross texts; the caller masks those)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    factors = mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(1000 * seed)) | np.uint64(1)
    total = np.zeros(count, np.uint64)
    for j in range(n):
        total += hashes[j : j + count] * factors[j]
    return mix(total)


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
