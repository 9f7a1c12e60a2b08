"""Token ids as ORC: stripes of run-length-encoded integers, with row indexes and Bloom filters on doc_id.

Documents are range-partitioned by doc_id, so part k of the table holds smaller ids than part k+1, and every
part is sorted; part files have row indexes (min, max per row group) and a Bloom filter on doc_id, so
a lookup by id reads only the stripes that can hold it. ORC splits at stripes, so one part is
read by many tasks.

Encoding goes by distinct chunks: a text is cut before white space that follows something that is surely none, and
before punctuation that follows a letter. No pre-token of this byte-level BPE spans such a cut, so the ids of a text
are those of its chunks in order, and each distinct chunk of a slice goes through the tokenizer once.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystone.llm.common import new_path, partitions, slices

ENCODED = "doc_id long, part int, part_row long, part_start long, n_tokens long, tokens array<int>"
#: Bytes of distinct chunks that the tokenizer gets as one string.
RUN_BYTES = 1 << 16

_CODE = np.arange(256)
_LETTER = ((_CODE | 32) >= 97) & ((_CODE | 32) <= 122) & (_CODE < 128)
_PUNCTUATION = (_CODE > 32) & (_CODE < 127) & ~_LETTER & ~((_CODE >= 48) & (_CODE <= 57))
_LATIN = (_CODE >= 0x80) & (_CODE < 0xC0) & (_CODE != 0x97) & (_CODE != 0xB7)  # after 0xC3: letters


def cuts(data: np.ndarray, special: bool) -> np.ndarray:
    """Flags of the bytes of UTF-8 before which it may be cut. special: the text holds special tokens, so only white space cuts."""
    letter = _LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
    solid = letter | ((data > 0x20) & (data < 0x7F))
    out = np.zeros(len(data), bool)
    out[1:] = ((data[1:] == 0x20) | (data[1:] == 0x0A)) & solid[:-1]
    if not special:
        out[1:] |= _PUNCTUATION[data[1:]] & letter[:-1]
    return out


class Encoder:
    """Ids of whole texts, by a tokenizer file of byte-level BPE."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in added.values()]
        size = self.tokenizer.get_vocab_size()
        # byte-level BPE writes each byte as one character
        self.width = np.array([len(added[i].content.encode()) if i in added else len(self.tokenizer.id_to_token(i)) for i in range(size)], np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def chunks(self, distinct: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks, one chunk after the other, and where each chunk's begin."""
        at = np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1, distinct.offset * 4).astype(np.int64)
        data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)
        low, high = data[at[:-1]], data[np.maximum(at[1:] - 1, 0)]
        before = data[np.maximum(at[1:] - 2, 0)]
        # chunks that start with white space and end solid can follow each other in one string: the cuts are boundaries there, too
        joins = ((low == 0x20) | (low == 0x0A)) & (at[1:] - at[:-1] > 1) & (((high > 0x20) & (high < 0x7F)) | ((before == 0xC3) & (high >= 0x80) & (at[1:] - at[:-1] > 2)))
        easy, hard = np.flatnonzero(joins), np.flatnonzero(~joins)
        parts, lengths = [], np.zeros(len(distinct), np.int64)
        if len(easy):
            words = distinct.take(pa.array(easy))
            ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1).astype(np.int64)
            raw = words.buffers()[2].to_pybytes()
            runs = np.unique(np.searchsorted(ends, np.append(np.arange(0, ends[-1], RUN_BYTES), ends[-1])))
            ids = np.concatenate(self._ids([raw[ends[a] : ends[b]].decode() for a, b in zip(runs[:-1], runs[1:], strict=True)]))
            reach = np.searchsorted(np.cumsum(self.width[ids]), ends[1:], side="left") + 1
            lengths[easy] = np.diff(np.concatenate(([0], reach)))
            parts.append(ids)
        if len(hard):
            own = self._ids(distinct.take(pa.array(hard)).to_pylist())
            lengths[hard] = [len(x) for x in own]
            parts += own
        # ids stand as they were made: easy chunks, then hard ones
        order = np.concatenate([easy, hard])
        starts = np.empty(len(distinct), np.int64)
        starts[order] = np.concatenate(([0], np.cumsum(lengths[order])[:-1])) if len(order) else []
        return np.concatenate([*parts, np.zeros(0, np.int32)]), np.stack([starts, lengths])

    def __call__(self, texts: pa.Array, end_id: int | None) -> pa.ListArray:
        """The ids of each text, with end_id behind them; a null text has no ids of its own."""
        texts = pc.fill_null(texts, "")
        ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends, raw = ends - ends[0], data.tobytes()
        flags = np.zeros(len(data) + 1, bool)
        flags[:-1] = cuts(data, any(x in raw for x in self.special))
        flags[ends] = True
        bounds = np.flatnonzero(flags).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(raw)).dictionary_encode()
        codes = np.asarray(pieces.indices)
        flat, (starts, lengths) = self.chunks(pieces.dictionary)
        lengths = lengths[codes]
        out_at = np.concatenate(([0], np.cumsum(lengths)))
        offsets = out_at[np.searchsorted(bounds, ends)]
        step = np.ones(out_at[-1], np.int32)
        full = np.flatnonzero(lengths)
        begin = starts[codes[full]]
        step[out_at[full]] = begin
        step[out_at[full[1:]]] -= begin[:-1] + lengths[full[:-1]] - 1
        tokens = flat[np.cumsum(step, dtype=np.int32)]
        if end_id is not None:
            tokens = np.insert(tokens, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens))


@lru_cache(1)
def encoder_of(tokenizer_path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(tokenizer_path)


def starts_path(path: str) -> str:
    """The table of (part, begin) that belongs to the token table at path."""
    return path.rstrip("/") + "-starts"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, parts: int | None = None, stripe_bytes: int = 16 << 20, fpp: float = 0.01) -> None:
    """Writes (doc_id, part, part_row, part_start, n_tokens, tokens) of every row of docs, in ascending doc_id order.

    Every text, null as empty, is followed by end_id. Rows without id come first; rows that share an
    id stand in the order of their texts. Other columns of docs are not written.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, row, start = encoder_of(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        for whole in batches:
            for batch in slices(whole, "text", 16 << 20):
                tokens = encoder(batch.column("text"), end_id)
                n = np.diff(np.asarray(tokens.offsets)).astype(np.int64)
                begin = start + np.concatenate(([0], np.cumsum(n)[:-1]))
                columns = [batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(row, row + len(n))), pa.array(begin), pa.array(n), tokens]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "part_row", "part_start", "n_tokens", "tokens"])
                row, start = row + len(n), start + int(n.sum())

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    ordered = docs.repartitionByRange(parts or partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(encode, ENCODED)
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(fpp), "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(stripe_bytes)}
    encoded.write.options(**options).orc(path)
    # where each part begins, beside the table: one small row per part, so that a lookup reads no counts of other parts
    spark = docs.sparkSession
    sums = spark.read.schema(ENCODED).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("begin")).coalesce(1).write.parquet(starts_path(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens): start counts the ids of all documents before this one, by the parts' starts that were written with the table."""
    begin = spark.read.schema("part int, begin long").parquet(starts_path(path))
    table = spark.read.schema(ENCODED).orc(path)
    return table.join(F.broadcast(begin), "part").select("doc_id", (F.col("begin") + F.col("part_start")).alias("start"), "n_tokens", "tokens")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; stripes whose index or Bloom filter rules the ids out are not read."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids))


def _crc32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        offsets = np.asarray(lists.offsets)
        data = np.asarray(lists.values).astype("<u4", copy=False)
        crc = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the crc32 of each document's ids as little-endian 32-bit integers."""
    return tokens.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(_crc32, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Writes docs to a new table in the shared folder and returns checksums of what is read from it."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return checksums(read_tokens(docs.sparkSession, path))

