"""Alignment of two tokenizers' tokens of one text, by diagonal run skipping.

Both token sequences cover the same bytes, so they are compared by the byte offsets where their tokens end. While tokens match one to one, the index of
one sequence runs at a fixed shift from that of the other: blocks of doubling size are compared at that shift, then halved, which jumps to the end of the
stretch in a few comparisons of whole blocks. Where the ends differ, the tokens are walked one by one up to the next common end, which
gives an irregular group, and the shift changes to what it is there.

Links (token occurrences whose bytes overlap) are counted by id pair over the whole corpus. The `head` most frequent pairs are broadcast, as their number is
bounded; documents meet the counts of all other pairs in a join.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import owners, slices, written
from tallystone.llm.token_orc import Encoder

#: Pairs of ids whose counts are broadcast at most, and bytes of text that are aligned at once.
HEAD, ALIGNED_BYTES = 1 << 20, 2 << 20
#: Pairs that a task holds before it sums them up.
HELD = 4 << 20

ALIGNED = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of byte-level BPE stands for: printable Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat that the codes name, one after the other, and where each ends."""
    n = lengths[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[codes] - ends + n, n) + np.arange(total)], ends


class PlainEncoder(Encoder):
    """Byte-level BPE that takes the strings of special tokens as plain text."""

    def __init__(self, tokenizer_path: str):
        super().__init__(tokenizer_path)
        self.tokenizer.encode_special_tokens, self.special = True, []
        added, alphabet = self.tokenizer.get_added_tokens_decoder(), byte_alphabet()
        self.token_bytes = [added[i].content.encode() if i in added else bytes(alphabet[c] for c in self.tokenizer.id_to_token(i)) for i in range(self.tokenizer.get_vocab_size())]

    def encode(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(raw))
        lists = self(texts, None)
        return np.asarray(lists.values), np.asarray(lists.offsets)[1:].astype(np.int64)


class PieceEncoder:
    """A sentencepiece BPE model, which puts a space before a text, with byte fallback.

    BPE only ever joins neighbours into what its vocabulary holds. So between two bytes that no piece has side by side a text
    can be cut, and its ids are those of its chunks; each distinct chunk goes through the model once. Where the model rewrites text
    or has pieces with line ends, texts are encoded whole.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        byte = [re.fullmatch("<0x([0-9A-F]{2})>", p) for p in pieces]
        self.token_bytes = [bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode() for p, m in zip(pieces, byte, strict=True)]
        self.joined = np.zeros((256, 256), bool)
        for b, m in zip(self.token_bytes, byte, strict=True):
            if not m and len(b) > 1:
                pair = np.frombuffer(b, np.uint8)
                self.joined[pair[:-1], pair[1:]] = True
        self.line_end = next((i for i, b in enumerate(self.token_bytes) if b == b"\n"), None)
        probe = "a  b ﬁ "
        same = b"".join(self.token_bytes[i] for i in self.model.encode(probe)) == b" " + probe.encode()
        self.by_chunks = same and self.line_end is not None and not self.joined[10].any() and not self.joined[:, 10].any()

    def chunks(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the chunks, where each chunk's begin, and how many there are. Line ends, which stand alone, part the chunks of a run."""
        runs, run, size = [], [], 0
        for x in distinct:
            run.append("" if x == "\n" else x)
            size += len(x)
            if size > 1 << 16:
                runs.append(run)
                run, size = [], 0
        texts = ["\n" + "\n".join(r) for r in [*runs, run] if r]
        ids = [np.asarray(x, np.int32) for x in self.model.encode(texts, num_threads=1)] if texts else []
        parts, lengths = [], []
        for own in ids:
            marks = np.flatnonzero(own == self.line_end)
            lengths.append(np.diff(np.append(marks, len(own))) - 1)
            keep = np.ones(len(own), bool)
            keep[: marks[0]] = keep[marks] = False
            parts.append(own[keep])
        flat, lengths = np.concatenate([*parts, np.zeros(0, np.int32)]), np.concatenate([*lengths, np.zeros(0, np.int64)])
        starts = np.cumsum(lengths) - lengths
        alone = [i for i, x in enumerate(distinct) if x == "\n"]
        starts[alone], lengths[alone] = len(flat), 1
        return np.append(flat, np.int32(self.line_end)), starts, lengths

    def encode(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that each begin with a space, or are empty, and where each text's end."""
        begins = np.concatenate(([0], ends[:-1]))
        if not self.by_chunks:
            ids = self.model.encode([raw[a + 1 : b].decode() for a, b in zip(begins, ends, strict=True)], num_threads=1)
            return np.concatenate([*(np.asarray(x, np.int32) for x in ids), np.zeros(0, np.int32)]), np.cumsum([len(x) for x in ids])
        data = np.frombuffer(raw, np.uint8)
        flags = np.zeros(len(data) + 1, bool)
        flags[1:-1] = ~self.joined[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        flags[begins] = flags[ends] = True
        bounds = np.flatnonzero(flags).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(raw)).dictionary_encode()
        tokens, reach = gathered(*self.chunks(coded.dictionary.to_pylist()), np.asarray(coded.indices))
        return tokens, np.concatenate(([0], reach))[np.searchsorted(bounds, ends)]


@lru_cache(1)
def encoders_of(a_path: str, b_path: str) -> tuple[PlainEncoder, PieceEncoder]:
    """One pair of encoders for all tasks of a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PlainEncoder(a_path), PieceEncoder(b_path)


def _stretches(begin: list[int], size: np.ndarray) -> np.ndarray:
    return np.repeat(np.asarray(begin, np.int64) - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two rising sequences with the same last value: the last tokens (a, b) of each group in order, and all links (a, b), in order.

    Runs of one-to-one tokens are jumped by blocks that double, then halve, at the current shift; between them tokens are walked.
    """
    width = 8
    xs, ys = a_ends.astype(np.int64).tobytes(), b_ends.astype(np.int64).tobytes()
    x, y = array("q"), array("q")
    x.frombytes(xs)
    y.frombytes(ys)
    run_a, run_b, run_n, link_a, link_b, last_a, last_b = [], [], [], [], [], [], []
    i, j, n = 0, 0, len(x)
    while i < n:
        p, q = x[i], y[j]
        if p == q:
            k, shift, step = i + 1, (j - i) * width, 1
            while k < n and xs[k * width : (k + step) * width] == ys[k * width + shift : (k + step) * width + shift]:
                k += step
                step += step
            if k < n:
                while step > 1:
                    step //= 2
                    if xs[k * width : (k + step) * width] == ys[k * width + shift : (k + step) * width + shift]:
                        k += step
            k = min(k, n)
            run_a.append(i)
            run_b.append(j)
            run_n.append(k - i)
            i, j = k, k + shift // width
        else:
            while p != q:
                link_a.append(i)
                link_b.append(j)
                if p < q:
                    i += 1
                    p = x[i]
                else:
                    j += 1
                    q = y[j]
            link_a.append(i)
            link_b.append(j)
            last_a.append(i)
            last_b.append(j)
            i, j = i + 1, j + 1
    size = np.asarray(run_n, np.int64)
    one_a, one_b = _stretches(run_a, size), _stretches(run_b, size)
    both = lambda ones, more: np.sort(np.concatenate([ones, np.asarray(more, np.int64)]))
    return both(one_a, last_a), both(one_b, last_b), both(one_a, link_a), both(one_b, link_b)


def _same_bytes(table: pa.Array, tokens: np.ndarray, at: np.ndarray, raw: bytes, ends: np.ndarray) -> np.ndarray:
    """Whether the bytes of each text's tokens are the text."""
    made = table.take(pa.array(tokens))
    reach = np.frombuffer(made.buffers()[1], np.int32, len(made) + 1).astype(np.int64)
    own = made.buffers()[2].to_pybytes()[: reach[-1]] if len(made) else b""
    if own == raw and np.array_equal(reach[at], ends):
        return np.ones(len(ends), bool)
    cut = np.concatenate(([0], reach[at]))
    text = np.concatenate(([0], ends))
    return np.array([own[cut[k] : cut[k + 1]] == raw[text[k] : text[k + 1]] for k in range(len(ends))], bool)


def _kept(tokens: np.ndarray, at: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of good texts only."""
    n = np.diff(at, prepend=0)
    return tokens[np.repeat(good, n)], np.cumsum(np.where(good, n, 0))


def _align_texts(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = encoders_of(a_path, b_path)
        a_bytes, b_bytes = pa.array(a.token_bytes, pa.binary()), pa.array(b.token_bytes, pa.binary())
        a_width, b_width = (np.array([len(x) for x in e.token_bytes], np.int64) for e in (a, b))
        va, vb = len(a_width), len(b_width)
        # how a token is written: inside its group, at its end, at the end of its text
        names = [f"{i}{s}" for s in ",|" for i in range(va)] + [f"{i}{s}" for s in (",", ";", "") for i in range(vb)]
        names = pa.array(names, pa.string())
        for whole in batches:
            for batch in slices(whole, "text", ALIGNED_BYTES):
                texts = batch.column("text")
                # U+2581 is read as a space, so its bytes never come back
                usable = pc.and_(pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0), pc.invert(pc.fill_null(pc.match_substring(texts, "▁"), False)))
                spaced = pc.if_else(usable, pc.binary_join_element_wise(" ", pc.fill_null(texts, ""), ""), "")
                sizes = np.asarray(pc.binary_length(spaced)).astype(np.int64)
                ends, raw = np.cumsum(sizes), b"".join(x.as_buffer().to_pybytes() for x in spaced)
                at, bt = a.encode(raw, ends), b.encode(raw, ends)
                good = _same_bytes(a_bytes, *at, raw, ends) & _same_bytes(b_bytes, *bt, raw, ends)
                (ta, ea), (tb, eb) = (at, bt) if good.all() else (_kept(*at, good), _kept(*bt, good))
                ga, gb, la, lb = align(np.cumsum(a_width[ta]), np.cumsum(b_width[tb]))
                # groups as text: each group's tokens of a, then its tokens of b
                group_a, group_b = np.searchsorted(ga, np.arange(len(ta))), np.searchsorted(gb, np.arange(len(tb)))
                codes = np.empty(len(ta) + len(tb), np.int64)
                ends_a, ends_b = np.zeros(len(ta), np.int64), np.zeros(len(tb), np.int64)
                ends_a[ga], ends_b[gb] = 1, 1
                ends_b[eb[np.diff(eb, prepend=0) > 0] - 1] = 2
                codes[np.arange(len(ta)) + np.concatenate(([0], gb + 1))[group_a]] = ta + va * ends_a
                codes[np.arange(len(tb)) + (ga + 1)[group_b]] = 2 * va + tb + vb * ends_b
                said = names.take(pa.array(codes))
                reach = np.frombuffer(said.buffers()[1], np.int32, len(said) + 1)
                text_at = np.ascontiguousarray(reach[np.concatenate(([0], ea + eb))])
                groups = pa.StringArray.from_buffers(batch.num_rows, pa.py_buffer(text_at), said.buffers()[2] if len(said) else pa.py_buffer(b""))
                # links by text and id pair
                of = owners(np.concatenate(([0], ea)))[la]
                pairs, times = np.unique(of * (va * vb) + ta[la].astype(np.int64) * vb + tb[lb], return_counts=True)
                pair_at = pa.array(np.searchsorted(pairs // (va * vb), np.arange(batch.num_rows + 1)).astype(np.int32))
                count = lambda e: pa.array(np.diff(e, prepend=0))
                columns = [batch.column("rid"), batch.column("doc_id"), count(ea), count(eb), count(np.searchsorted(ga, ea)), count(np.searchsorted(la, ea)), groups]
                columns += [pa.ListArray.from_arrays(pair_at, pa.array(pairs % (va * vb))), pa.ListArray.from_arrays(pair_at, pa.array(times.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ALIGNED.split(", ")])

    return run


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(rid, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times), one row per row of docs.

    Space and text go through the byte-level BPE at a_path, the text through the sentencepiece model at b_path, which adds that space itself; strings of special
    tokens are plain text. groups: `a1,a2|b1;a3|b2,b3`, ids between common byte offsets. pairs: the distinct linked id pairs (a * size of b's vocabulary + b),
    times: how many links have them. Null and empty texts and those that do not come back byte for byte have no tokens: zeros and an empty text.
    Rows that repeat an id, or have none, stand for themselves. Both files must exist where the tasks run. Memory follows the largest text.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_align_texts(a_path, b_path), ALIGNED)


def _sum_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs, times, held = [], [], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([*pairs, np.zeros(0, np.int64)]), return_inverse=True)
        return keys, np.round(np.bincount(at, np.concatenate([*times, np.zeros(0, np.int64)]), len(keys))).astype(np.int64)

    def batch_of(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])

    for batch in batches:
        pairs.append(np.asarray(batch.column("pairs").flatten()))
        times.append(np.asarray(batch.column("times").flatten()).astype(np.int64))
        held += len(pairs[-1])
        if held > HELD:
            keys, n = summed()
            if len(keys) > HELD // 2:
                yield batch_of(keys, n)
                keys, n = keys[:0], n[:0]
            pairs, times, held = [keys], [n], len(keys)
    yield batch_of(*summed())


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): how many links of the whole corpus have each id pair, and whether none of its b id has more."""
    counts = written(aligned.select("pairs", "times").mapInArrow(_sum_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "align-counts")
    most = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("most"))  # at most b's vocabulary
    return counts.join(F.broadcast(most), F.col("pair") % b_size == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _least_of_head(counts: DataFrame, head: int) -> int:
    """The least count so that at most `head` pairs have as many or more, to a sixteenth of a power of two."""
    level = F.floor(F.log2("n") * 16).cast("int")
    kept = 0
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs"), F.min("n").alias("least"), F.max("n").alias("most")).orderBy(F.desc("level")).collect():  # a thousand rows at most
        kept += r["pairs"]
        if kept > head:
            return r["most"] + 1
    return 1


def score_links(aligned: DataFrame, b_size: int, head: int = HEAD) -> DataFrame:
    """aligned, a written table, without pairs and times, with n_best (links whose count is the highest of their b id) and count_sum (counts over all links)."""
    counts = written(pair_counts(aligned, b_size), "align-pairs")
    least = _least_of_head(counts, head)
    top = counts.where(F.col("n") >= least).toArrow()  # `head` rows at most
    keys = np.asarray(top["pair"])
    order = np.argsort(keys)
    plain = [c for c in aligned.columns if c not in ("pairs", "times")]
    shared = aligned.sparkSession.sparkContext.broadcast((keys[order], np.asarray(top["n"])[order], np.asarray(top["best"])[order].astype(np.int64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = (np.append(x, 0) for x in shared.value)
        keys[-1] = -1
        for batch in batches:
            lists = batch.column("pairs")
            pairs, times = np.asarray(lists.flatten()), np.asarray(batch.column("times").flatten()).astype(np.int64)
            offsets = np.asarray(lists.offsets).astype(np.int64)
            at = np.searchsorted(keys[:-1], pairs)
            known = keys[at] == pairs
            add = lambda values: np.diff(np.concatenate(([0], np.cumsum(np.where(known, values, 0))))[offsets - offsets[0]])
            rest = np.flatnonzero(~known)
            rest_at = pa.array(np.searchsorted(rest, offsets - offsets[0]).astype(np.int32))
            sums, left = [pa.array(add(times * best[at])), pa.array(add(times * n[at]))], [pa.ListArray.from_arrays(rest_at, pa.array(x[rest])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), *sums, *left], [*plain, "n_best", "count_sum", "rest", "rest_times"])

    schema = ", ".join(f"{c} {kind}" for c, kind in aligned.dtypes if c in plain) + ", n_best long, count_sum long, rest array<long>, rest_times array<long>"
    scored = aligned.mapInArrow(score, schema)
    if least == 1:
        return scored.drop("rest", "rest_times")
    scored = written(scored, "align-scored")
    seldom = scored.where(F.size("rest") > 0).select("rid", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("rid", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("times"))
    # none of these pairs is frequent, so the join has no large key
    more = seldom.join(counts.where(F.col("n") < least), "pair").groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = scored.join(more, "rid", "left")
    return out.select(*plain, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))


def vocabulary_size(model_path: str) -> int:
    """How many ids a sentencepiece model has."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path).vocab_size()


def aligned_links(docs: DataFrame, a_path: str, b_path: str, head: int = HEAD) -> DataFrame:
    """(rid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum): alignments with the groups as a digest, and what the corpus tells of their links.

    groups_sha256 is '' without tokens. An empty table gives no rows.
    """
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    table = written(alignments(docs, a_path, b_path).select("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"), "aligned")
    return score_links(table, vocabulary_size(b_path), head)
