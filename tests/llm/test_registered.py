"""The registered queries without SQL, against brute force over the smallest tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallystone.llm import langid, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def given(small):
    rows = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text", "lang", "source"]).to_pylist()
    return sorted(rows, key=lambda r: r["doc_id"])


def words(text):
    return WORD.findall(text or "")


def by_id(df):
    out = {r["doc_id"]: r for r in df.collect()}
    assert len(out) == df.count()
    return out


def test_op3_phrase_dedup(spark, small, given):
    got, seen = by_id(queries.op3_phrase_dedup(spark, small)), set()
    assert set(got) == {r["doc_id"] for r in given}
    for r in given:
        w = words(r["text"])
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            gone[s : s + 20] |= k in seen
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())


def test_op4_source_mixing(spark, small, given):
    got = by_id(queries.op4_source_mixing(spark, small))
    size = {r["doc_id"]: len(words(r["text"])) for r in given}
    of = {r["doc_id"]: r["source"] for r in given}
    total, taken, largest = (collections.Counter() for _ in range(3))
    for i, n in size.items():
        total[of[i]] += n
        largest[of[i]] = max(largest[of[i]], n)
    names = sorted((s for s in total if s is not None), key=str) + [None] * (None in total)
    weight, left, want, free = {s: 1 + k % 3 for k, s in enumerate(names)}, float(sum(total.values())), {}, set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        want |= {s: 3.0 * total[s] for s in over} if over else share
        left -= sum(3.0 * total[s] for s in over)
        free = free - over if over else set()
    for i, r in got.items():
        assert (r["size"], r["source_size"]) == (size[i], total[of[i]]) and abs(r["target"] - want[of[i]]) < 1e-6 * (1 + want[of[i]])
        assert r["taken"] == 0 if not size[i] else r["taken"] % size[i] == 0 and r["taken"] <= 3 * size[i]
        taken[of[i]] += r["taken"]
    for s, n in want.items():
        assert abs(taken[s] - n) <= largest[s] / 2 + 1e-6 * n, s


def test_op5_language_id(spark, small, given):
    got = by_id(queries.op5_language_id(spark, small))
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    own, letters = langid.profiles(pa.array([r["text"] for r in given], pa.string()), np.arange(len(given)), len(given), langid.DIMENSIONS)
    sums = collections.defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    for r, p in zip(given, own, strict=True):
        if r["lang"] is not None and not out(r["doc_id"]):
            sums[r["lang"]] += p
    right = held = 0
    for r, p, n in zip(given, own, letters, strict=True):
        g = got[r["doc_id"]]
        assert g["held_out"] == out(r["doc_id"])
        if not n:
            assert (g["lang_pred"], g["score"]) == ("und", 0)
            continue
        cosine = {x: p @ v / np.linalg.norm(p) / np.linalg.norm(v) for x, v in sums.items()}
        assert abs(cosine[g["lang_pred"]] - max(cosine.values())) < 1e-6 and abs(g["score"] - max(0, cosine[g["lang_pred"]])) < 1e-6
        if g["held_out"] and r["lang"] is not None:
            held, right = held + 1, right + (g["lang_pred"] == r["lang"])
    assert held > 10 and right >= 0.9 * held


def test_profiles_bind_and_bundle_letter_vectors():
    text, dimensions = "ab a", 64
    vector = {c: langid.letter_vectors(np.array([ord(c)]), dimensions)[0] for c in " ab"}
    want = sum(np.roll(vector[x], 2) * np.roll(vector[y], 1) * vector[z] for x, y, z in (" ab", "ab ", "b a", " a "))
    got, n = langid.profiles(pa.array([text, None, "12"]), np.arange(3), 3, dimensions)
    assert np.array_equal(got[0], want) and list(n) == [3, 0, 0]


def test_op9_token_orc(spark, small, given):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    got, start = by_id(queries.op9_token_orc(spark, small)), 0
    for r in given:
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_predictions_leave_out_columns_of_their_own_names(spark):
    df = spark.createDataFrame([(1, "the house", "en", 7, "x", 1), (2, None, None, 8, None, 2), (None, "12", "en", 9, "y", 3), (1, "the house", "en", 7, "x", 1)], "doc_id long, text string, lang string, Score int, lang_pred string, __text int")
    learned = langid.prototypes(df)
    told = langid.predict(df, learned, df.columns)
    assert told.columns == ["doc_id", "text", "lang", "__text", "lang_pred", "score"]
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in told.collect()) == [("1", "en"), ("1", "en"), ("2", "und"), ("None", "und")]
    kept = langid.identified(df, learned)
    assert kept.columns == df.columns and kept.count() == 2
