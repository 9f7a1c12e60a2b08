"""Spelling variants against brute force."""

import collections
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallystone.llm import queries, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, modulus=199, least=6, times=5, ratio=5):
    """{word: (word, form, root, n, n_near, form_n)} by comparing each word with all words that share it less one letter."""
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least
    n = {w: c for w, c in n.items() if c >= times}
    sharing = collections.defaultdict(set)
    for w in n:
        for k in range(len(w)):
            sharing[w[:k] + "*" + w[k + 1 :]].add(w)
            sharing[w[:k] + w[k + 1 :]].add(w)
        sharing[w].add(w)
    near = {w: set() for w in n}
    for key, ws in sharing.items():
        for w in ws:
            # words that share a deletion only are two edits apart
            near[w] |= {x for x in ws if "*" in key or key in (x, w)}
    form = {}
    for w in n:
        best = min(near[w] - {w}, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (w, form[w], root(w), n[w], len(near[w] - {w}), n[form[w]] if form[w] else None) for w in n}


def result(df):
    out = {r["word"]: tuple(r) for r in df.collect()}
    assert len(out) == df.count()
    return out


def test_op13_spelling_variants(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = result(queries.op13_spelling_variants(spark, small))
    assert got == expected(rows) and any(r[1] for r in got.values())


@pytest.mark.parametrize("block", [3, 2048])
def test_small_blocks_chains_ties_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = np.random.default_rng(2)
    stems = ["straßenbahn", "reception", "Élégance", "mississippi", "aaaaaaa", "banana", "bananas"]
    rows = []
    for k in range(300):
        word = stems[k % len(stems)]
        for _ in range(rng.integers(0, 3)):
            at = rng.integers(0, len(word))
            word = [word[:at] + word[at + 1 :], word[:at] + "xé"[k % 2] + word[at:], word[:at] + "e" + word[at + 1 :]][rng.integers(0, 3)]
        rows.append((int(k // 2) if k % 7 else None, " ".join([word] * int(rng.integers(1, 40)) + ["short", "ab", "×÷×÷×÷", "x" * 300]), k, "clash"))
    rows += [(1, None, 0, "clash"), (2, "", 0, "clash"), (3, "reception", 0, "clash"), (3, "reception", 0, "clash"), (4, "12 34 Ā é", 0, "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, Word string").repartition(3)
    want = expected([r[:2] for r in rows])
    assert result(spelling.variants(docs)) == want
    assert any(r[2] not in (r[0], r[1]) for r in want.values()), "no chain of forms in the fixture"
    assert spelling.variants(docs.where("n < 0")).count() == 0


def test_near_pairs_are_those_at_one_edit():
    words = ["abcdef", "abcdfe", "abcxef", "bacdef", "abcdeff"[:6], "aabbcc"]
    x = np.array([[ord(c) for c in w] for w in words], np.uint8)
    i, j = spelling.near_pairs(x, x, True)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted((a, b) for a in range(6) for b in range(a + 1, 6) if sum(p != q for p, q in zip(words[a], words[b], strict=True)) == 1)
    longer = ["abcdefg", "gabcdef", "abxcdef", "abcfde1", "aabcdef"]
    y = np.array([[ord(c) for c in w] for w in longer], np.uint8)
    i, j = spelling.near_pairs(x, y, False)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted((a, b) for a in range(6) for b in range(5) if any(longer[b][:k] + longer[b][k + 1 :] == words[a] for k in range(7)))
