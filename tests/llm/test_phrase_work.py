"""The work of op3's Python steps, in this process: what goes through the automaton, and what cutting costs."""

import collections
import time

import numpy as np
import pyarrow as pa
import pytest

from tallystone.llm import common, phrase_dedup


def batch(rows):
    """Rows (route, doc_id, sub, first, hot, words) as the shards get them."""
    rows = sorted(rows, key=lambda r: r[:4])
    columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [(r[3] << 32) | r[4] for r in rows], [" ".join(r[5]) for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.string())], ["route", "doc_id", "sub", "place", "passage"])


def located(rows, window):
    removed, told = set(), collections.Counter()
    for out in phrase_dedup._locate(window, phrase_dedup.ROW)([batch(rows)]):
        for doc, sub, run, phrase in zip(*(out.column(i).to_pylist() for i in range(4)), strict=True):
            a, b = run >> 32, run & 0xFFFFFFFF
            if phrase is None:
                removed |= {(doc, sub, p) for p in range(a, b + 1)}
            else:
                assert a == b
                told[doc, sub, a, phrase] += 1
    return removed, told


@pytest.mark.parametrize("seed", range(20))
def test_a_shard_tells_what_brute_force_tells(seed):
    rng, window = np.random.default_rng(seed), 4
    texts = [[f"w{x}é" for x in rng.integers(0, 3, rng.integers(window, 9))] for _ in range(12)]
    rows = []
    for doc in range(60):
        first = 0
        for _ in range(rng.integers(1, 4)):
            words = texts[rng.integers(0, len(texts))]
            rows.append((1, doc // 2, doc % 2, first, int(rng.integers(0, 2)), words))
            first += len(words) + int(rng.integers(0, 3))
    # rows that repeat id and text stand here twice
    rows += [rows[k] for k in rng.integers(0, len(rows), 5)]
    windows = [(tuple(r[5][j : j + window]), (r[1], r[2], r[3] + j), r[4]) for r in rows for j in range(len(r[5]) - window + 1)]
    least = {}
    for words, at, _ in windows:
        least[words] = min(least.get(words, at), at)
    removed, told = located(rows, window)
    assert removed == {at for words, at, _ in windows if at != least[words]}
    assert told == collections.Counter((*at, " ".join(words)) for words, at, hot in windows if hot and at == least[words])


def test_passages_of_the_same_words_go_through_the_automaton_once(monkeypatch):
    streamed, letters = [], phrase_dedup._letters
    monkeypatch.setattr(phrase_dedup, "_letters", lambda codes: streamed.append(len(codes)) or letters(codes))
    words = [f"w{k}" for k in range(26)]
    removed, _ = located([(1, doc, 0, 5, 0, words) for doc in range(300)], 20)
    assert removed == {(doc, 0, p) for doc in range(1, 300) for p in range(5, 12)}
    assert sum(streamed) == 26


def test_cutting_costs_about_what_splitting_and_joining_cost():
    rng = np.random.default_rng(0)
    texts = [" \t".join(f"w{x}" for x in rng.integers(0, 5000, 400)) for _ in range(1000)] + [None, "", " \n", "one"]
    given = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t or "" for t in texts]), pa.array([[(3 << 32) | 9]] * 1000 + [[]] * 4, pa.list_(pa.int64()))], ["doc_id", "text", "runs"])

    def took(f):
        began = time.process_time()
        return f(), time.process_time() - began

    plain, usual = min((took(lambda: [" ".join((t or "").split()) for t in texts]) for _ in range(5)), key=lambda x: x[1])
    out, own = min((took(lambda: list(phrase_dedup._cut(20)([given]))) for _ in range(5)), key=lambda x: x[1])
    got = [r for b in out for r in b.to_pylist()]
    assert [r["kept_text"] for r in got[:1000]] == [" ".join(t.split()[:3] + t.split()[29:]) for t in plain[:1000]]
    assert [(r["n_words"], r["n_removed"], r["kept_text"]) for r in got[999:]] == [(400, 26, got[999]["kept_text"]), (0, 0, ""), (0, 0, ""), (0, 0, ""), (1, 0, "one")]
    assert own < 5 * usual + 0.02, (own, usual)


def test_words_are_hashed_as_before():
    from pandas.util import hash_array

    values = ["a", "", "é", "𝒳", "w" * 1000]
    assert (common.hash_strings(pa.array(values)) == hash_array(np.array(values, dtype=object), categorize=False)).all()
    assert len(common.hash_strings(pa.array([], pa.string()))) == 0
