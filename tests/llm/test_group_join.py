"""The token-group matrix join against all pairs."""

import collections
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from tallystone.llm import group_join

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=3):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def expected(rows, percent=90):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(range(len(rows)), 2):
        a, b = sets[x], sets[y]
        if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
            c = len(a & b)
            if 100 * c >= percent * (len(a) + len(b) - c):
                root[find(y)] = find(x)
    least = collections.defaultdict(list)
    for k, r in enumerate(rows):
        least[find(k)].append(r[0])
    return sorted(((r[0], len(sets[k]), min((i for i in least[find(k)] if i is not None), default=None)) for k, r in enumerate(rows)), key=str)


def rows_of(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: [str(x) for x in rng.choice(words, n)]
    texts = []
    # families at every similarity near the threshold, of every size, and chains of small changes
    for n in (1, 2, 3, 8, 11, 12, 13, 14, 20, 25, 31, 40, 64, 100, 150, 400):
        base = say(n)
        for _ in range(12):
            own = list(base)
            for _ in range(int(rng.integers(0, max(2, n // 30 + 2)))):
                at = int(rng.integers(0, len(own)))
                own[at : at + int(rng.integers(0, 2))] = say(int(rng.integers(0, 3)))
            texts.append(" ".join(own))
    base = say(120)
    for k in range(15):
        base[5 * k] = f"new{k}"
        texts.append(" ".join(base))
    texts += ["a b", "A  b", "a b c", "", None, " \n\t", "x", "X", "é É", "É é", "aa " * 50, "aa " * 500, " ".join(say(4000))]
    texts += [texts[3], texts[3].upper()]
    return [(None if k % 13 == 5 else (k * 7) % 150, t, k, "clash") for k, t in enumerate(texts)]


@pytest.mark.parametrize(("group", "seed"), [(256, 1), (3, 2)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, group, seed):
    monkeypatch.setattr(group_join, "GROUP", group)
    rows = rows_of(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid int, Band string").repartition(3)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in group_join.linked(docs).collect()), key=str)
    want = expected(rows)
    assert got == want
    assert len({r[2] for r in want}) < len({r[0] for r in want})


def test_empty_and_unrelated(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four")], "doc_id long, text string")
    assert sorted(tuple(r) for r in group_join.linked(docs).collect()) == [(1, 0, 1), (2, 0, 2), (3, 2, 3)]
    assert group_join.linked(docs.where("doc_id < 0")).count() == 0


def test_similar_sets_share_enough_tokens():
    """Every pair at the threshold, of any sizes: as many equal parts as the bound asks for."""
    rng = np.random.default_rng(3)
    starts, parts = group_join.bands(90, 1 << 20)
    for _ in range(300):
        n = int(rng.integers(5, 600))
        more = int(rng.integers(0, n // 9 + 1))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a, rng.integers(0, 1 << 63, more).astype(np.uint64)])
        swap = int(rng.integers(0, max(1, (n - 9 * more) // 19 + 1)))
        b[:swap] = rng.integers(0, 1 << 63, swap).astype(np.uint64)
        common = len(np.intersect1d(a, b))
        if 100 * common < 90 * (len(a) + len(b) - common):
            continue
        small, large = sorted((np.unique(a), np.unique(b)), key=len)
        band = int(np.searchsorted(starts, len(large), side="right") - 1)
        other = int(np.searchsorted(starts, len(small), side="right") - 1)
        assert other in (band - 1, band)
        k = int(parts[band])
        if not k:
            assert len(small) == len(large) == common
            continue
        keys, gaps = [], []
        for s in (small, large):
            own, _, gap = group_join.part_tokens(s, np.array([len(s)]), np.array([k]), np.array([band]))
            keys.append(own)
            gaps.append(int(gap[0]))
        differ = (len(small) + len(large)) * 10 // 190
        assert len(np.intersect1d(*keys)) >= max(1, k - differ - min(1, gaps[1]))


def test_shingle_sets_of_slices():
    texts = pa.array(["x", "a b c d", None, "", "A b  c\nD", "q r"])
    grams, ends = group_join.shingle_sets(texts.slice(1), 3)
    assert ends.tolist() == [2, 2, 2, 4, 5] and grams[0:2].tolist() == grams[2:4].tolist()
