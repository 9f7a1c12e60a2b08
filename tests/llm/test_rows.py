"""Operators on rows that repeat ids or have none, with different texts, against brute force over rows."""

import collections
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallystone.llm import decontam, mixing, near_dup, phrase_dedup, queries, token_orc

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, id int, row string"


def words(text):
    return WORD.findall(text or "")


def bag(text):
    w = words(text)
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def similar(a, b):
    return sum((a & b).values()) >= 0.8 * sum((a | b).values()) - 1e-9


def roots(texts):
    """The class of each text: the least index of those linked to it."""
    bags, root = [bag(t) for t in texts], list(range(len(texts)))
    for x, y in itertools.combinations(range(len(texts)), 2):
        small, large = sorted((sum(bags[x].values()), sum(bags[y].values())))
        if small and small >= 0.8 * large - 1e-9 and root[x] != root[y] and similar(bags[x], bags[y]):
            new, old = min(root[x], root[y]), max(root[x], root[y])
            root = [new if r == old else r for r in root]
    return root


def hashes(spark, rows):
    """xxhash64 of each row's text, as Spark has it."""
    df = spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows)], "k int, text string")
    return [r[1] for r in sorted(df.select("k", F.xxhash64("text")).collect())]


def kept_rows(rows, hashed):
    """Of each class of texts the row of the smallest id (null last), then hash; of equal rows one."""
    root, best, out = roots([r[1] for r in rows]), {}, []
    rank = lambda k: (rows[k][0] is None, rows[k][0] or 0, hashed[k])
    for k, r in enumerate(rows):
        if not words(r[1]):
            out.append(r)
        elif root[k] not in best or rank(k) < rank(best[root[k]]):
            best[root[k]] = k
    return out + [rows[k] for k in best.values()]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    say = lambda n: " ".join(rng.choice([f"w{i}" for i in range(300)], n))
    base, other, passage = say(150), say(120), say(45)
    near = base.split()
    near[60] = "changed"
    texts = [base, other, base, " ".join(near), say(60), f"{passage} {say(30)}", f"{say(10)} {passage}", passage, None, "", " \n", say(3), other, other, f"{say(4)} {passage} {say(2)} {passage}"]
    ids = [5, 5, 6, 7, 5, 2, 2, None, None, 9, 9, None, None, None, 2]
    more = [(int(rng.integers(0, 12)) if k % 3 else None, say(int(rng.integers(1, 50)))) for k in range(40)]
    return [(i, t, ["en", None][k % 2], ["a", "b", None][k % 3], 7, "row") for k, (i, t) in enumerate(list(zip(ids, texts, strict=True)) + more)]


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates_are_classes_of_texts(spark, rows, seed):
    mixed = list(rows)
    random.Random(seed).shuffle(mixed)
    docs = spark.createDataFrame(mixed, SCHEMA).repartition(3)
    root, least = roots([r[1] for r in mixed]), collections.defaultdict(list)
    for k, r in enumerate(mixed):
        least[root[k]].append(r[0])
    want = [(r[0], min((i for i in least[root[k]] if i is not None), default=None), sum(bag(r[1]).values())) for k, r in enumerate(mixed)]
    assert sorted(map(repr, (tuple(r) for r in near_dup.classes(docs).collect()))) == sorted(map(repr, want))
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(tuple(r)[:2]) for r in kept.collect()) == sorted(repr(r[:2]) for r in kept_rows(mixed, hashes(spark, mixed)))


def test_an_id_of_two_texts_links_neither_and_loses_neither(spark):
    rng = np.random.default_rng(1)
    a, b = (" ".join(rng.choice([f"w{i}" for i in range(500)], 100)) for _ in range(2))
    near = " ".join([*b.split()[:99], "end"])
    for order in list(itertools.permutations([(5, a), (5, b), (6, b), (7, near)]))[::9]:
        docs = spark.createDataFrame(list(order), "doc_id long, text string")
        assert sorted((r["doc_id"], r["class_id"]) for r in near_dup.classes(docs).collect()) == [(5, 5), (5, 5), (6, 5), (7, 5)]
        assert sorted(map(tuple, near_dup.keep_one(docs).collect())) == sorted([(5, a), (5, b)])


def test_passages_go_only_from_rows_that_hold_them(spark, rows):
    hashed = hashes(spark, rows)
    times = collections.Counter(r[0] for r in rows)
    sub = [h if times[r[0]] > 1 or r[0] is None else 0 for r, h in zip(rows, hashed, strict=True)]
    first = {}
    for k, r in enumerate(rows):
        w = words(r[1])
        for s in range(len(w) - 19):
            at = (-(1 << 63) if r[0] is None else r[0], sub[k], s)
            first[tuple(w[s : s + 20])] = min(first.get(tuple(w[s : s + 20]), at), at)
    want = []
    for k, r in enumerate(rows):
        w = words(r[1])
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (-(1 << 63) if r[0] is None else r[0], sub[k], s):
                gone[s : s + 20] = [True] * 20
        want.append((r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    for parts in (1, 3):
        docs = spark.createDataFrame(rows[::-1], SCHEMA).repartition(parts)
        assert sorted(map(repr, (tuple(r) for r in phrase_dedup.dedup_passages(docs).collect()))) == sorted(map(repr, want))
    assert any(r[2] for r in want)


def test_rows_without_id_cost_what_others_cost(spark):
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{' '.join(rng.choice(list('abcdefgh'), 12))} {passage} {k}" for k in range(1600)]
    took = []
    for own in (True, True, False):
        began = time.time()
        got = phrase_dedup.dedup_passages(spark.createDataFrame([(k if own else None, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)).collect()
        took.append(time.time() - began)
        assert sum(r["n_removed"] >= 40 for r in got) == 1599
    assert took[2] < 3 * took[1] + 5, took


def test_decontamination_judges_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    hit, clean = "so one two three four five six seven eight nine ten it goes", "nothing of the kind"
    rows = [(None, hit, 1, 2), (None, clean, 1, 2), (3, clean, 1, 2), (4, hit, 1, 2), (4, clean, 1, 2), (4, None, 1, 2), (5, hit, 1, 2), (5, hit, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __bad int, text_hash int")
    got = decontam.decontaminate(docs, items)
    assert got.columns == docs.columns
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(r) for r in rows if r[1] != hit)
    assert decontam.decontaminate(docs.where("doc_id = 99"), items).count() == 0


def test_pipeline_against_brute_force(spark, small):
    """All stages over the smallest tables: which documents stay, how often, and their tokens."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    given = [tuple(r.values()) for r in pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text", "lang", "source"]).to_pylist()]
    items = pq.read_table(f"{small}/benchmark.parquet", columns=["text"]).column("text").to_pylist()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    told = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    docs = [r for r in given if any(c.isalpha() for c in r[1] or "")]
    docs = kept_rows(docs, hashes(spark, docs))
    windows = set()
    for t in items:
        w = told.findall((t or "").translate(low))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def clean(text):
        w = told.findall((text or "").translate(low))
        return not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    docs = {r[0]: r for r in docs if clean(r[1])}
    assert 20 < len(docs) < len(given)
    got = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, small).collect():
        got[r["doc_id"]].append(r)
    assert set(got) <= set(docs)

    # the mix: each source's words come near its target, no document more than three times
    size = {i: len(words(r[1])) for i, r in docs.items()}
    total, largest, taken = (collections.Counter() for _ in range(3))
    for i, r in docs.items():
        total[r[3]] += size[i]
        largest[r[3]] = max(largest[r[3]], size[i])
        taken[r[3]] += size[i] * len(got.get(i, []))
    names = sorted((s for s in total if s is not None), key=str) + [None] * (None in total)
    weight, left, want, free = {s: 1 + k % 3 for k, s in enumerate(names)}, float(sum(total.values())), {}, set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        want |= {s: 3.0 * total[s] for s in over} if over else share
        left -= sum(3.0 * total[s] for s in over)
        free = free - over if over else set()
    for s, n in want.items():
        assert abs(taken[s] - n) <= largest[s] / 2 + 1e-6 * n, s
    assert max(map(len, got.values())) <= 3

    # the tokens of all copies, in order of their ids
    tokenizer, start = Tokenizer.from_file(queries.tokenizer_file()), 0
    for i in sorted(got):
        ids = np.array([*tokenizer.encode(docs[i][1] or "", add_special_tokens=False).ids, 0], "<u4")
        for r in sorted(got[i], key=lambda r: r["start"]):
            assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)


def test_many_equal_rows_fill_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    rows = [(None, None, "a")] * 400 + [(7, "the same few words", "a")] * 700 + [(k, f"{k} words of text", "b") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    sized = mixing.written(mixing._numbered(docs), "sizes")
    rated = sized.select("*", F.xxhash64("source").alias("sh"), F.pmod("key", F.lit(3)).alias("block"))
    spread = mixing._spread_copies(rated)
    assert spread.count() == len(rows)
    most = {r["source"]: r["n"] for r in spread.groupBy("source", "sh", "block").agg(F.count("*").alias("n")).groupBy("source").agg(F.max("n").alias("n")).collect()}
    assert most["a"] <= 50 and most["b"] <= 90
    tell = lambda: sorted(map(repr, (tuple(r) for r in mixing.mix(docs).collect())))
    first = tell()
    assert len(first) == len(rows) and tell() == first


def test_lookup_reads_only_row_groups_that_can_hold_the_ids(spark, tmp_path):
    docs = spark.range(8_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    path = str(tmp_path / "tokens")
    token_orc.write_tokens(docs, path, queries.tokenizer_file(), parts=2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = token_orc.lookup(spark, path, [5, 7_999])
        rows = found.collect()
        leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
        read = [leaves.apply(k).metrics().get("numOutputRows").get().value() for k in range(leaves.length())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(r["doc_id"] for r in rows) == [5, 7_999]
    whole = {r["doc_id"]: r["start"] for r in token_orc.read_tokens(spark, path).collect()}
    assert all(r["start"] == whole[r["doc_id"]] for r in rows)
    # of the token table one row group of a thousand rows in each part, of the starts one row per part
    assert max(read) <= 2_000 and sorted(read)[0] == 2, read
