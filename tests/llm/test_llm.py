"""The training-data operators against brute force on a small fixture with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallystone.llm import ann, decontam, fixity, hmm, langid, line_dedup, mixing, near_dup, phrase_dedup, token_orc
from tallystone.llm.queries import tokenizer_file

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def texts():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    passage, base = say(60), say(200)
    near = base.split()
    near[50] = "other"
    common = "This line is Common enough"
    out = [base, base, " ".join(near), f"{say(30)} {passage} {say(20)}", f"{passage}\n{common}\nshort\n{say(8)}", f"{common} \nx\n{say(30)}\n\t{common.upper()}", None, "", " \n ", say(3), say(3000), f"{say(5)} {passage} {passage}", "École École école", "12 34 !!", "one two three\r\nfour", "a <|endoftext|> b", common]
    return out + [say(int(rng.integers(1, 80))) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "a", "b", "c"][i % 4], -1, 7) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, rep int").repartition(3)


def rows_of(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.collect())


def empty(docs):
    return docs.where("doc_id < 0")


def test_line_dedup(docs):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(docs, blocks=4).collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = collections.defaultdict(set)
    for i, t in rows_of(docs):
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    for i, t in rows_of(docs):
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        assert got[i] == (len(all_), len(all_) - len(kept), "\n".join(kept))
    assert line_dedup.dedup_lines(empty(docs)).count() == 0


def test_line_dedup_of_rows_that_share_an_id(spark):
    common = "a common line of text"
    rows = [(1, common, 0), (2, f"first keep this line\n{common}", 1), (2, "x line number zero here\nunique line that must stay", 2), (2, f"first keep this line\n{common}", 3), (None, common, 4), (3, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_Lines int")
    got = sorted((tuple(r) for r in line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df)).select("doc_id", "text", "n_lines", "n_dropped", "kept_text").collect()), key=repr)
    want = [(i, t, len((t or "").split("\n")), int(i == 2 and common in t), "first keep this line" if i == 2 and common in t else t or "") for i, t, _ in rows]
    assert got == sorted(want, key=repr)


def test_phrase_dedup(docs):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in phrase_dedup.dedup_passages(docs).collect()}
    seen = set()
    for i, t in rows_of(docs):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        assert got[i] == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)), i
    assert phrase_dedup.dedup_passages(empty(docs)).count() == 0


def test_phrase_dedup_of_a_hot_passage(spark):
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{' '.join(rng.choice(list('abcdefgh'), 12))} {passage}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["n_removed"] for r in phrase_dedup.dedup_passages(df).collect()}
    seen, want = set(), {}
    for i, t in rows:
        w, gone = t.split(), set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone |= set(range(s, s + 20))
            seen.add(k)
        want[i] = len(gone)
    assert got == want


def similar_classes(texts, weight):
    """The smallest id of each class of linked documents, by all pairs."""
    bags = {}
    for i, t in texts:
        w = words(t)
        bags[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()
        if weight == "set":
            bags[i] = collections.Counter(set(bags[i]))
    root = {i: i for i in bags}
    for i, a in bags.items():
        for j, b in bags.items():
            if i < j and a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if v == old else v for k, v in root.items()}
    return root


@pytest.mark.parametrize("weight", ["set", "count"])
def test_near_duplicates(docs, weight):
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs, weight=weight, turns=1).collect()}
    assert got == similar_classes(rows_of(docs), weight)
    kept = near_dup.keep_one(docs, weight=weight)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(got.values())
    assert near_dup.classes(empty(docs)).count() == 0


@pytest.mark.parametrize("weight", ["set", "count"])
def test_near_duplicates_in_hot_buckets_and_many_blocks(spark, monkeypatch, weight):
    from tallystone.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    rows = []
    for i in range(60):
        own = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 5))):
            own[at] = f"x{rng.integers(0, 9)}"
        rows.append((i, " ".join(own + own[:30] * (i % 3))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(df, weight=weight, turns=1).collect()}
    assert got == similar_classes(rows, weight)
    assert got == {r["doc_id"]: r["class_id"] for r in near_dup.classes(df, weight=weight).collect()}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a, extra = rng.integers(1, 1 << 62, 300).astype(np.uint64), rng.integers(1, 1 << 62, 100).astype(np.uint64)
    b = np.concatenate([a[:200], extra])
    wa, wb = np.ones(300) * 2.5, np.ones(300)
    want = np.minimum(2.5, 1) * 200 / (200 * 2.5 + 100 * 2.5 + 100)
    k = 2000
    assert abs((near_dup.signature(a, wa, k) == near_dup.signature(b, wb, k)).mean() - want) < 0.04


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(2)).collect()))
    size = {i: len(words(t)) for i, t in rows_of(docs)}
    taken, target = collections.Counter(), {}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["copies"] <= 3
        taken[source[r["doc_id"]]] += r["copies"] * r["size"]
        target[source[r["doc_id"]]] = r["target"]
    assert abs(sum(target.values()) - sum(size.values())) < 1e-3
    # whole copies come no nearer than about half the largest document of a source
    largest = collections.Counter()
    for i, n in size.items():
        largest[source[i]] = max(largest[source[i]], n)
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6 * t
    assert mixing.mix(empty(docs)).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_mixing_takes_rows_that_share_an_id_by_themselves(spark):
    rng = np.random.default_rng(4)
    rows = [([None, 7, i][i % 3], " ".join(rng.choice(["a", "b", "c"], int(rng.integers(1, 30)))), ["x", "y"][i % 2], 1, i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, Rid int").repartition(3)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    times = collections.Counter(r["Rid"] for r in out.collect())
    want = collections.Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    got = collections.Counter()
    for i, t, _, _, n in rows:
        got[i, len(t.split())] += times[n]
    assert got == want and max(times.values()) <= 3
    total = {s: sum(len(t.split()) for _, t, x, _, _ in rows if x == s) for s in "xy"}
    taken = {s: sum(len(t.split()) * times[n] for _, t, x, _, n in rows if x == s) for s in "xy"}
    for s, share in (("x", 1 / 3), ("y", 2 / 3)):
        assert abs(taken[s] - share * sum(total.values())) <= 15


def test_mixing_rounds_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 10)
    out = mixing.mix(docs).collect()
    target, taken = {}, collections.Counter()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in out:
        target[source[r["doc_id"]]] = r["target"]
        taken[source[r["doc_id"]]] += r["copies"] * r["size"]
    assert len(out) == docs.count() and all(0 <= r["copies"] <= 3 for r in out)
    assert abs(sum(taken.values()) - sum(target.values())) <= 0.2 * sum(target.values())


def test_targets_stop_at_the_cap():
    got = mixing.targets([("a", 10), ("b", 1000), (None, 1000)], [1, 2, 3], 3)
    assert got["a"] == 30 and abs(got["b"] - 1980 * 2 / 5) < 1e-9 and abs(got[None] - 1980 * 3 / 5) < 1e-9


def test_language_id(spark, docs):
    rows = [(i, " ".join(["the house and garden", "la maison et le jardin"][i % 2] for _ in range(3)), ["en", "fr"][i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.prototypes(df)
    out = langid.predict(df, learned, ["doc_id", "lang"]).collect()
    assert all(r["lang"] == r["lang_pred"] and 0 < r["score"] <= 1 for r in out)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, learned, ["doc_id"]).collect()}
    assert all((odd[i] == "und") == (not any(c.isalpha() for c in t or "")) for i, t in rows_of(docs))
    assert {r["lang_pred"] for r in langid.predict(docs, {}, ["doc_id"]).collect()} == {"und"}
    assert langid.prototypes(empty(docs)) == {}


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(700)] + [(i, [1.0] * 8) for i in range(700, 900)]
    rows += [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] * 8), (1300, [1.0, None] * 4), (1400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = {i: np.array(v) for i, v in rows[:900]}
    exact = collections.defaultdict(list)
    for factor in (1.0, 1.5):
        hits = 0
        for r in ann.search(df, F.col("vec_id") % 100 == 0, factor=factor, shard_rows=300).collect():
            exact[factor, r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        for q in range(0, 900, 100):
            far = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(good[q], v, strict=True))), i) for i, v in good.items() if i != q)[:10]
            got = [x[1] for x in sorted(exact[factor, q])]
            hits += len(set(got) & {i for _, i in far})
            if factor == 1:
                assert got == [i for _, i in far]
        assert hits >= 0.9 * 90
    assert ann.search(df.where("vec_id < 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_nearest_neighbours_leave_out_cells_and_stay_exact(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6)) * 50
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=6)]) for i in range(1500)]
    rows += [(100, [0.5] * 6), (None, [1.0] * 6), (7, rows[7][1]), (9, [1.0] * 3), (200, [2.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    by_query, asked = collections.defaultdict(list), []
    real = ann.meet
    monkeypatch.setattr(ann, "meet", lambda trees, blocks, *rest: asked.append((trees, blocks)) or real(trees, blocks, *rest))
    for r in ann.search(df, F.col("vec_id") % 100 == 0, k=5, block=4, shard_rows=60).collect():
        by_query[r["query_id"], r["rank"]].append((r["vec_id"], r["score"]))
    good = [(i, np.array(v)) for i, v in rows if i is not None]
    for q in range(0, 1500, 100):
        for dim in (3, 6):
            own = min((list(v) for i, v in good if i == q and len(v) == dim), default=None)
            if own is None:
                continue
            far = sorted((float(ann.distances(v[None, :], np.array(own))[0]), i) for i, v in good if i != q and len(v) == dim)[:5]
            for rank, (score, i) in enumerate(far, 1):
                assert (i, score) in by_query[q, rank]
    trees, blocks = asked[-1]
    assert trees.count() > 12 and blocks.count() < 0.6 * trees.count() * 15


def test_decontamination(spark, docs):
    items = [(1, " ".join(words(texts()[3])[30:45])), (2, "ÉCOLE école"), (3, "école"), (4, None), (5, "!!"), (None, "one two"), (6, "34"), (7, " ".join(words(texts()[10])[100:112]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontam.contamination(docs, bench).collect()}
    for i, t in rows_of(docs):
        w, hit, ids = found((t or "").translate(LOW)), set(), set()
        for k, x in items:
            v = found((x or "").translate(LOW))
            m = min(10, len(v))
            for s in range(len(v) - m + 1 if v and k is not None else 0):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == v[s : s + m]:
                        hit |= set(range(p, p + m))
                        ids.add(str(k))
        assert got[i] == (len(w), len(hit), sorted(ids)), i
    assert decontam.contamination(empty(docs), bench).count() == 0
    assert decontam.contamination(docs, bench.where("item_id < 0")).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(docs, bench).columns == docs.columns


def test_language_model(docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = {r["doc_id"]: r for r in hmm.score_texts(docs, held, iterations=2).collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = {i: [*words((t or "").translate(LOW)), None] for i, t in rows_of(docs)}
    c = collections.Counter(x for i, w in tokens.items() if not out(i) for x in w)
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(i), len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
    assert hmm.score_texts(empty(docs), held).count() == 0


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(0)
    m = hmm.Model(np.array([0.3, 0.7]), np.array([[0.8, 0.2], [0.4, 0.6]]), rng.random((hmm.CLASSES, 2)))
    x = [5, 9, 2]
    total = sum(m.start[a] * m.emit[5, a] * m.move[a, b] * m.emit[9, b] * m.move[b, c] * m.emit[2, c] for a in (0, 1) for b in (0, 1) for c in (0, 1))
    raw = [np.array(x, np.uint16).tobytes(), np.array([5], np.uint16).tobytes()]
    assert np.allclose(hmm.forward(m, raw), [math.log10(total), math.log10((m.start * m.emit[5]).sum())])


@pytest.mark.parametrize("segment", [1, 2, 3, 64])
def test_expected_counts_are_those_over_all_paths(monkeypatch, segment):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    rng = np.random.default_rng(1)
    m = hmm.Model(np.array([0.3, 0.7]), np.array([[0.8, 0.2], [0.4, 0.6]]), rng.random((hmm.CLASSES, 2)))
    texts = [[5, 9, 2, 7, 7, 1, 3], [5], [4, 4], [8, 1, 2, 3], [6] * 6]
    want = np.zeros(m.cells)
    for x in texts:
        paths = list(itertools.product((0, 1), repeat=len(x)))
        p = np.array([m.start[q[0]] * np.prod([m.emit[c, k] for c, k in zip(x, q, strict=True)]) * np.prod([m.move[a, b] for a, b in itertools.pairwise(q)]) for q in paths])
        for q, share in zip(paths, p / p.sum(), strict=True):
            want[q[0]] += share
            for a, b in itertools.pairwise(q):
                want[2 + 2 * a + b] += share
            for c, k in zip(x, q, strict=True):
                want[6 + 2 * c + k] += share
    assert np.allclose(hmm.expected_counts(m, [np.array(x, np.uint16).tobytes() for x in texts]), want)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(2)
    raw = [np.where(np.arange(n) // 5 % 2, rng.integers(0, 20, n), rng.integers(20, 40, n)).astype(np.uint16).tobytes() for n in (300, 40, 1, 90)]
    mass = np.full(hmm.CLASSES, 1e-3)
    mass[:40] = 10
    model, seen = hmm.first_model(mass, 3), []
    for _ in range(6):
        seen.append(hmm.forward(model, raw).sum())
        model = hmm._maximized(hmm.expected_counts(model, raw), mass, 3)
    assert all(b > a - 0.5 for a, b in itertools.pairwise(seen)) and seen[-1] > seen[0] + 1


def test_head_of_the_vocabulary_is_bounded(spark, monkeypatch):
    for counts, head in (([1] * 50, 10), ([5, 5, 4, 3, 3, 3, 1], 4), (list(range(1, 3000)), 100), ([7], 4), ([], 4), ([10**12, 3, 2, 2], 2), ([2] * 4, 4)):
        monkeypatch.setattr(hmm, "HEAD", head)
        df = spark.createDataFrame([(str(i), c) for i, c in enumerate(counts)], "word string, c long")
        cut = hmm._least_count(df)
        assert sum(c >= cut for c in counts) <= head and (cut <= 1 or sum(c >= cut - 1 for c in counts) > head), (counts[:5], cut)


def test_scores_of_texts_are_those_of_the_trained_model(docs):
    """The query's score from the words up: classes, training and the forward recursion once more, text by text."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = {r["doc_id"]: r["score"] for r in hmm.score_texts(docs, held, states=2, iterations=2).collect()}
    tokens = {i: words((t or "").translate(LOW)) for i, t in rows_of(docs)}
    learn = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(x for i in learn for x in tokens[i])
    own = {x: k for k, (_, x) in enumerate(sorted((-n, x) for x, n in c.items())[: hmm.OWN], 1)}
    ending = lambda x: int(hmm._ending(pa.array([x]))[0])
    of = {x: own.get(x) or ending(x) for w in tokens.values() for x in w}
    n, v = collections.Counter({0: len(learn)}), collections.Counter({0: 1})
    for x, k in c.items():
        n[of[x]] += k
        v[of[x]] += 1
    mass = np.array([n[k] + (0.1 * (v[k] + 1) if k > hmm.OWN else 0.1 * (n[k] == 0)) for k in range(hmm.CLASSES)])
    raw = {i: np.array([*(of[x] for x in w), 0], np.uint16).tobytes() for i, w in tokens.items()}
    model = hmm.first_model(mass, 2)
    for _ in range(2):
        sums = sum(hmm.expected_counts(model, [raw[i]]) for i in learn)
        model = hmm._maximized(sums, mass, 2)
    for i, w in tokens.items():
        path = float(hmm.forward(model, [raw[i]])[0])
        inner = sum(math.log10((c[x] + 0.1) / mass[of[x]]) for x in w if of[x] > hmm.OWN)  # a class of one word has that word for certain
        assert abs(got[i] - path - inner) < 1e-4 * (1 + len(w)), i


def test_token_orc(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tok, path = Tokenizer.from_file(tokenizer_file()), str(tmp_path / "t")
    token_orc.write_tokens(docs, path, tokenizer_file(), parts=3)
    got = {r["doc_id"]: (r["start"], list(r["tokens"])) for r in token_orc.read_tokens(spark, path).collect()}
    start = 0
    for i, t in rows_of(docs):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[i] == (start, ids)
        start += len(ids)
    assert [r["doc_id"] for r in token_orc.lookup(spark, path, [5]).collect()] == [5]
    assert token_orc.encode_and_read(empty(docs), tokenizer_file()).count() == 0


def test_fixity(spark):
    rows = [(i, f"http://h/{i}", "x" * i) for i in range(60)] + [(None, None, None), (3, "http://h/3", "again")]
    good = fixity.records(spark.createDataFrame(rows, "page_id long, url string, html string"), file_pages=20)
    assert fixity.audit(fixity.leaves(good), fixity.leaves(good), fanout=4, levels=3).count() == 0
    bad = good.withColumn("record", F.when(F.col("page_id") == 41, F.lit("y").cast("binary")).otherwise(F.col("record"))).where("not (file = 0 and ordinal = 20)")
    got = {(r["file"], r["ordinal"], r["status"]) for r in fixity.audit(fixity.leaves(good), fixity.leaves(bad), fanout=4, levels=3).collect()}
    assert got == {(2, 1, "CHANGED"), (0, 20, "MISSING")}
    assert {r["status"] for r in fixity.audit(fixity.leaves(bad), fixity.leaves(good), fanout=4, levels=3).collect()} == {"CHANGED", "ADDED"}
    pages = spark.createDataFrame(rows + [(None, f"n{i}", None) for i in range(50)], "page_id long, url string, html string").withColumn("Record", F.lit(1))
    hashed = lambda df: sorted(tuple(r) for r in df.select("file", "ordinal", "offset", "length", "digest").collect())
    early, late = fixity.leaves(fixity.rendered(pages, 20)), fixity.leaves(fixity.records(pages, 20))
    assert hashed(early) == hashed(late) and early.select("file").where("file < 0").distinct().count() == 3
    none = fixity.leaves(fixity.rendered(pages.where("url = '?'")))
    assert fixity.audit(none, none).count() == 0 and {r["status"] for r in fixity.audit(early, none).collect()} == {"MISSING"}


def test_pipeline(spark, small):
    import corpus_pipeline

    assert [f.__name__ for _, f in corpus_pipeline.STAGES][0] == "identify_languages"
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_language_stage_keeps_letters_when_nothing_is_labelled(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a house", None), (2, "123 -", None), (3, None, None), (4, "дом", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.identify_languages(spark, docs, "").collect()} == {1, 4}
