"""Searches of a set of queries over all texts, against brute force."""

import collections
import math
import random
import re

import pytest

from tallystone.operators import retrieval, search_index
from tallystone.plans import search_queries
from tallystone.sources.scratch import written

SCHEMA = "document_id string, title string, body string, kind string"


def texts(seed, n=400):
    """Few letters, so that terms overlap themselves and scores tie; some texts are empty or null, some rows repeat an id."""
    draw = random.Random(seed)
    rows = [(f"d{k}", draw.choice(["", "Tïtle", "ana"]), "".join(draw.choices("aanñ é.İ", k=draw.choice([0, 1, 2, 5, 30, 200]))), "SOURCE_TEXT") for k in range(n)]
    return [*rows, ("e0", "", "", "SOURCE_TEXT"), ("e1", None, None, "SOURCE_TEXT"), ("d3", "", "a" * 500, "SOURCE_TEXT"), (None, "", "an " * 90, "SOURCE_TEXT")]


QUERIES = [("q0", "a"), ("q1", "aa"), ("q2", "ana ñ"), ("q3", "AAA é an"), ("q4", "nothing"), ("q5", ""), ("q6", None), ("q7", "anana"), ("q8", "ñé é"), ("q9", "title a a"), ("q1", "n")]


def hay(row):
    return "\n".join(x for x in row[1:3] if x is not None).lower()


def ranked(scores, k):
    """scores: (query, score, document). Ties by id, null first as Spark sorts it."""
    per = collections.defaultdict(list)
    for q, score, d in scores:
        per[q].append((-score, d is not None, d or ""))
    return sorted((q, rank, named and id_ or None, -score) for q, rows in per.items() for rank, (score, named, id_) in enumerate(sorted(rows)[:k], 1))


def found(df):
    return sorted(((r["query_id"], r["rank"], r["document_id"], r["score"]) for r in df.collect()), key=lambda r: (*r[:2], r[2] or ""))


@pytest.mark.parametrize(("seed", "k", "sizes"), [(1, 20, None), (2, 3, None), (3, 7, (64, 3)), (4, 1, (1, 2048))])
def test_occurrences_are_those_of_every_text(spark, monkeypatch, seed, k, sizes):
    if sizes:
        monkeypatch.setattr(retrieval, "COUNTED_BYTES", sizes[0])
        monkeypatch.setattr(retrieval, "COUNTED_ROWS", sizes[1])
    rows = texts(seed)
    want = [(q, float(s), r[0]) for q, query in QUERIES for r in rows if (s := sum(hay(r).count(t) for t in dict.fromkeys((query or "").lower().split())))]
    got = retrieval.term_count_search(spark.createDataFrame(QUERIES, "query_id string, query string"), spark.createDataFrame(rows, SCHEMA).repartition(3), k)
    assert found(got) == ranked(want, k)


def test_only_the_best_of_each_task_are_shuffled(spark):
    docs = spark.createDataFrame(texts(5), SCHEMA).repartition(3).localCheckpoint()
    got = retrieval.term_count_search(spark.createDataFrame(QUERIES, "query_id string, query string"), docs)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_more_queries_than_are_sent_to_every_task(spark, monkeypatch):
    rows = [r for r in texts(6) if r[0] is not None and r[0] != "d3"]
    docs, queries = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([q for q in QUERIES if q != ("q1", "n")], "query_id string, query string")
    few = found(retrieval.term_count_search(queries, docs, 5))
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 2)
    assert found(retrieval.term_count_search(queries, docs, 5)) == few and few


def words(row):
    return re.findall(r"[^\W_]+", hay(row))


@pytest.mark.parametrize(("seed", "k"), [(7, 20), (8, 3), (9, 1)])
def test_documents_with_all_terms_rank_as_among_all(spark, seed, k):
    """Few words, so that scores tie; terms in all documents, in none, and a query of more terms than any document has."""
    draw = random.Random(seed)
    rows = [(f"d{k}", draw.choice(["", "Der Titel"]), " ".join(draw.choices("a b c d e é Ñ zz".split(), [40, 20, 9, 5, 3, 2, 2, 1], k=draw.choice([0, 1, 2, 5, 30]))) or None, "SOURCE_TEXT") for k in range(400)]
    queries = [("q0", "a"), ("q1", "B, a!"), ("q2", "é ñ"), ("q3", "zz titel der"), ("q4", "nothing a"), ("q5", ""), ("q6", None), ("q7", "a b c d e é ñ zz titel"), ("q8", "a_a")]
    docs, asked = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(queries, "query_id string, query string")
    every = [words(r) for r in rows]
    mean = sum(map(len, every)) / len(rows)
    want = []
    for q, query in queries:
        terms = list(dict.fromkeys(re.findall(r"[^\W_]+", (query or "").lower())))
        for r, ws in zip(rows, every, strict=True):
            if terms and all(t in ws for t in terms):
                idf = {t: max(math.log((len(rows) - n + 0.5) / (n + 0.5)), 1e-6) for t in terms for n in [sum(t in x for x in every)]}
                want.append((q, sum(idf[t] * ws.count(t) * 2.2 / (ws.count(t) + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t in terms), r[0]))
    near = lambda rows: [(*r[:3], float(f"{r[3]:.9g}")) for r in rows]
    got = found(retrieval.bm25_once(asked, docs, k))
    assert near(got) == near(ranked(want, k)) and want
    told = retrieval.bm25_search(asked, retrieval.postings(docs), docs, k)
    assert [(*r[:2], round(r[3], 9)) for r in found(told)] == [(*r[:2], round(r[3], 9)) for r in got]


def test_documents_of_one_id_and_none(spark):
    """Each row is a document of its own; nothing is found among none."""
    asked = spark.createDataFrame([("q", "a")], "query_id string, query string")
    docs = spark.createDataFrame([("d", "", "a b", "x"), ("d", "", "a", "x"), ("e", "", "b", "x")], SCHEMA)
    assert [r[:3] for r in found(retrieval.bm25_once(asked, docs))] == [("q", 1, "d"), ("q", 2, "d")]
    assert retrieval.bm25_once(asked, docs.where("false")).count() == 0
    assert retrieval.bm25_once(asked.where("false"), docs).count() == 0


def test_one_search_keeps_no_postings(spark, small, monkeypatch):
    """What is kept for one set of queries has a row for each document; an index is made for more queries than are sent to every task, and finds the same."""
    kept = {}
    for module in (retrieval, search_index):
        monkeypatch.setattr(module, "written", lambda df, name: kept.update({name: written(df, name)}) or kept[name])
    few = found(search_queries.bm25(spark, small, 20))
    assert list(kept) == ["term-counts"] and kept["term-counts"].count() == search_queries.documents(spark, small).count()
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 2)
    many = found(search_queries.bm25(spark, small, 20))
    assert "index-postings" in kept and [(*r[:3], round(r[3], 9)) for r in many] == [(*r[:3], round(r[3], 9)) for r in few] and few
