"""The kept index against the search over all postings."""

import random

import pytest

from tallystone.operators import retrieval, search_index


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    rows = [(f"d{k:04}", draw.choice(["Common title", ""]), " ".join(draw.choices(words, weights, k=draw.randint(0, 60))) or None, "SOURCE_TEXT") for k in range(600)]
    return spark.createDataFrame(rows, "document_id string, title string, body string, kind string").repartition(4)


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_kept_index_ranks_as_all_postings_do(spark, docs, tmp_path, block):
    path, opened = str(tmp_path / "index"), []
    search_index.build_index(docs, path, block)
    queries = spark.createDataFrame([("a", "w0 w1"), ("b", "w0"), ("c", "W5 w9 w0"), ("d", "w59 w58"), ("e", "unknown w0"), ("f", ""), ("g", "common title w2"), ("h", "w2, w2")], "query_id string, query string")
    for limit in (3, 200):
        got = search_index.search(spark, path, queries, limit, opened)
        want = retrieval.bm25_search(queries, retrieval.postings(docs), docs, limit)
        rows = lambda df: sorted((r["query_id"], r["rank"], r["document_id"], round(r["score"], 9)) for r in df.collect())
        assert rows(got) == rows(want) and rows(want)
    if block == 7:
        first, rest, every = opened[:3]
        assert first + rest < every / 2, "blocks that cannot reach the least score are left out"


def test_an_index_of_nothing(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    search_index.build_index(docs.where("document_id = 'x'"), path)
    assert search_index.search(spark, path, spark.createDataFrame([("a", "w0")], "query_id string, query string")).count() == 0
