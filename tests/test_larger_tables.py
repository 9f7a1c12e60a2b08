"""Queries over tables with larger keys than the given ones."""

import os

import duckdb
from pyspark.sql import functions as F

from tallystone.operators import claims, request_classes, retrieval
from tallystone.plans import derive, registry, search_queries
from tallystone.sources import scratch
from tallystone.sources.scratch import written


def copies(spark, small, path, changed):
    """The tables of a folder as links, with others in place of some."""
    path = str(path)
    for name in os.listdir(small):
        if name.removesuffix(".parquet") not in changed:
            os.symlink(f"{small}/{name}", f"{path}/{name}")
    for name, df in changed.items():
        df.write.parquet(f"{path}/{name}.parquet")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for name in os.listdir(path):
        at = f"{path}/{name}"
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    return path, c


def same(spark, path, duck, name):
    df = registry.QUERIES[name](spark, path)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    want = sorted((tuple(r) for r in duck.execute(f"select {', '.join(columns)} from ({registry.ORACLE_SQL[name]})").fetchall()), key=repr)
    assert got == want and got


def test_symbols_of_seven_digits(spark, small, tmp_path):
    part = spark.read.parquet(f"{small}/part.parquet")
    path, duck = copies(spark, small, tmp_path, {"part": part.unionByName(part.withColumn("p_partkey", part.p_partkey + 999_900))})
    same(spark, path, duck, "k02_resolve_edges")


def test_claims_are_not_dealt_by_predicate(spark, small):
    """The registry's rows go to the claims: there are as many predicates as rows of it, so a task of such an exchange would get all claims."""
    c, r = derive.claims(spark, small), derive.registry(spark)
    for df in (claims.with_family_key(c, r), claims.conformance(c, r), claims.active_set_digest(c, r), claims.conflict_pairs(c, r)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(predicate" not in plan and "BroadcastHashJoin" in plan


def test_labels_of_many_vectors_are_not_joined_whole(spark, small, tmp_path):
    """A second ranking has as many rows for each query however many vectors share its label."""
    e = spark.read.parquet(f"{small}/embeddings.parquet").withColumn("label", F.lit(1))
    path, _ = copies(spark, small, tmp_path, {"embeddings": e})
    told = search_queries.same_label(spark, path)
    assert told.count() == 50 * e.where("vec_id % 100 = 0").count()


def test_postings_need_no_exchange(spark):
    """Words of a text are counted where it is read."""
    df = spark.createDataFrame([("a", "x", "b a B c a"), ("b", None, None), ("c", "", "é"), ("d", "t", "")], "document_id string, title string, body string")
    told = retrieval.postings(df)
    assert "Exchange" not in told._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["document_id"], r["term"], r["tf"], r["length"]) for r in told.collect()) == [("a", "a", 2, 6), ("a", "b", 2, 6), ("a", "c", 1, 6), ("a", "x", 1, 6), ("c", "é", 1, 1), ("d", "t", 1, 1)]


def test_classes_do_not_grow_with_rows_and_pack_alike(spark, small, tmp_path):
    """Twenty times the customers and parts are no more classes, so no more scores of requests; positions and packing are those of the SQL."""
    times = spark.range(20).withColumnRenamed("id", "t")
    more = {t: spark.read.parquet(f"{small}/{t}.parquet").crossJoin(times).withColumn(k, F.expr(f"{k} + t * {n}")).drop("t") for t, k, n in (("customer", "c_custkey", 150), ("part", "p_partkey", 200))}
    path, duck = copies(spark, small, tmp_path, more)
    few, many = search_queries.by_class(spark, small), search_queries.by_class(spark, path)
    assert many.rows.count() > 10 * few.rows.count() and many.scores.count() < 2 * few.scores.count()
    for name in ("x05_order_candidates", "x06_pack_skip", "x07_pack_prefix", "x10_truncation_report"):
        same(spark, path, duck, name)


def test_packing_looks_up_rows_and_not_what_they_are_listed_as(spark, small, monkeypatch, tmp_path):
    """A row has as many flags as there are requests: none of them is joined by request, kind and id. Without broadcasts, and with blocks of few requests, the results are the same."""
    for name in ("x06_pack_skip", "x07_pack_prefix"):
        plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join " in line]
        assert joins and not any("request_id#" in line and "kind#" in line for line in joins)
    for of, most in (("FEW_TEXTS", 0), ("BROADCAST", 0), ("QUERY_BLOCK", 3)):
        monkeypatch.setattr(request_classes, of, most)
    path, duck = copies(spark, small, tmp_path, {})
    for name in ("x06_pack_skip", "x07_pack_prefix"):
        same(spark, path, duck, name)


def test_equal_texts_meet_terms_once(spark, small, monkeypatch, tmp_path):
    """Ten times the customers and parts have the same names."""
    times = spark.range(10).withColumnRenamed("id", "t")
    more = {t: spark.read.parquet(f"{small}/{t}.parquet").crossJoin(times).withColumn(k, F.expr(f"{k} + t * {n}")).drop("t") for t, k, n in (("customer", "c_custkey", 150), ("part", "p_partkey", 200))}
    path, _ = copies(spark, small, tmp_path, more)
    sizes = []
    monkeypatch.setattr(request_classes, "written", lambda df, name: (sizes.append(df.count()) if name == "class-searched" else None) or written(df, name))
    for at in (small, path):
        search_queries.by_class(spark, at)
    # the copies' statuses differ
    assert sizes[0] <= sizes[1] <= 5 * sizes[0]


def test_families_are_made_once(spark, small, monkeypatch):
    """Who is in conflict reads the digests of families and doesn't make them again for each of its steps."""
    plans = {}
    monkeypatch.setattr(claims, "written", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or written(df, name))
    assert claims.conflict_members(derive.claims(spark, small), derive.registry(spark)).count()
    assert "sha2(" in plans["active-claims"] and "sha2(" not in plans["contestable"]


def test_conflicts_are_made_once(spark, small, monkeypatch):
    """A query that needs the conflicts twice finds them once, and what reads them reads a table."""
    for name in ("q02_query", "v19_link_graph", "v20_neighbours", "v13_core_context", "c09_resolution_check", "c15_resolution_preservation", "v05_scenario_subject", "v18_next_actions", "r01_retrieval_documents", "c14_list_conflicts", "v08_scenario_work"):
        made = []
        monkeypatch.setattr(claims, "written", lambda df, of: made.append(of) or written(df, of))
        plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert made.count("active-claims") == 1 and "opening" not in plan, name


def test_rows_of_ids_are_dealt_by_their_number(spark, small, monkeypatch, tmp_path):
    """Rows that meet by short ids come in as many parts as their number asks for, which Spark doesn't join again; the results are the same."""
    monkeypatch.setattr(scratch, "TASK_ROWS", 100)
    path, duck = copies(spark, small, tmp_path, {})
    n = -(-spark.read.parquet(f"{small}/orders.parquet").count() // 100)
    for name in ("q02_query", "q04_matched_fields", "c12_epistemic_context", "v02_enrich_claims", "v05_scenario_subject", "v07_scenario_incident"):
        plan = registry.QUERIES[name](spark, path)._jdf.queryExecution().executedPlan().toString()
        assert f", {n}), REPARTITION_BY_NUM" in plan, name
        same(spark, path, duck, name)
    for name in ("v19_link_graph", "v20_neighbours"):
        same(spark, path, duck, name)
    dealt = registry.QUERIES["v19_link_graph"](spark, path)
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()


def test_scores_of_records_are_listed_and_not_grouped(spark, small, monkeypatch, tmp_path):
    """No row for a request and a record is shuffled (X02); without broadcasts, in blocks of few requests, by rows where there are too many classes, and with rows that repeat an id the scores are those of the SQL."""
    plan = search_queries.scored(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and not any("Aggregate [" in line and "request_id#" in line and ", id#" in line for line in plan.splitlines())
    customer = spark.read.parquet(f"{small}/customer.parquet")
    (tmp_path / "again").mkdir()
    path, duck = copies(spark, small, tmp_path / "again", {"customer": customer.unionByName(customer.where("c_custkey < 9"))})
    same(spark, path, duck, "x02_score_records")
    for of, most in (("FEW_TEXTS", 0), ("BROADCAST", 0), ("QUERY_BLOCK", 3)):
        monkeypatch.setattr(request_classes, of, most)
    same(spark, path, duck, "x02_score_records")
    monkeypatch.setattr(request_classes, "MATRIX", 0)
    (tmp_path / "rows").mkdir()
    same(spark, *copies(spark, small, tmp_path / "rows", {}), "x02_score_records")
