"""The queries that do the whole job, against brute force on the smallest tables."""

from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq

from tallystone.plans import registry


def rows(small, name, *columns):
    return pq.read_table(f"{small}/{name}.parquet", columns=list(columns)).to_pylist()


def test_searches_answer_every_hundredth_vector(spark, small):
    e = sorted(rows(small, "embeddings", "vec_id", "embedding", "label"), key=lambda r: r["vec_id"])
    m = np.array([r["embedding"] for r in e], dtype=float)
    m /= np.sqrt((m * m).sum(1))[:, None]
    asked = [i for i, r in enumerate(e) if r["vec_id"] % 100 == 0]
    assert len(asked) > 1
    near, fused = {}, {}
    for i in asked:
        s = m @ m[i]
        best = sorted(((-s[j], f"v{r['vec_id']}") for j, r in enumerate(e) if j != i))[:10]
        near |= {(f"v{e[i]['vec_id']}", v): -x for x, v in best}
        got = defaultdict(float)
        for n, (_, v) in enumerate(best, 1):
            got[v] += 1 / (60 + n)
        for n, r in enumerate([r for r in e if r["label"] == e[i]["label"] and r is not e[i]][:50], 1):
            got[f"v{r['vec_id']}"] += 1 / (60 + n)
        fused |= {(f"v{e[i]['vec_id']}", v): x for x, v in sorted((-round(x, 12), v) for v, x in got.items())[:10]}
    found = {(r["query_id"], r["document_id"]): r["score"] for r in registry.QUERIES["r07_vector_search"](spark, small).collect()}
    assert found.keys() == near.keys() and all(abs(found[k] - near[k]) < 2e-6 for k in near)
    found = {(r["query_id"], r["document_id"]): r["score"] for r in registry.QUERIES["r08_rrf"](spark, small).collect()}
    assert found.keys() == fused.keys() and all(abs(found[k] + fused[k]) < 2e-6 for k in fused)


def test_graph_has_all_orders_and_impact_its_steps_and_edges(spark, small):
    edges = {(f"n{r['o_orderkey']}", f"n{r['o_custkey']}") for r in rows(small, "orders", "o_orderkey", "o_custkey")}
    parts = {f"n{r['p_partkey']}" for r in rows(small, "part", "p_partkey")}
    found = registry.QUERIES["k03_known_edges"](spark, small).collect()
    assert sorted((r["source_id"], r["target_id"]) for r in found) == sorted(e for e in edges if e[0] in parts and e[1] in parts)
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = []
    for start in {f"n{r['s_suppkey']}" for r in rows(small, "supplier", "s_suppkey")}:
        depth, level = {start: 0}, [start]
        for n in range(1, 5):
            met = defaultdict(list)
            for u in level:
                for w in near[u]:
                    want.append((start, "step", u, w, n))
                    met[w].append(u)
            level = [w for w in met if w not in depth]
            depth |= dict.fromkeys(level, n)
            want += [(start, "reached", min(met[w]), w, n) for w in level]
        want += [(start, "edge", a, b, None) for a, b in edges if a in depth and b in depth and len(depth) > 1]
    got = [tuple(r) for r in registry.QUERIES["k04_impact"](spark, small).select("start_id", "part", "source_id", "target_id", "depth").collect()]
    assert any(p == "step" and depth == 2 and w == s for s, p, _, w, depth in got)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_packing_walks_every_candidate(spark, small):
    from tallystone.operators import context as X
    from tallystone.plans import search_queries as S

    budget = {r["request_id"]: r["budget"] for r in X.normalize_requests(S.requests(spark, small)).collect()}
    of, skip, prefix, told = defaultdict(list), {}, {}, {}
    for r in S.sized(spark, small).collect():
        of[r["request_id"]].append(r)
    assert max(map(len, of.values())) > 60
    for q, items in of.items():
        items.sort(key=lambda r: r["position"])
        used, bad, flags = 0, False, {}
        for r in items:
            fits = used + r["bytes"] + 32 <= budget[q]
            used += r["bytes"] + 32 if fits else 0
            bad |= r["mandatory"] and not fits
            flags[r["id"]] = fits
        skip |= {(q, i): (f, "CONTEXT_REFERENCE_EXCEEDS_BUDGET" if bad else None) for i, f in flags.items()}
        over, total = sum(r["bytes"] + 32 for r in items if r["mandatory"]) > budget[q], 0
        for r in sorted(items, key=lambda r: (not r["mandatory"], r["position"])):
            total += r["bytes"] + 32
            fits = not over and total <= budget[q]
            prefix[q, r["id"]] = fits, "CONTEXT_BUDGET_EXCEEDED" if over else None
            told.setdefault((q, r["kind"]), [0, 0])[not fits] += 1
    for name, want in (("x06_pack_skip", skip), ("x07_pack_prefix", prefix)):
        got = registry.QUERIES[name](spark, small).collect()
        assert len(got) == len(want) and {(r["request_id"], r["id"]): (r["included"], r["code"]) for r in got} == want
    assert {(r["request_id"], r["section"]): [r["included"], r["omitted"]] for r in registry.QUERIES["x10_truncation_report"](spark, small).collect()} == told


def test_pack_skip_has_no_cap(spark):
    from tallystone.operators import context as X

    items = spark.range(1, 2502).selectExpr("'r' request_id", "cast(id as int) position", "concat('i', id) id", "if(id = 2500, 5L, 100L) bytes", "id = 2501 mandatory")
    got = X.pack_skip(items, spark.createDataFrame([("r", 2498 * 132 + 40)], "request_id string, budget long")).collect()
    assert len(got) == 2501 and {r["position"] for r in got if not r["included"]} == {2499, 2501}
    assert {r["code"] for r in got} == {"CONTEXT_REFERENCE_EXCEEDS_BUDGET"}
