"""Queries R01-R12, K01-K04 and X01-X10."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystone.operators import context as X
from tallystone.operators import graph as K
from tallystone.operators import request_classes as RC
from tallystone.operators import retrieval as R
from tallystone.operators import search_index as SI
from tallystone.plans import view_queries as VQ
from tallystone.plans.derive import sources, table
from tallystone.sources.scratch import new_path, written


def documents(s, d):
    return table(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("document_id"), F.lit("SOURCE_TEXT").alias("kind"), F.col("source").alias("title"), F.col("text").alias("body"))


def queries(s, d):
    """Two words of each benchmark item, by length and alphabet."""
    ordered = F.array_sort(F.transform(R.query_terms(F.col("text")), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))
    return table(s, d, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("query_id"), F.concat_ws(" ", F.get(ordered, F.lit(0))["t"], F.get(ordered, F.lit(3))["t"]).alias("query"))


_TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
_Q = f"""o AS (SELECT item_id, list_sort(list_transform(list_distinct({_TOKENS.format('text')}), lambda t: struct_pack(n := length(t), t := t))) AS o FROM benchmark), qs AS (SELECT 'q' || item_id AS query_id, concat_ws(' ', o[1].t, o[4].t) AS query, list_distinct([o[1].t, o[4].t]) AS terms FROM o)"""
_DOCS = f"""w AS (SELECT 'd' || doc_id AS document_id, source || chr(10) || coalesce(text, '') AS hay, {_TOKENS.format("source || chr(10) || coalesce(text, '')")} AS ws FROM documents)"""
_INDEX = f"""{_DOCS}, tw AS (SELECT document_id, unnest(ws) AS term FROM w), idx AS (SELECT term, document_id, len(ws)::INTEGER AS length, tf FROM (SELECT term, document_id, count(*) AS tf FROM tw GROUP BY ALL) JOIN w USING (document_id))"""
_BM = f"""{_Q}, {_INDEX}, qt AS (SELECT query_id, unnest(terms) AS term FROM qs), st AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w), df AS (SELECT term, count(*) AS df FROM idx GROUP BY 1),
sc AS (SELECT query_id, document_id, count(*) AS met, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM qt JOIN idx USING (term) JOIN df USING (term), st GROUP BY ALL),
bm AS (SELECT query_id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM sc JOIN (SELECT query_id, count(*) AS k FROM qt GROUP BY 1) USING (query_id) WHERE met = k QUALIFY rank <= 60)"""
_TC = f"""{_Q}, {_DOCS}, tc AS (SELECT query_id, document_id, list_sum(list_transform(terms, lambda t: (length(lower(hay)) - length(replace(lower(hay), t, ''))) / length(t)))::DOUBLE AS score FROM w, qs)"""
_VEC = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
vs AS (SELECT 'v' || a.vec_id AS query_id, 'v' || b.vec_id AS document_id, list_dot_product(a.e, b.e) / (a.n * b.n) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM vs QUALIFY rank <= 10)"""


def bm25(s, d, limit=60):
    """An index is made only for more queries than are sent to every task."""
    if (found := R.bm25_once(queries(s, d), documents(s, d), limit)) is not None:
        return found
    path = new_path(s, "index")
    SI.build_index(documents(s, d), path)
    return SI.search(s, path, queries(s, d), limit)


def rounded(df):
    return df.select("query_id", "document_id", F.round("score", 6).alias("score"))


# The query set of a search: every row whose id is divisible by 100.
ASKED = "vec_id % 100 = 0"


def vectors(s, d):
    e = table(s, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("document_id"), "embedding", "vec_id")
    return R.vector_search(e.where(ASKED).select(F.col("document_id").alias("query_id"), "embedding"), e, 10)


def same_label(s, d, limit=50):
    """A second ranking: the first vectors of the query's label, by id. They are among one more than so many of a label, as only the query itself is left out, so no label is joined whole."""
    e = table(s, d, "embeddings")
    first = e.select("vec_id", "label").withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where(F.col("at") <= limit + 1).drop("at")
    j = e.where(ASKED).select(F.col("vec_id").alias("q"), "label").join(first, "label").where("q <> vec_id")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("vec_id"))
    return j.select(F.concat(F.lit("v"), "q").alias("query_id"), F.concat(F.lit("v"), "vec_id").alias("document_id"), rank.alias("rank")).where(F.col("rank") <= limit)


def updated(s, d):
    e = table(s, d, "events")
    k = F.col("c_custkey")
    r = table(s, d, "customer").select(F.concat(F.lit("user_"), k).alias("object_id"), F.when(k % 5 == 0, "2024-02-01").alias("recorded_at"), F.when(k % 7 == 0, "2024-03-01").alias("captured_at"))
    history = e.select(F.concat(F.lit("user_"), "user_id").alias("object_id"), F.col("event_id").alias("seq"))
    commits = e.select(F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd").alias("committed_at"))
    return R.with_updated_at(r, history, commits, "2024-12-31").select("object_id", "updated_at")


def evaluation(s, d):
    b = table(s, d, "benchmark")
    k = F.col("item_id")
    cases = b.select(k.alias("case_id"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("d"), k), F.concat(F.lit("d"), k + 1))).alias("expected_ids"), F.array(F.concat(F.lit("c"), k % 3)).alias("expected_conflict_ids"), (k * 7 % 50).cast("double").alias("elapsed_ms"))
    got = b.select(k.alias("case_id"), F.explode(F.array(F.concat(F.lit("d"), k), F.concat(F.lit("c"), k % 2))).alias("document_id"), (k % 3 != 0).alias("traceable"), (k % 2 == 0).alias("evidence"), (k % 4 == 0).alias("evidence_traceable"), (k * 10).alias("bytes"))
    return R.retrieval_eval(cases, got).select("cases", *[F.round(c, 6).alias(c) for c in ("mean_recall", "mean_conflict_recall", "mean_bytes", "p95_ms", "traceability", "evidence_traceability")])


def spans(s, d):
    """A line of each document, which one by its id; some requests are out of range, invalid or name no revision."""
    k = F.col("doc_id")
    lines = table(s, d, "documents").select(k, F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("ls")).withColumn("i", (k % F.size("ls")).cast("int"))
    at = F.when(F.col("i") > 0, F.octet_length(F.array_join(F.slice("ls", F.lit(1), F.col("i")), "\n")) + 1).otherwise(0)
    j = lines.select(k, at.cast("long").alias("at"), F.octet_length(F.get("ls", F.col("i"))).cast("long").alias("n"))
    req = j.select(F.concat(F.lit("r"), k).alias("request_id"), F.when(k % 11 == 0, "none").otherwise(F.concat(F.lit("revision_"), k)).alias("revision_id"), F.when(k % 7 == 0, -1).otherwise(F.col("at")).alias("start_byte"), F.when(k % 5 == 0, 1 << 30).otherwise(F.col("at") + F.col("n")).alias("end_byte"))
    return R.read_spans(req, sources(s, d))


def code_lines(s, d):
    """A file per customer: an order is a class, a method, a function or a statement."""
    k = F.col("o_orderkey")
    line = F.when(k % 4 == 0, F.concat(F.lit("class Order"), k, F.lit(":"))).when(k % 4 == 1, F.concat(F.lit("    def item"), k, F.lit("(self):"))).when(k % 4 == 2, F.concat(F.lit("def top"), k, F.lit("():"))).otherwise("        call()")
    rows = table(s, d, "orders").select(F.concat(F.lit("src/c"), "o_custkey", F.lit(".py")).alias("path"), k, line.alias("line"))
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy("path").orderBy("o_orderkey"))).drop("o_orderkey")


CODE = """code AS (SELECT 'src/c' || o_custkey || '.py' AS path, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders),
tops AS (SELECT *, max(CASE WHEN k % 4 IN (0, 2) THEN line_no END) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top_line, min(CASE WHEN k % 4 IN (0, 2) THEN line_no END) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_top FROM code WHERE k % 4 <> 3),
defs AS (SELECT a.*, t.k AS top_k, lead(a.line_no) OVER (PARTITION BY a.path ORDER BY a.line_no) AS next_any FROM tops a LEFT JOIN code t ON t.path = a.path AND t.line_no = a.top_line),
syms AS (SELECT path, CASE WHEN k % 4 = 0 THEN 'CLASS' WHEN k % 4 = 1 AND top_k % 4 = 0 THEN 'METHOD' ELSE 'FUNCTION' END AS kind, ['Order', 'item', 'top'][k % 4 + 1] || k AS name, CASE WHEN k % 4 = 1 AND top_k % 4 = 0 THEN 'Order' || top_k || '.' ELSE '' END || ['Order', 'item', 'top'][k % 4 + 1] || k AS qualified_name,
  line_no::INTEGER AS start_line, coalesce(CASE WHEN k % 4 = 1 THEN next_any ELSE next_top END - 1, size)::INTEGER AS end_line FROM defs
  UNION ALL SELECT DISTINCT path, 'MODULE', path, path, 1, size::INTEGER FROM code)"""


def graph(s, d):
    """An edge from each order to its customer, by their own ids."""
    return table(s, d, "orders").select(F.concat(F.lit("n"), "o_orderkey").alias("source_id"), F.concat(F.lit("n"), "o_custkey").alias("target_id"), F.lit("CALLS").alias("edge_kind")).distinct()


def impact(s, d):
    """What each supplier's node reaches, the steps to it and the edges among it, each as a part."""
    e, start = written(graph(s, d), "edges"), table(s, d, "supplier").select(F.concat(F.lit("n"), "s_suppkey").alias("object_id"))
    reached = written(K.impact(e, start), "impact")
    paths, edges = K.impact_steps(e, start, reached), K.induced_edges(e, reached)
    none = F.lit(None).cast("int")
    parts = [reached.select("start_id", F.lit("reached").alias("part"), F.col("via").alias("source_id"), F.col("object_id").alias("target_id"), "depth"), paths.select("start_id", F.lit("step"), "u", "w", "depth"), edges.select("start_id", F.lit("edge"), "source_id", "target_id", none)]
    return reduce(DataFrame.union, parts)


_IMPACT = """e AS MATERIALIZED (SELECT DISTINCT o_orderkey AS s, o_custkey AS t FROM orders), st AS MATERIALIZED (SELECT s AS u, t AS w FROM e UNION SELECT t, s FROM e),
walk AS (SELECT s_suppkey AS a, s_suppkey AS n, 0 AS depth FROM supplier UNION SELECT a, w, depth + 1 FROM walk JOIN st ON n = u WHERE depth < 4),
near AS MATERIALIZED (SELECT a, n, min(depth) AS depth FROM walk GROUP BY a, n), steps AS MATERIALIZED (SELECT a, u, w, depth + 1 AS depth FROM near JOIN st ON n = u WHERE depth < 4),
reached AS (SELECT near.a, min('n' || u) AS via, n, near.depth FROM near JOIN steps ON steps.a = near.a AND w = n AND steps.depth = near.depth WHERE near.depth > 0 GROUP BY near.a, n, near.depth)"""


def resolved(s, d):
    """Symbols resolve by their numbers and are named at the end: names cut keys of more than six digits, so they neither tell all symbols apart nor keep their order."""
    k = F.col("p_partkey")
    p = table(s, d, "part")
    sym = p.select(k.alias("symbol_id"), F.concat(F.lit("f"), k % 300).alias("name"))
    men = p.select(k.alias("source_id"), F.concat(F.lit("f"), k * 7 % 400).alias("name"), (k % 3 == 0).alias("is_call")).union(p.select(k, F.concat(F.lit("f"), k % 300), F.lit(False)))
    name = lambda c: F.concat(F.lit("s"), F.lpad(F.col(c).cast("string"), 6, "0")).alias(c)
    return K.resolve_edges(sym, men).select(name("source_id"), name("target_id"), "edge_kind")


def requests(s, d):
    k = F.col("item_id")
    return table(s, d, "benchmark").select(
        F.concat(F.lit("req_"), k).alias("request_id"), F.col("text").alias("task"), F.when(k % 3 == 0, "Supplier#000000003 Customer").alias("query"), F.when(k % 2 == 0, F.array(F.concat(F.lit("work_"), k), F.concat(F.lit("decision_"), k), F.concat(F.lit("work_"), k))).alias("refs"),
        F.when(k % 4 == 0, "EVIDENCE").alias("depth"), F.when(k % 5 != 0, 2000 + 500 * (k % 7)).alias("budget_bytes"), F.when(k % 3 == 0, 400).alias("budget_tokens"), F.when(k % 9 == 0, F.create_map(F.lit("tenant"), F.lit("x"))).alias("hints"),
    )


REQ = r"""req AS (SELECT 'req_' || item_id AS request_id, item_id AS k, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text || CASE WHEN item_id % 3 = 0 THEN ' Supplier#000000003 Customer' ELSE '' END, '[A-Za-z0-9_:.@/-]+'), lambda t: lower(t)), lambda t: length(t) > 1))) AS terms,
  CASE WHEN item_id % 2 = 0 THEN ['decision_' || item_id, 'work_' || item_id] ELSE []::VARCHAR[] END AS refs, coalesce(least(CASE WHEN item_id % 5 <> 0 THEN 2000 + 500 * (item_id % 7) END, CASE WHEN item_id % 3 = 0 THEN 1600 END), 65536)::BIGINT AS budget FROM benchmark)"""


def continuity(s, d):
    return VQ.records(s, d).where("kind in ('DECISION_RECORD', 'OPEN_QUESTION', 'WORK_ITEM', 'CONFLICT')").withColumn("document", F.col("status"))


def scored(s, d):
    r, records = written(X.normalize_requests(requests(s, d)), "requests"), continuity(s, d)
    c = RC.record_classes(r, records)
    return X.score_records(r, records) if c is None else RC.list_scores(c)


_SCORE = f"""{VQ.RECORDS}, {REQ}, sc AS (SELECT request_id, object_id AS id, (CASE WHEN list_contains(refs, object_id) THEN 10000 ELSE 0 END + 20 * len(list_filter(terms, lambda t: contains(lower(concat_ws(' ', title, status)), t))) + CASE priority WHEN 'P0' THEN 15 WHEN 'P1' THEN 8 ELSE 0 END
  + CASE WHEN kind = 'CONFLICT' THEN 30 ELSE 3 END)::BIGINT AS score FROM records, req WHERE kind IN ('DECISION_RECORD', 'OPEN_QUESTION', 'WORK_ITEM', 'CONFLICT'))"""


def view_rows(s, d):
    return table(s, d, "customer").select(F.concat(F.lit("view_"), "c_custkey").alias("artifact_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("document"))


def skill_rows(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select(F.concat(F.lit("skill_"), k).alias("skill_id"), F.when(k % 4 == 0, "DRAFT").otherwise("APPROVED").alias("status"), F.array("p_name").alias("triggers"), F.col("p_type").alias("purpose"), F.array("p_brand").alias("preconditions"))


_VIEWS = f"{REQ}, vw AS (SELECT request_id, 'view_' || c_custkey AS id, (10 * len(list_filter(terms, lambda t: contains(lower(c_name || ' ' || c_mktsegment), t))))::BIGINT AS score FROM customer, req)"
_SKILLS = """sk AS (SELECT request_id, 'skill_' || p_partkey AS id, list_sum(list_transform(terms, lambda t: CASE WHEN contains(lower(p_name), t) THEN 3 WHEN contains(lower(p_type || ' ' || p_name || ' ' || p_brand), t) THEN 1 ELSE 0 END))::BIGINT AS score FROM part, req WHERE p_partkey % 4 <> 0),
st AS (SELECT * FROM sk WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) <= 5)"""


def by_class(s, d):
    """The candidates by classes of rows, None if there are too many classes."""
    return RC.classes(written(X.normalize_requests(requests(s, d)), "requests"), continuity(s, d), view_rows(s, d), skill_rows(s, d))


def ordered(s, d):
    if (c := by_class(s, d)) is not None:
        return RC.order_by_classes(c)
    r = X.normalize_requests(requests(s, d))
    return X.order_candidates(X.score_records(r, continuity(s, d)), X.score_views(r, view_rows(s, d)), X.score_skills(r, skill_rows(s, d)))


_ORDERED = f"{_SCORE}, {_VIEWS.replace(REQ + ', ', '')}, {_SKILLS}, un AS (SELECT *, 'record' AS kind FROM sc WHERE score > 0 UNION ALL SELECT *, 'scenario' FROM vw WHERE score > 0 UNION ALL SELECT *, 'skill' FROM st), od AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, kind, id)::INTEGER AS position, kind, id, score FROM un)"


def sized(s, d):
    """All candidates with sizes."""
    return ordered(s, d).withColumn("bytes", _size()).withColumn("mandatory", F.col("score") >= 10_000)


def _size():
    return (F.length("id") * 17 % 300 + 20).cast("long")


def shared_sized(s, d):
    """The same as one order that all requests share, and each request's own."""
    shared, own = X.candidates(X.normalize_requests(requests(s, d)), continuity(s, d), view_rows(s, d), skill_rows(s, d))
    return shared.withColumn("bytes", _size()), own.withColumn("bytes", _size()).withColumn("mandatory", F.col("score") >= 10_000)


_SIZED = f"{_ORDERED}, sz AS (SELECT *, (length(id) * 17 % 300 + 20)::BIGINT + 32 AS b, score >= 10000 AS m FROM od)"


def packed(s, d, skip):
    """What packing includes, as a flag of every candidate of every request."""
    if (c := by_class(s, d)) is not None:
        included, told, _ = RC.pack_classes(c, _size(), skip)
        return RC.flagged(c, included, told)
    r = written(X.normalize_requests(requests(s, d)), "requests")
    shared, own = (written(x, "candidates") for x in shared_sized(s, d))
    included, told = X.pack_shared(shared, own, r, skip)
    rows = X.for_each_request(shared.select("kind", "id"), own.select("request_id", "kind", "id"), r, ["kind", "id"])
    flagged = rows.join(included.withColumn("included", F.lit(True)), ["request_id", "kind", "id"], "left").join(told, "request_id")
    return flagged.select("request_id", "id", F.coalesce("included", F.lit(False)).alias("included"), "code")


def report(s, d):
    if (c := by_class(s, d)) is not None:
        included, _, within = RC.pack_classes(c, _size(), False)
        return RC.report_classes(c, included, within)
    r = written(X.normalize_requests(requests(s, d)), "requests")
    shared, own = (written(x, "candidates") for x in shared_sized(s, d))
    return X.report_shared(shared, own, X.pack_shared(shared, own, r, False)[0], r)


_PREFIX = f"""{_SIZED}, mu AS (SELECT request_id, sum(b) FILTER (WHERE m) AS must FROM sz GROUP BY 1), pf AS (SELECT request_id, id, kind, coalesce(must, 0) <= budget AND sum(b) OVER (PARTITION BY request_id ORDER BY m DESC, position, id ROWS UNBOUNDED PRECEDING) <= budget AS included,
  CASE WHEN must > budget THEN 'CONTEXT_BUDGET_EXCEEDED' END AS code FROM sz JOIN req USING (request_id) JOIN mu USING (request_id))"""


def depth(s, d):
    r = requests(s, d).select("request_id", F.coalesce("depth", F.lit("SUMMARY")).alias("depth"), F.col("task").alias("document"), F.col("task").alias("evidence"))
    return X.project_depth(r, F.col("depth"))


QUERIES = {
    "r01_retrieval_documents": lambda s, d: R.retrieval_documents({"SOURCE_TEXT": documents(s, d), "RECORD": VQ.records(s, d).select(F.col("object_id").alias("document_id"), "title", F.col("status").alias("body"))}).select("document_id", "kind", "title", F.md5("body").alias("body")),
    "r02_updated_at": updated,
    "r03_tokens": lambda s, d: table(s, d, "documents").select("doc_id", F.size(R.tokens(F.col("text"))).alias("n"), F.size(R.query_terms(F.col("text"))).alias("n_distinct"), F.md5(F.array_join(R.tokens(F.col("text")), " ")).alias("words")),
    "r04_postings": lambda s, d: R.postings(documents(s, d)),
    "r05_bm25_search": lambda s, d: rounded(bm25(s, d, 20)),
    "r06_term_count_search": lambda s, d: rounded(R.term_count_search(queries(s, d), documents(s, d), 20)),
    "r07_vector_search": lambda s, d: rounded(vectors(s, d)),
    "r08_rrf": lambda s, d: rounded(R.rrf([vectors(s, d), same_label(s, d)], 10)),
    "r09_retrieval_eval": evaluation,
    "r10_read_spans": spans,
    "r11_find_symbols": lambda s, d: R.find_symbols(K.symbols(code_lines(s, d)), "ITEM1", None).select("path", "qualified_name"),
    "r12_index_fingerprint": lambda s, d: R.index_fingerprint(documents(s, d)),
    "k01_symbols": lambda s, d: K.symbols(code_lines(s, d)).drop("symbol_id"),
    "k02_resolve_edges": resolved,
    "k03_known_edges": lambda s, d: K.known_edges(graph(s, d), table(s, d, "part").select(F.concat(F.lit("n"), "p_partkey").alias("symbol_id"))),
    "k04_impact": impact,
    "x01_normalize_requests": lambda s, d: X.normalize_requests(requests(s, d)).select("request_id", F.array_join("terms", " ").alias("terms"), F.array_join("refs", " ").alias("refs"), "budget", "code"),
    "x02_score_records": scored,
    "x03_score_views": lambda s, d: X.score_views(X.normalize_requests(requests(s, d)), view_rows(s, d)),
    "x04_score_skills": lambda s, d: X.score_skills(X.normalize_requests(requests(s, d)), skill_rows(s, d)),
    "x05_order_candidates": ordered,
    "x06_pack_skip": lambda s, d: packed(s, d, True),
    "x07_pack_prefix": lambda s, d: packed(s, d, False),
    "x08_project_depth": depth,
    "x09_token_estimate": lambda s, d: table(s, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens")),
    "x10_truncation_report": report,
}

ORACLE_SQL = {
    "r01_retrieval_documents": f"WITH {VQ.RECORDS} SELECT 'd' || doc_id AS document_id, 'SOURCE_TEXT' AS kind, source AS title, md5(coalesce(text, '')) AS body FROM documents UNION ALL SELECT object_id, 'RECORD', coalesce(title, ''), md5(status) FROM records",
    "r02_updated_at": "SELECT 'user_' || c_custkey AS object_id, CASE WHEN c_custkey % 5 = 0 THEN '2024-02-01' WHEN c_custkey % 7 = 0 THEN '2024-03-01' ELSE coalesce((SELECT strftime(arg_max(ts, event_id), '%Y-%m-%d') FROM events WHERE user_id = c_custkey), '2024-12-31') END AS updated_at FROM customer",
    "r03_tokens": f"WITH t AS (SELECT doc_id, {_TOKENS.format('text')} AS ws FROM documents) SELECT doc_id, len(ws)::INTEGER AS n, len(list_distinct(ws))::INTEGER AS n_distinct, md5(array_to_string(ws, ' ')) AS words FROM t",
    "r04_postings": f"WITH {_INDEX} SELECT term, document_id, length, tf FROM idx",
    "r05_bm25_search": f"WITH {_BM} SELECT query_id, document_id, round(score, 6) AS score FROM bm WHERE rank <= 20",
    "r06_term_count_search": f"WITH {_TC} SELECT query_id, document_id, score FROM tc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) <= 20",
    "r07_vector_search": f"WITH {_VEC} SELECT query_id, document_id, round(score, 6) AS score FROM vr",
    "r08_rrf": f"""WITH {_VEC}, lr AS (SELECT 'v' || a.vec_id AS query_id, 'v' || b.vec_id AS document_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        f AS (SELECT query_id, document_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT query_id, document_id, rank FROM vr UNION ALL SELECT * FROM lr WHERE rank <= 50) GROUP BY ALL)
        SELECT query_id, document_id, round(score, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, document_id) <= 10""",
    "r09_retrieval_eval": """SELECT count(*) AS cases, round(avg(CASE WHEN item_id % 4 = 0 THEN 1.0 ELSE 0.5 END), 6) AS mean_recall, round(avg((item_id % 3 = item_id % 2)::INTEGER), 6) AS mean_conflict_recall, round(avg(item_id * 20), 6) AS mean_bytes,
        quantile_disc((item_id * 7 % 50)::DOUBLE, 0.95) AS p95_ms, round(avg((item_id % 3 <> 0)::INTEGER), 6) AS traceability, round(avg((item_id % 4 = 0)::INTEGER) FILTER (WHERE item_id % 2 = 0), 6) AS evidence_traceability FROM benchmark""",
    "r10_read_spans": """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), x AS (SELECT doc_id, ls[doc_id % len(ls) + 1] AS line FROM l), y AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'SOURCE_NOT_FOUND' WHEN doc_id % 7 = 0 OR (line = '' AND doc_id % 5 <> 0) THEN 'SPAN_INVALID' WHEN doc_id % 5 = 0 THEN 'SPAN_OUT_OF_RANGE' END AS code FROM x)
        SELECT 'r' || doc_id AS request_id, code, CASE WHEN code IS NULL THEN line END AS excerpt, CASE WHEN code IS NULL THEN 'sha256:' || sha256(line) END AS excerpt_hash FROM y""",
    "r11_find_symbols": f"WITH {CODE} SELECT path, qualified_name FROM syms WHERE lower(name) LIKE '%item1%' OR lower(qualified_name) LIKE '%item1%'",
    "r12_index_fingerprint": """WITH r AS (SELECT sha256('d' || doc_id) AS b, 'd' || doc_id AS k, sha256('d' || doc_id || '|' || coalesce(text, 'null') || '|SOURCE_TEXT|' || coalesce(source, 'null')) AS h FROM documents), g4 AS (SELECT substr(b, 1, 4) AS b, sha256(string_agg(h, '' ORDER BY k)) AS h FROM r GROUP BY ALL), g2 AS (SELECT substr(b, 1, 2) AS b, sha256(string_agg(h, '' ORDER BY b)) AS h FROM g4 GROUP BY substr(b, 1, 2))
        SELECT 'sha256:' || sha256(string_agg(h, '' ORDER BY b)) AS digest FROM g2""",
    "k01_symbols": f"WITH {CODE} SELECT * FROM syms",
    "k02_resolve_edges": """WITH f AS (SELECT p_partkey % 300 AS n, min(p_partkey) AS t FROM part GROUP BY 1), m AS (SELECT p_partkey AS s, p_partkey * 7 % 400 AS n, p_partkey % 3 = 0 AS c FROM part UNION ALL SELECT p_partkey, p_partkey % 300, false FROM part), e AS (SELECT DISTINCT s, t, c FROM m JOIN f USING (n)),
        r AS (SELECT s, t, 'CALLS' AS edge_kind FROM e WHERE c UNION ALL SELECT s, t, 'REFERENCES' FROM e a WHERE NOT c AND s <> t AND NOT EXISTS (SELECT 1 FROM e b WHERE b.c AND b.s = a.s AND b.t = a.t))
        SELECT 's' || lpad(s::VARCHAR, 6, '0') AS source_id, 's' || lpad(t::VARCHAR, 6, '0') AS target_id, edge_kind FROM r""",
    "k03_known_edges": "SELECT DISTINCT 'n' || o_orderkey AS source_id, 'n' || o_custkey AS target_id, 'CALLS' AS edge_kind FROM orders WHERE o_orderkey IN (SELECT p_partkey FROM part) AND o_custkey IN (SELECT p_partkey FROM part)",
    "k04_impact": f"""WITH RECURSIVE {_IMPACT} SELECT 'n' || a AS start_id, 'reached' AS part, via AS source_id, 'n' || n AS target_id, depth FROM reached
        UNION ALL SELECT 'n' || a, 'step', 'n' || u, 'n' || w, depth FROM steps
        UNION ALL SELECT 'n' || x.a, 'edge', 'n' || s, 'n' || t, NULL FROM e JOIN near x ON x.n = s JOIN near y ON y.n = t AND y.a = x.a WHERE x.a IN (SELECT a FROM near WHERE depth > 0)""",
    "x01_normalize_requests": f"WITH {REQ} SELECT request_id, array_to_string(terms, ' ') AS terms, array_to_string(refs, ' ') AS refs, budget, CASE WHEN k % 9 = 0 THEN 'HINT_FORBIDDEN' END AS code FROM req",
    "x02_score_records": f"WITH {_SCORE} SELECT * FROM sc WHERE score > 0",
    "x03_score_views": f"WITH {_VIEWS} SELECT * FROM vw WHERE score > 0",
    "x04_score_skills": f"WITH {REQ}, {_SKILLS} SELECT * FROM st",
    "x05_order_candidates": f"WITH {_ORDERED} SELECT * FROM od",
    "x06_pack_skip": f"""WITH {_SIZED}, walk AS (SELECT request_id, budget, list(struct_pack(u := 0::BIGINT, b := b, p := position, inc := []::INTEGER[]) ORDER BY position) AS items FROM sz JOIN req USING (request_id) GROUP BY ALL),
        got AS (SELECT request_id, list_reduce(list_prepend(struct_pack(u := 0::BIGINT, b := 0::BIGINT, p := 0, inc := []::INTEGER[]), items), lambda a, x: CASE WHEN a.u + x.b <= budget THEN struct_pack(u := a.u + x.b, b := x.b, p := x.p, inc := list_append(a.inc, x.p)) ELSE a END).inc AS inc FROM walk),
        fit AS (SELECT request_id, unnest(inc) AS position, true AS ok FROM got), fl AS (SELECT request_id, id, m, coalesce(ok, false) AS included FROM sz LEFT JOIN fit USING (request_id, position))
        SELECT request_id, id, included, CASE WHEN bool_or(m AND NOT included) OVER (PARTITION BY request_id) THEN 'CONTEXT_REFERENCE_EXCEEDS_BUDGET' END AS code FROM fl""",
    "x07_pack_prefix": f"WITH {_PREFIX} SELECT request_id, id, included, code FROM pf",
    "x08_project_depth": "SELECT 'req_' || item_id AS request_id, CASE WHEN item_id % 4 = 0 THEN 'EVIDENCE' ELSE 'SUMMARY' END AS depth, CASE WHEN item_id % 4 = 0 THEN text END AS document, CASE WHEN item_id % 4 = 0 THEN text END AS evidence FROM benchmark",
    "x09_token_estimate": "SELECT doc_id, ceil(strlen(coalesce(text, '')) / 4)::BIGINT AS tokens FROM documents",
    "x10_truncation_report": f"WITH {_PREFIX} SELECT request_id, kind AS section, count(*) FILTER (WHERE included) AS included, count(*) FILTER (WHERE NOT included) AS omitted, min(id) FILTER (WHERE NOT included) AS first_omitted FROM pf GROUP BY ALL",
}
