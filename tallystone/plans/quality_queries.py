"""Queries P01-P04, M01-M13 and T01-T10."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions.canon import digest
from tallystone.operators import metrics as M
from tallystone.operators import policy as P
from tallystone.plans import claim_queries as CQ
from tallystone.plans import derive as D
from tallystone.plans import ledger_queries as LQ
from tallystone.plans.derive import evidence, sources, table
from tallystone.streaming import traces as T

# A small policy over hosts.
LABELS = [("http://", "INTERNAL", ["web"]), ("https://", "PUBLIC", ["web", "tls"]), ("https://m.", "SECRET", ["mobile"])]
PINS = {"request_version": "1", "endpoint_id": "e1", "protocol_version": "p1", "adapter_version": "a1", "registry_version": "r1"}


def labels(s):
    return s.createDataFrame(LABELS, "source_root string, sensitivity string, data_classes array<string>")


def scopes(s):
    return s.createDataFrame([("read", ["GET"], ["u0", "u1"], ["http"], ["PUBLIC", "INTERNAL"], ["title", "body"], ["body.raw", "meta.key"])], "capability string, operation_types array<string>, actor_ids array<string>, source_roots array<string>, allowed_sensitivities array<string>, allow_fields array<string>, redact_paths array<string>")


def refs(s, d):
    k = F.col("page_id")
    ref = F.when(k % 13 == 0, F.concat("url", F.lit("/%252e%252e/x"))).when(k % 17 == 0, F.concat(F.lit("ftp:"), "url")).otherwise(F.col("url"))
    return table(s, d, "pages").select(k.cast("string").alias("request_id"), ref.alias("source_ref"), k)


def policy_requests(s, d):
    k = F.col("page_id")
    r = refs(s, d)
    pick = lambda n, name, good: F.when(k % n == 1, "x").otherwise(good).alias(name)
    fields = F.when(k % 10 == 9, F.array(F.lit("meta"))).when(k % 10 == 8, F.array().cast("array<string>")).otherwise(F.array(F.lit("body"), F.lit("title")))
    return r.select("request_id", "source_ref", pick(11, "request_version", "1"), F.when(k % 12 != 2, F.when(k % 12 == 3, "b9").otherwise(F.concat(F.lit("b"), k % 3))).alias("binding_id"), F.concat(F.lit("u"), F.when(k % 19 == 4, 7).otherwise(k % 3)).alias("claimed_actor_id"), pick(23, "endpoint_id", "e1"), pick(29, "protocol_version", "p1"), F.lit("a1").alias("adapter_version"), pick(31, "registry_version", "r1"), pick(37, "capability", "read"), F.when(k % 41 == 5, "PUT").otherwise("GET").alias("operation_type"), fields.alias("requested_fields"))


def decide(s, d):
    return P.decide(policy_requests(s, d), s.createDataFrame([("b0", "u0"), ("b1", "u1"), ("b2", "u2")], "binding_id string, actor_id string"), scopes(s), labels(s), PINS)


_REFS = """refs AS (SELECT page_id AS k, CASE WHEN page_id % 13 = 0 THEN url || '/%252e%252e/x' WHEN page_id % 17 = 0 THEN 'ftp:' || url ELSE url END AS ref, page_id % 13 <> 0 AS safe FROM pages),
lab AS (SELECT *, CASE WHEN NOT safe THEN NULL WHEN starts_with(ref, 'https://m.') THEN 'SECRET' WHEN starts_with(ref, 'https://') THEN 'PUBLIC' WHEN starts_with(ref, 'http://') THEN 'INTERNAL' END AS sens FROM refs)"""


def disclosed(s, d):
    out = P.disclosure(policy_requests(s, d), scopes(s))
    return out.select("request_id", "allowed", F.array_join("redacted", ",").alias("redacted"))


def quality(s, d):
    from tallystone.operators import claims as C

    checked = C.verify_evidence(evidence(s, d), sources(s, d))
    members = CQ._conflicts(s, d).select(F.explode("members").alias("claim_id")).join(table(s, d, "orders").where("o_orderkey % 6 <> 0").select(F.concat(F.lit("claim_"), "o_orderkey").alias("claim_id"), F.lit(True).alias("present")), "claim_id", "left")
    e = table(s, d, "events")
    views = e.select(F.when(F.col("event_id") % 9 == 0, "STALE").otherwise("READY").alias("status"))
    records = e.select(F.when(F.col("event_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("r"))).alias("revision_ids"))
    drafts = e.select(F.col("user_id").alias("batch_key"), F.col("event_type").alias("digest"), F.lit("x").alias("draft_kind"))
    return M.memory_quality(checked, members, views, records, drafts).select(*[F.round(c, 6).alias(c) for c in ("evidence_validity", "conflict_member_recall", "stale_view_rate", "provenance_completeness")], "duplicate_drafts")


def runs(s, d):
    k = F.col("doc_id")
    doc = table(s, d, "documents").select(k.alias("case_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("run"), "text", k)
    got = doc.select("case_id", "run", F.md5(F.concat_ws("|", F.col("text"), F.when(k % 5 == 0, F.col("run")))).alias("hash"), F.array((k % 7).cast("string"), F.lit("a")).alias("ids"), F.octet_length("text").alias("bytes"))
    want = table(s, d, "documents").select(k.alias("case_id"), F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array((k % 7).cast("string"))).alias("ids"))
    out = M.routing_metrics(got, want)
    return out.select("case_id", "parity", F.round("recall", 6).alias("recall"), F.round("irrelevant_rate", 6).alias("irrelevant_rate"), "bytes")


def polluted(s, d):
    k = F.col("doc_id")
    m = table(s, d, "documents").select(F.col("source").alias("scope"), k.alias("position"), k.alias("memory_id"), F.concat(F.lit("k"), k % 37).alias("semantic_key"), F.col("lang").alias("value"), F.when(k % 4 == 0, "STALE").otherwise("CURRENT").alias("lifecycle"), (k % 6 != 0).alias("relevant"), (k % 10 / 10).alias("confidence"))
    truth = table(s, d, "documents").select(F.col("source").alias("scope"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.concat(F.lit("k"), i.cast("string")))).alias("semantic_key")).distinct().withColumn("value", F.lit("en"))
    out = M.pollution(m, truth)
    return out.select("scope", "total", *[F.round(c, 6).alias(c) for c in ("duplicate", "irrelevant", "stale", "wrong", "confidently_wrong")])


def _cases(s, d):
    k = F.col("doc_id")
    doc = table(s, d, "documents")
    ids = lambda p, a, b: F.array(F.concat(F.lit(p), k % a), F.concat(F.lit(p), k % b))
    seen = doc.select(k.alias("case_id"), F.col("lang").alias("purpose"), ids("d", 3, 5).alias("decision_ids"), ids("q", 2, 7).alias("question_ids"), ids("c", 4, 6).alias("conflict_ids"), F.concat(F.lit("w"), k % 2).alias("work_item_id"), ids("s", 3, 4).alias("source_ids"), F.create_map(F.lit("m1"), F.col("lang"), F.lit("m2"), F.lit("x")).alias("memory"), ids("d", 5, 9).alias("included_ids"))
    want = doc.select(k.alias("case_id"), F.lit("en").alias("purpose"), ids("d", 5, 2).alias("decision_ids"), ids("q", 7, 7).alias("question_ids"), ids("c", 4, 2).alias("conflict_ids"), F.lit("w1").alias("work_item_id"), ids("s", 4, 8).alias("source_ids"), F.create_map(F.lit("m1"), F.lit("en"), F.lit("m3"), F.lit("y")).alias("truth"), ids("d", 3, 4).alias("critical_ids"), ids("d", 5, 7).alias("relevant_ids"), F.lit(0.6).alias("min_accuracy"))
    return seen, want


def relearning(s, d):
    out = M.zero_relearning(*_cases(s, d))
    num = [c for c in out.columns if c not in ("case_id", "failures")]
    return out.select("case_id", *[F.round(c, 6).alias(c) for c in num], F.array_join("failures", ",").alias("failures"))


def ctx_quality(s, d):
    out = M.context_quality(*_cases(s, d))
    return out.select("case_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "case_id"])


def _rec(a, b, p):
    return f"len(list_intersect(list_distinct({b}), {a}))::DOUBLE / len(list_distinct({b}))"


_IDS = lambda p, a, b: f"['{p}' || (k % {a}), '{p}' || (k % {b})]"
_RELEARN = f"""base AS (SELECT doc_id AS k, lang, {_rec(_IDS('d', 3, 5), _IDS('d', 5, 2), 'd')} AS dr, {_rec(_IDS('q', 2, 7), _IDS('q', 7, 7), 'q')} AS qr, {_rec(_IDS('c', 4, 6), _IDS('c', 4, 2), 'c')} AS cr, {_rec(_IDS('s', 3, 4), _IDS('s', 4, 8), 's')} AS er,
  len(list_filter(list_distinct({_IDS('d', 3, 4)}), lambda x: NOT list_contains({_IDS('d', 3, 5)}, x))) AS miss, len(list_distinct({_IDS('d', 3, 4)})) AS crit, len(list_filter(list_distinct({_IDS('d', 5, 9)}), lambda x: NOT list_contains({_IDS('d', 5, 7)}, x)))::DOUBLE / len(list_distinct({_IDS('d', 5, 9)})) AS irr,
  {_rec(_IDS('d', 5, 9), _IDS('d', 5, 7), 'd')} AS rel FROM (SELECT doc_id, doc_id AS k, lang FROM documents)),
rl AS (SELECT *, ((lang = 'en')::INTEGER + (k % 2 = 1)::INTEGER + dr + qr + cr + er + CASE WHEN lang = 'en' THEN 0.5 ELSE 0 END) / 7 AS acc, (CASE WHEN lang = 'en' THEN 0.5 ELSE 1.0 END)::DOUBLE AS wr, (miss + 1)::DOUBLE / (crit + 2) AS mr FROM base)"""


def paired(s, d):
    k = F.col("doc_id")
    doc = table(s, d, "documents")
    a = doc.select(k.alias("pair_id"), F.lit("baseline").alias("arm"), (k % 5).alias("quality"), (F.octet_length("text") + 10).cast("double").alias("bytes"), (k % 3).cast("double").alias("seconds"))
    b = doc.select(k, F.lit("candidate"), (k % 4), (F.octet_length("text") / 2).cast("double"), (k % 7 / 10).cast("double"))
    out = M.paired_reduction(a.union(b), {"bytes": 0.5, "seconds": 0.4})
    return out.select("pair_id", F.round("bytes", 6).alias("bytes"), F.round("seconds", 6).alias("seconds"), "quality_preserved", "passed")


def cold(s, d):
    k = F.col("doc_id")
    h = table(s, d, "documents").select(k.alias("handoff_id"), F.col("text").alias("manual"), F.element_at(F.split("text", "\n", -1), -1).alias("context"), F.array(F.lit("a"), (k % 3).cast("string")).alias("included_ids"), F.array(F.lit("1"), F.lit("a")).alias("expected_ids"))
    return M.cold_start(h).select("handoff_id", F.round("byte_reduction", 6).alias("byte_reduction"), "recall")


def scores(s, d):
    k = F.col("event_id")
    e = table(s, d, "events").select(k.alias("response_id"), *[(k % n != 0).alias(c) for n, c in zip((2, 3, 5, 7, 11, 13), M.WEIGHTS, strict=True)], F.when(k % 17 == 0, F.array(F.lit("HALLUCINATED_ID"), F.lit("EVIDENCE_MISSING"))).when(k % 19 == 0, F.array(F.lit("CONFLICT_SETTLED"))).otherwise(F.array().cast("array<string>")).alias("penalty_codes"))
    return M.continuity_score(e)


def hallucinated(s, d):
    k = F.col("event_id")
    used = table(s, d, "events").select(k.alias("response_id"), F.col("user_id").alias("scenario_id"), F.concat(F.lit("o"), k % 50).alias("object_id"), (k % 2 == 0).alias("settled"))
    ctx = used.select("scenario_id").distinct().select("scenario_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.lit("o"), i.cast("string")))).alias("object_id"))
    return M.hallucinated_ids(used, ctx, ctx.where(F.col("object_id").endswith("7")))


def member_recall(s, d):
    e = table(s, d, "events")
    pairs = e.select(F.col("user_id").alias("scenario_id"), F.concat(F.lit("c"), F.col("event_id") % 3).alias("conflict_id"), F.concat(F.lit("m"), F.col("event_id") % 11).alias("claim_id"))
    return M.conflict_member_recall(pairs, pairs.where("claim_id in ('m1', 'm2', 'm5')"))


def live(s, d):
    o = table(s, d, "orders")
    arms = o.select(F.col("o_custkey").alias("scenario_id"), F.when(F.col("o_orderkey") % 2 == 0, "baseline").otherwise("candidate").alias("arm"), "o_totalprice").groupBy("scenario_id", "arm").agg(F.count("*").cast("double").alias("bytes"), F.max("o_totalprice").alias("tokens"))
    out = M.live_comparison(arms, ["bytes", "tokens"])
    return out.select("scenario_id", F.round("bytes", 6).alias("bytes"), F.round("tokens", 6).alias("tokens"), "meets_target")


def rules(s, d):
    k = F.col("p_partkey")
    p = table(s, d, "part")
    outputs = p.select(k.alias("skill_id"), F.when(k % 9 == 0, " ").otherwise(F.col("p_name")).alias("output"))
    r = p.where("p_partkey % 4 <> 0").select(k.alias("skill_id"), F.lit("NON_EMPTY").alias("type"), F.lit(None).cast("string").alias("value")).union(p.where("p_partkey % 2 = 0").select(k, F.lit("CONTAINS"), F.lit("ring"))).union(p.where("p_partkey % 10 = 1").select(k, F.lit("EQUALS"), F.lit("red widget")))
    return M.skill_rule_check(outputs, r)


def trace_events(s, d):
    """Events of a user and day; some sequences are broken, some ids repeat."""
    e = LQ.steps(s, d).join(table(s, d, "events").select("event_id", "ts"), "event_id")
    k = F.col("event_id")
    return e.select(F.col("object_id").alias("trace_id"), F.col("object_id").alias("session_id"), F.when(k % 301 == 0, F.col("seq") + 100).otherwise(F.col("seq")).alias("sequence"), F.concat(F.lit("e"), F.when(k % 401 == 0, 0).otherwise(k)).alias("event_id"), F.when(k % 503 == 0, F.expr("timestamp'2023-01-01'")).otherwise(F.col("ts")).alias("occurred_at"), "event_type", k.alias("arrival"))


_TRACE = f"""{LQ.STEPS}, tr AS (SELECT object_id AS trace_id, CASE WHEN s.event_id % 301 = 0 THEN seq + 100 ELSE seq END AS sequence, 'e' || CASE WHEN s.event_id % 401 = 0 THEN 0 ELSE s.event_id END AS event_id, CASE WHEN s.event_id % 503 = 0 THEN TIMESTAMP '2023-01-01' ELSE ts END AS happened, s.event_type, s.event_id AS arrival FROM steps s JOIN events e ON s.event_id = e.event_id)"""


def hooks(s, d):
    k = F.col("event_id")
    payload = F.to_json(F.struct(F.when(k % 7 != 0, "2024-01-01T00:00:00Z").alias("timestamp"), F.when(k % 3 == 0, F.concat(F.lit("given_"), k)).alias("event_id"), F.when(k % 5 == 0, "sum").alias("summary"), F.col("event_type").alias("tool_name")))
    p = table(s, d, "events").select(F.concat(F.lit("s"), "user_id").alias("session_id"), k.alias("arrival"), payload.alias("payload"))
    return T.normalize_events(p).select("session_id", "event_id", "sequence", "summary", "code")


def raw_sessions(s, d):
    k = F.col("event_id")
    return T.session_ids(table(s, d, "events").select(k, F.when(k % 2 == 0, F.concat(F.lit("s"), "user_id")).otherwise(F.concat(F.lit("bad id "), "user_id")).alias("raw_session")))


def captured(s, d):
    t = T.finalize_traces(trace_events(s, d))
    n = F.substring("trace_id", 6, 20).cast("int")
    return T.capture_idempotency(t, t.where(n % 3 != 0).withColumn("content_hash", F.when(n % 5 == 0, "sha256:x").otherwise(F.col("content_hash"))))


def details(s, d):
    u = table(s, d, "events").select(F.col("event_id").alias("trace_id"), F.to_json(F.array(F.struct("event_type"), F.struct(F.lit("test").alias("event_type")))).alias("content"))
    receipts = u.select("trace_id", F.when(F.col("trace_id") % 100 == 0, "sha256:x").otherwise(digest(F.col("content"))).alias("content_hash"))
    return T.trace_detail(receipts, u.where("trace_id % 150 <> 0"))


def letters(s, d):
    """Props of events as payloads: one in ten has lost its last character, one has no session, the others have one."""
    k = F.col("event_id") % 10
    payload = F.when(k == 0, F.expr("substring(props, 1, length(props) - 1)")).when(k == 1, F.col("props")).otherwise(F.concat(F.lit('{"session_id":"a",'), F.expr("substring(props, 2)")))
    return T.dead_letters(table(s, d, "events").select(payload.alias("payload")))


QUERIES = {
    "p01_decide": decide,
    "p02_label_sources": lambda s, d: P.label_sources(refs(s, d), labels(s)).select("request_id", "source_root", "sensitivity"),
    "p03_safe_ref": lambda s, d: refs(s, d).select("request_id", P.safe_ref(F.col("source_ref")).alias("safe")),
    "p04_disclosure": disclosed,
    "m01_memory_quality": quality,
    "m02_routing_metrics": runs,
    "m03_pollution": polluted,
    "m04_zero_relearning": relearning,
    "m05_context_quality": ctx_quality,
    "m06_paired_reduction": paired,
    "m07_cold_start": cold,
    "m08_continuity_score": scores,
    "m09_hallucinated_ids": hallucinated,
    "m10_conflict_member_recall": member_recall,
    "m11_live_comparison": live,
    "m12_latency_summary": lambda s, d: M.latency_summary(table(s, d, "events").select(F.col("event_type").alias("series"), "value")),
    "m13_skill_rule_check": rules,
    "t01_normalize_events": hooks,
    "t02_session_ids": raw_sessions,
    "t03_ordered_append": lambda s, d: T.ordered_append_batch(trace_events(s, d).withColumn("event_id", F.col("arrival"))).select("session_id", "event_id", "accepted"),
    "t04_trace_check": lambda s, d: T.trace_check(trace_events(s, d)),
    "t05_finalize_traces": lambda s, d: T.finalize_traces(trace_events(s, d)).select("trace_id", "events", F.array_join("types", ",").alias("types"), F.date_format("started_at", "yyyy-MM-dd").alias("started"), F.date_format("ended_at", "yyyy-MM-dd").alias("ended")),
    "t06_capture_idempotency": captured,
    "t07_prune": lambda s, d: T.prune(T.finalize_traces(trace_events(s, d)), "2024-01-30")[1],
    "t08_cursor_page": lambda s, d: T.cursor_page(table(s, d, "events").select(F.col("event_id").alias("seq"), "event_type"), 500, 100),
    "t09_trace_detail": details,
    "t10_dead_letters": letters,
}

_ROUND = lambda x, n: f"round({x}, 6) AS {n}"
ORACLE_SQL = {
    "m01_memory_quality": f"""WITH {D.CLAIMS}, {D.FAMILIES}, {D.PAIRS}, {D.CONFLICTS}, {D.EVIDENCE}, v AS (SELECT avg(({CQ._CODE} = 'OK')::INTEGER) AS x FROM evidence), m AS (SELECT avg((member IN (SELECT 'claim_' || o_orderkey FROM orders WHERE o_orderkey % 6 <> 0))::INTEGER) AS x FROM (SELECT unnest(members) AS member FROM conflicts)),
        t AS (SELECT count(*) - 1 AS n FROM events GROUP BY user_id, event_type) SELECT round(coalesce((SELECT x FROM v), 1), 6) AS evidence_validity, round(coalesce((SELECT x FROM m), 1), 6) AS conflict_member_recall, round(avg((event_id % 9 = 0)::INTEGER), 6) AS stale_view_rate, round(avg((event_id % 4 <> 0)::INTEGER), 6) AS provenance_completeness, (SELECT sum(n) FROM t)::BIGINT AS duplicate_drafts FROM events""",
    "t01_normalize_events": """WITH x AS (SELECT *, event_id % 7 <> 0 AS timed, '{' || concat_ws(',', CASE WHEN event_id % 7 <> 0 THEN '"timestamp":"2024-01-01T00:00:00Z"' END, CASE WHEN event_id % 3 = 0 THEN '"event_id":"given_' || event_id || '"' END, CASE WHEN event_id % 5 = 0 THEN '"summary":"sum"' END, '"tool_name":"' || event_type || '"') || '}' AS payload FROM events)
        SELECT 's' || user_id AS session_id, CASE WHEN event_id % 3 = 0 THEN 'given_' || event_id ELSE 'trace_event_' || substr(sha256(payload), 1, 24) END AS event_id, CASE WHEN timed THEN count(*) FILTER (WHERE timed) OVER (PARTITION BY user_id ORDER BY events_id ROWS UNBOUNDED PRECEDING) END AS sequence, CASE WHEN event_id % 5 = 0 THEN 'sum' ELSE 'PostToolUse ' || event_type END AS summary, CASE WHEN NOT timed THEN 'HOOK_TIMESTAMP_MISSING' END AS code FROM (SELECT *, event_id AS events_id FROM x)""",
    "p01_decide": f"""WITH {_REFS}, r AS (SELECT k, CASE WHEN k % 11 = 1 THEN 'REMOTE_REQUEST_VERSION_MISMATCH' WHEN k % 12 = 2 THEN 'MISSING_TRUST_BINDING' WHEN k % 12 = 3 THEN 'TRUST_BINDING_NOT_ALLOWED' WHEN k % 19 = 4 THEN 'ACTOR_BINDING_MISMATCH' WHEN k % 23 = 1 THEN 'ENDPOINT_PIN_MISMATCH' WHEN k % 29 = 1 THEN 'REMOTE_VERSION_PIN_MISMATCH'
        WHEN k % 31 = 1 THEN 'REGISTRY_VERSION_MISMATCH' WHEN k % 37 = 1 THEN 'UNKNOWN_CAPABILITY' WHEN k % 41 = 5 THEN 'OPERATION_SCOPE_DENIED' WHEN k % 3 = 2 THEN 'ACTOR_BINDING_MISMATCH' WHEN sens IS NULL THEN 'SOURCE_SCOPE_DENIED' WHEN sens = 'SECRET' THEN 'SENSITIVITY_DENIED' WHEN k % 10 >= 8 THEN 'DISCLOSURE_FIELD_DENIED' END AS reason FROM lab)
        SELECT k::VARCHAR AS request_id, CASE WHEN reason IS NULL THEN 'ALLOW' ELSE 'DENY' END AS decision, reason FROM r""",
    "p02_label_sources": f"WITH {_REFS} SELECT k::VARCHAR AS request_id, CASE sens WHEN 'SECRET' THEN 'https://m.' WHEN 'PUBLIC' THEN 'https://' WHEN 'INTERNAL' THEN 'http://' END AS source_root, sens AS sensitivity FROM lab",
    "p03_safe_ref": "SELECT page_id::VARCHAR AS request_id, page_id % 13 <> 0 AS safe FROM pages",
    "p04_disclosure": "SELECT page_id::VARCHAR AS request_id, page_id % 37 <> 1 AND page_id % 10 < 8 AS allowed, CASE WHEN page_id % 37 = 1 OR page_id % 10 = 8 THEN '' WHEN page_id % 10 = 9 THEN 'meta.key' ELSE 'body.raw' END AS redacted FROM pages",
    "m02_routing_metrics": """SELECT doc_id AS case_id, doc_id % 5 <> 0 AS parity, (CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS recall, 0.5::DOUBLE AS irrelevant_rate, strlen(text)::INTEGER AS bytes FROM documents""",
    "m03_pollution": f"""WITH m AS (SELECT *, doc_id > min(doc_id) OVER (PARTITION BY source, doc_id % 37) AS dup, doc_id % 37 < 30 AND lang <> 'en' AS wrong FROM documents) SELECT source AS scope, count(*) AS total, {_ROUND('avg(dup::INTEGER)', 'duplicate')}, {_ROUND('avg((doc_id % 6 = 0)::INTEGER)', 'irrelevant')}, {_ROUND('avg((doc_id % 4 = 0)::INTEGER)', 'stale')}, {_ROUND('avg(wrong::INTEGER)', 'wrong')}, {_ROUND('avg((wrong AND doc_id % 10 >= 8)::INTEGER)', 'confidently_wrong')} FROM m GROUP BY source""",
    "m04_zero_relearning": f"""WITH {_RELEARN} SELECT k AS case_id, {_ROUND('acc', 'continuity_accuracy')}, {_ROUND('dr', 'decision_recall')}, {_ROUND('qr', 'question_recall')}, {_ROUND('cr', 'conflict_recall')}, {_ROUND('er', 'evidence_traceability')}, {_ROUND('wr', 'wrong_rate')}, {_ROUND('mr', 'missing_rate')}, {_ROUND('irr', 'irrelevant_rate')},
        concat_ws(',', CASE WHEN acc < 0.6 THEN 'CONTINUITY_ACCURACY' END, 'WRONG_MEMORY', 'MISSING_CRITICAL_MEMORY') AS failures FROM rl""",
    "m05_context_quality": f"WITH {_RELEARN} SELECT k AS case_id, {_ROUND('acc', 'continuity_accuracy')}, {_ROUND('er', 'evidence_traceability')}, {_ROUND('irr', 'irrelevant_rate')}, {_ROUND('rel', 'relevant_recall')} FROM rl",
    "m06_paired_reduction": """WITH x AS (SELECT doc_id AS k, 1 - (strlen(text) / 2) / (strlen(text) + 10) AS b, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 3 - doc_id % 7 / 10) / (doc_id % 3) END AS s, doc_id % 4 >= doc_id % 5 AS q FROM documents) SELECT k AS pair_id, round(b, 6) AS bytes, round(s, 6) AS seconds, q AS quality_preserved, q AND b >= 0.5 AND coalesce(s >= 0.4, false) AS passed FROM x""",
    "m07_cold_start": "SELECT doc_id AS handoff_id, round((strlen(text) - strlen(string_split(text, chr(10))[-1])) / strlen(text), 6) AS byte_reduction, (CASE WHEN doc_id % 3 = 1 THEN 1.0 ELSE 0.5 END)::DOUBLE AS recall FROM documents WHERE strlen(text) > 0",
    "m08_continuity_score": """WITH x AS (SELECT event_id AS k, (event_id % 2 <> 0)::INTEGER AS a, (event_id % 3 <> 0)::INTEGER AS b, (event_id % 5 <> 0)::INTEGER AS c, (event_id % 7 <> 0)::INTEGER AS d, (event_id % 11 <> 0)::INTEGER AS e, (event_id % 13 <> 0)::INTEGER AS f FROM events)
        SELECT k AS response_id, greatest(0, least(100, 10 * a + 20 * b + 20 * c + 25 * d + 10 * e + 15 * f - CASE WHEN k % 17 = 0 THEN 75 WHEN k % 19 = 0 THEN 25 ELSE 0 END))::INTEGER AS score, round((a + b + c + d + e + f) / 6, 12) AS fact_accuracy FROM x""",
    "m09_hallucinated_ids": "SELECT event_id AS response_id, 'o' || (event_id % 50) AS object_id, CASE WHEN event_id % 50 >= 40 THEN 'HALLUCINATED_ID' ELSE 'CONFLICT_SETTLED' END AS code FROM events WHERE event_id % 50 >= 40 OR (event_id % 2 = 0 AND event_id % 50 % 10 = 7)",
    "m10_conflict_member_recall": "WITH p AS (SELECT DISTINCT user_id, event_id % 3 AS c, event_id % 11 AS m FROM events) SELECT user_id AS scenario_id, round(avg((m IN (1, 2, 5))::INTEGER), 12) AS recall FROM p GROUP BY 1",
    "m11_live_comparison": """WITH a AS (SELECT o_custkey AS k, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS b0, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS c0, max(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) AS b1, max(o_totalprice) FILTER (WHERE o_orderkey % 2 = 1) AS c1 FROM orders GROUP BY 1),
        x AS (SELECT k, CASE WHEN b0 > 0 AND c0 > 0 THEN 1 - c0 / b0 END AS b, 1 - c1 / b1 AS t FROM a) SELECT k AS scenario_id, round(b, 6) AS bytes, round(t, 6) AS tokens, coalesce(b >= 0.5, false) AND coalesce(t >= 0.5, false) AS meets_target FROM x""",
    "m12_latency_summary": "SELECT event_type AS series, count(*) AS samples, min(value) AS min, median(value) AS median, max(value) AS max, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1",
    "m13_skill_rule_check": """WITH x AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE p_name END AS o FROM part) SELECT k AS skill_id, ((k % 4 <> 0)::INTEGER + (k % 2 = 0)::INTEGER + (k % 10 = 1)::INTEGER)::BIGINT AS rules,
        (k % 4 = 0 OR trim(o) <> '') AND (k % 2 = 1 OR contains(o, 'ring')) AND (k % 10 <> 1 OR o = 'red widget') AS passed FROM x""",
    "t02_session_ids": "WITH x AS (SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN 's' || user_id ELSE 'bad id ' || user_id END AS raw_session FROM events), y AS (SELECT event_id, raw_session, CASE WHEN event_id % 2 = 0 THEN raw_session ELSE 'session_' || substr(sha256(raw_session), 1, 32) END AS session_id FROM x) SELECT *, 'trace_' || substr(sha256(session_id), 1, 32) AS trace_id FROM y",
    "t03_ordered_append": f"WITH {LQ.STEPS}, b AS (SELECT user_id, min(seq) AS first_bad FROM steps WHERE event_id % 301 = 0 GROUP BY 1) SELECT object_id AS session_id, event_id, seq < coalesce(first_bad, 1099511627776) AS accepted FROM steps LEFT JOIN b USING (user_id)",
    "t04_trace_check": f"""WITH {_TRACE} SELECT trace_id, CASE WHEN min(sequence) <> 1 OR max(sequence) <> count(*) OR count(DISTINCT sequence) <> count(*) THEN 'SEQUENCE_NOT_CONTIGUOUS' WHEN count(DISTINCT event_id) <> count(*) THEN 'EVENT_ID_REPEATED' WHEN arg_min(happened, sequence) > arg_max(happened, sequence) THEN 'ENDS_BEFORE_START' END AS code FROM tr GROUP BY trace_id""",
    "t05_finalize_traces": f"WITH {_TRACE} SELECT trace_id, count(*) AS events, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, strftime(min(happened), '%Y-%m-%d') AS started, strftime(max(happened), '%Y-%m-%d') AS ended FROM tr GROUP BY trace_id",
    "t06_capture_idempotency": "SELECT DISTINCT 'user_' || user_id AS trace_id, CASE WHEN user_id % 3 = 0 THEN 'CAPTURED' WHEN user_id % 5 = 0 THEN 'TRACE_CONFLICT' ELSE 'UNCHANGED' END AS outcome FROM events",
    "t07_prune": f"WITH {_TRACE}, e AS (SELECT max(happened) < TIMESTAMP '2024-01-30' AS old FROM tr GROUP BY trace_id) SELECT count(*) AS scanned, count(*) FILTER (WHERE old) AS removed, count(*) FILTER (WHERE NOT old) AS retained FROM e",
    "t08_cursor_page": "SELECT event_id AS seq, event_type, (SELECT count(*) FROM events WHERE event_id > 500) > 100 AS has_more FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100",
    "t09_trace_detail": """WITH x AS (SELECT event_id AS trace_id, event_type, CASE WHEN event_id % 150 = 0 THEN 'TRACE_NOT_FOUND' WHEN event_id % 100 = 0 THEN 'TRACE_HASH_MISMATCH' END AS code FROM events)
        SELECT trace_id, CASE WHEN code IS NULL THEN p END::INTEGER AS position, CASE WHEN code IS NOT NULL THEN NULL WHEN p = 0 THEN event_type ELSE 'test' END AS event_type, code FROM x, (VALUES (0), (1)) AS v(p) WHERE p = 0 OR code IS NULL""",
    "t10_dead_letters": "SELECT DISTINCT 'letter_' || substr(sha256(p), 1, 24) AS letter_id, code FROM (SELECT CASE WHEN event_id % 10 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END AS p, CASE WHEN event_id % 10 = 0 THEN 'PAYLOAD_NOT_JSON' ELSE 'SESSION_MISSING' END AS code FROM events WHERE event_id % 10 < 2)",
}
