"""Queries S01-S13 and E01-E13. Files derive from documents, directive texts from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions.canon import digest
from tallystone.operators import extract as E
from tallystone.plans.derive import registry, table
from tallystone.sources import ingest as S


def files(s, d):
    """Documents as files; a tenth lies in a skipped folder, a fifth has an unknown suffix."""
    end = F.element_at(F.array(*map(F.lit, (".md", ".txt", ".PY", ".jsonl", ".exe"))), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat_ws("/", F.col("source"), F.when(F.col("doc_id") % 10 == 3, ".git").otherwise(F.col("lang")), F.concat(F.lit("Doc "), F.col("doc_id"), end))
    return table(s, d, "documents").select("doc_id", path.alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), F.col("source").alias("batch_key"))


FILES = """files AS (SELECT doc_id, source || '/' || CASE WHEN doc_id % 10 = 3 THEN '.git' ELSE lang END || '/Doc ' || doc_id || ['.md', '.txt', '.PY', '.jsonl', '.exe'][doc_id % 5 + 1] AS path, coalesce(text, '') AS content, source AS batch_key,
  CASE doc_id % 5 WHEN 2 THEN 'code' WHEN 3 THEN 'conversation' ELSE 'document' END AS kind FROM documents),
named AS (SELECT *, kind || ':' || rtrim(substr(trim(regexp_replace(lower(path), '[^a-z0-9._-]+', '-', 'g'), '-._'), 1, 100), '-._') || '-' || substr(sha256(path), 1, 12) AS source_id FROM files)"""


def sources(s, d):
    return S.with_revision_id(S.with_source_id(S.classify_sources(files(s, d))))


def items(s, d):
    return sources(s, d).select("source_id", "fingerprint", "batch_key", F.when(F.col("doc_id") % 10 == 7, "NOT_UTF8").alias("error_code"), "doc_id")


def imported(s, d):
    prior = items(s, d).where("doc_id % 3 = 0").select("source_id", F.when(F.col("doc_id") % 9 == 0, "sha256:old").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return S.incremental_import(items(s, d), prior)


def talks(s, d):
    """Conversations as JSON Lines with times in various fields."""
    c = table(s, d, "conversations")
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 1000 - F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.col("text").alias("content"), F.lit("x").alias("date"), at.alias("timestamp")))).when(F.col("turn") % 3 == 1, F.to_json(F.struct(F.array(F.struct("text"), F.struct(F.lit("tail").alias("text"))).alias("content"), at.alias("created_at")))).otherwise(F.lit("plain line"))
    return c.select("conv_id", "turn", line.alias("line"))


def talk_sources(s, d):
    return talks(s, d).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("content")).select(F.concat(F.lit("conversation:"), "conv_id").alias("source_id"), "content")


def directive_text(s, d):
    """One Markdown source per customer with a line for each order; every eleventh line is a fence."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kinds = [
        F.concat(F.lit("FACT: "), F.when(k % 9 == 0, "thing").otherwise("customer"), F.lit(":"), "o_custkey", F.lit(" | order.priority@1 | "), F.lower("o_orderpriority"), F.lit(" | "), "o_orderstatus", F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(" | "), day))),
        F.concat(F.lit("fact: customer:"), "o_custkey", F.when(k % 2 == 0, " | short").otherwise(" | order.supplier@1 | Supplier 7! | F")),
        F.concat(F.lit("DECISION: Choose "), k, F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" | take "), "o_orderpriority", F.lit(" | | a; b;")))),
        F.concat(F.lit("Question : Why "), k, F.when(k % 5 == 0, "").otherwise(" | because | it")),
        F.concat(F.lit("WORK: "), F.when(k % 3 == 0, "p1 | ").when(k % 3 == 1, "P9 | ").otherwise(""), F.lit("do "), k),
        F.concat(F.lit("SKILL: Ship "), k, F.when(k % 5 == 0, "").otherwise(" | now, later | pack; send | contains:ok; NON_EMPTY")),
    ]
    line = F.when(k % 11 == 0, "```").when(k % 13 == 0, F.concat(F.lit("  WORK: indented "), k))
    for i, text in enumerate(kinds):
        line = line.when(k % 6 == i, text)
    rows = table(s, d, "orders").select("o_custkey", "o_orderkey", line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n")
    t = rows.groupBy("o_custkey").agg(text.alias("content"))
    return t.select(F.concat(F.lit("revision_"), "o_custkey").alias("revision_id"), F.concat(F.lit("Orders of "), "o_custkey").alias("title"), F.lit("document").alias("kind"), F.lit("2024-01-01").cast("timestamp").alias("captured_at"), F.concat(F.lit("batch_"), F.col("o_custkey") % 7).alias("batch_key"), "content")


LINES = """raw AS (SELECT o_custkey AS c, o_orderkey AS k, CASE WHEN k % 11 = 0 THEN '```' WHEN k % 13 = 0 THEN '  WORK: indented ' || k
    WHEN k % 6 = 0 THEN 'FACT: ' || CASE WHEN k % 9 = 0 THEN 'thing' ELSE 'customer' END || ':' || c || ' | order.priority@1 | ' || lower(o_orderpriority) || ' | ' || o_orderstatus || CASE WHEN k % 4 = 0 THEN '' ELSE ' | ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END
    WHEN k % 6 = 1 THEN 'fact: customer:' || c || CASE WHEN k % 2 = 0 THEN ' | short' ELSE ' | order.supplier@1 | Supplier 7! | F' END
    WHEN k % 6 = 2 THEN 'DECISION: Choose ' || k || CASE WHEN k % 5 = 0 THEN '' ELSE ' | take ' || o_orderpriority || ' | | a; b;' END
    WHEN k % 6 = 3 THEN 'Question : Why ' || k || CASE WHEN k % 5 = 0 THEN '' ELSE ' | because | it' END
    WHEN k % 6 = 4 THEN 'WORK: ' || CASE k % 3 WHEN 0 THEN 'p1 | ' WHEN 1 THEN 'P9 | ' ELSE '' END || 'do ' || k
    ELSE 'SKILL: Ship ' || k || CASE WHEN k % 5 = 0 THEN '' ELSE ' | now, later | pack; send | contains:ok; NON_EMPTY' END END AS line, o_orderpriority, o_orderstatus, o_orderdate FROM orders),
spans AS (SELECT *, 'revision_' || c AS revision_id, (row_number() OVER (PARTITION BY c ORDER BY k) - 1)::INTEGER AS line_no, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY c ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte,
  count(*) FILTER (WHERE line = '```') OVER (PARTITION BY c ORDER BY k) AS fences FROM raw),
open_ AS (SELECT *, start_byte + strlen(line) AS end_byte FROM spans WHERE line <> '```' AND fences % 2 = 0 AND line NOT LIKE ' %'),
ds AS (SELECT *, upper(trim(split_part(line, ':', 1))) AS directive_kind, trim(substr(line, instr(line, ':') + 1)) AS payload FROM open_)"""


def open_lines(s, d):
    return E.mask_fences(E.line_spans(directive_text(s, d)).withColumn("markdown", F.lit(True)), ["revision_id"])


def directives(s, d):
    return E.directives(open_lines(s, d))


def facts(s, d):
    return E.fact_claims(directives(s, d), registry(s)).select("revision_id", "start_byte", "code", "subject_id", "predicate", "object_value", "object_type", "environment", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), "excerpt_hash")


def decisions(s, d):
    return E.decision_records(directives(s, d)).select("decision_id", "conclusion", "rationale", F.array_join("alternatives", ",").alias("alternatives"))


def skills(s, d):
    return E.skill_records(directives(s, d)).select("skill_id", "start_byte", F.array_join("triggers", ",").alias("triggers"), F.array_join("steps", ",").alias("steps"), F.array_join("rules", ",").alias("rules"))


def talk_directives(s, d):
    c = table(s, d, "conversations")
    text = F.concat(F.lit("```\nWORK: hidden\n```\nWORK: P1 | check "), "turn", F.lit("\nplain"))
    line = F.to_json(F.struct(F.when(F.col("turn") % 2 == 0, text).otherwise(F.concat(F.lit("say "), "turn")).alias("content"), "role"))
    src = c.select("conv_id", "turn", line.alias("line")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("content"))
    src = src.select(F.concat(F.lit("revision_"), "conv_id").alias("revision_id"), F.lit("conversation").alias("kind"), "content")
    return E.conversation_directives(src).select("revision_id", "line_no", "directive_kind", "payload")


def operations(s, d):
    f = E.fact_claims(directives(s, d), registry(s)).select("revision_id", "start_byte", "code")
    return directives(s, d).join(f, ["revision_id", "start_byte"], "left")


def capped(s, d):
    kept, notes = E.extraction_caps(directive_text(s, d), operations(s, d), max_chars=900, max_operations=5)
    return kept.select("revision_id", "start_byte", F.lit(None).cast("string").alias("note")).unionByName(notes.select("revision_id", F.lit(None).cast("long").alias("start_byte"), F.col("code").alias("note")))


def drafts(s, d):
    old = s.createDataFrame([], "batch_key string, digest string, draft_kind string")
    made = E.stage_drafts(directives(s, d), old)
    known = made.where("operations % 2 = 0").select("batch_key", "digest", "draft_kind")
    return E.stage_drafts(directives(s, d), known).select("batch_key", "revision_id", "draft_kind", "operations")


def updates(s, d):
    e = table(s, d, "events")
    status = F.create_map(*map(F.lit, ("signup", "DRAFT", "view", "REVIEWED", "error", "REJECTED", "purchase", "COMMITTED")))[F.col("event_type")]
    return e.select(F.concat(F.lit("draft_"), "user_id").alias("draft_id"), F.col("event_id").alias("seq"), status.alias("status"), F.when(F.col("event_type").isin("signup", "click"), F.concat(F.lit("doc "), "event_id")).alias("document"))


def exports(s, d):
    p = table(s, d, "pages")
    k = F.col("page_id")
    event = F.to_json(F.struct(k.cast("string").alias("event_id"), F.when(k % 9 == 0, "").otherwise("seen").alias("event_type"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.struct(F.col("url")).alias("payload")))
    pages = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.when(k % 5 == 0, "gone").otherwise("a").alias("reference"))).alias("citations"))).alias("pages"), F.array(F.struct(F.lit("a").alias("reference"))).alias("references")))
    context = F.to_json(F.struct(F.when(k % 4 == 0, "0").otherwise("1").alias("export_version"), F.struct(F.array(F.col("url")).alias("sources")).alias("context")))
    return S.validate_exports(p.select(F.concat(F.lit("x"), k).alias("export_id"), F.when(k % 3 == 0, "EVENT").when(k % 3 == 1, "PAGES").otherwise("CONTEXT").alias("shape"), F.when(k % 3 == 0, event).when(k % 3 == 1, pages).otherwise(context).alias("document")))


def snapshot(s, d):
    """S13 written and read again."""
    from tallystone.sources.scratch import new_path

    path = new_path(s, "snapshot")
    S.replace_snapshot(table(s, d, "orders").where("o_orderkey % 2 = 0"), path)
    S.replace_snapshot(table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("orders")), path)
    return s.read.parquet(path)


def violations(s, d):
    r = sources(s, d).select("revision_id", F.when(F.col("doc_id") % 17 == 0, "sha256:x").otherwise(F.col("fingerprint")).alias("fingerprint"), "content", "doc_id")
    twice = r.where("doc_id % 50 = 0").withColumn("content", F.encode(F.lit("other"), "UTF-8")).withColumn("fingerprint", digest(F.col("content")))
    return S.immutability_violations(r.unionByName(twice))


QUERIES = {
    "s01_scan_sources": lambda s, d: S.select_sources(files(s, d)).select("path"),
    "s02_admission_report": lambda s, d: S.admission_report(files(s, d), max_files=100, max_file_bytes=10_000, max_total_bytes=100_000),
    "s03_classify_sources": lambda s, d: S.classify_sources(files(s, d)).select("doc_id", "kind", "media_type", "canonical_type"),
    "s04_source_id": lambda s, d: sources(s, d).select("doc_id", "source_id"),
    "s05_revision_id": lambda s, d: sources(s, d).select("doc_id", "fingerprint", "revision_id"),
    "s06_captured_at": lambda s, d: S.captured_at(talk_sources(s, d)),
    "s07_manifest": lambda s, d: S.manifest(sources(s, d)),
    "s08_incremental_import": lambda s, d: imported(s, d).select("doc_id", "import_status"),
    "s09_batch_status": lambda s, d: S.batch_status(imported(s, d)),
    "s10_immutability_violations": violations,
    "s11_messages": lambda s, d: S.messages(talks(s, d)).select("conv_id", "turn", "message_no", "message"),
    "s12_validate_exports": exports,
    "s13_replace_snapshot": snapshot,
    "e01_line_spans": lambda s, d: E.line_spans(directive_text(s, d)).select("revision_id", "line_no", "start_byte", "end_byte"),
    "e02_mask_fences": lambda s, d: open_lines(s, d).select("revision_id", "line_no"),
    "e03_directives": lambda s, d: directives(s, d).select("revision_id", "start_byte", "directive_kind", "payload"),
    "e04_conversation_directives": talk_directives,
    "e05_fact_claims": facts,
    "e06_decision_records": decisions,
    "e07_question_records": lambda s, d: E.question_records(directives(s, d)).select("revision_id", "start_byte", "question", "context"),
    "e08_work_records": lambda s, d: E.work_records(directives(s, d)).select("revision_id", "start_byte", "priority", "description"),
    "e09_skill_records": skills,
    "e10_extraction_caps": capped,
    "e11_stage_drafts": drafts,
    "e12_expire_drafts": lambda s, d: E.expire_drafts(table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "REVIEWED").otherwise("DRAFT").alias("status"), F.col("ts").alias("expires_at")), "2024-01-15").select("event_id", "status"),
    "e13_draft_state": lambda s, d: E.draft_state(updates(s, d)),
}

_D = f"WITH {LINES}"
_FACT = "(SELECT *, list_transform(string_split(payload, '|'), lambda x: trim(x)) AS f FROM ds WHERE directive_kind = 'FACT')"
_CODE = "CASE WHEN len(f) < 4 THEN 'FACT_DIRECTIVE_INVALID' WHEN NOT starts_with(f[1], 'customer:') THEN 'SUBJECT_TYPE_NOT_ALLOWED' END"

ORACLE_SQL = {
    "s01_scan_sources": f"WITH {FILES} SELECT path FROM files WHERE doc_id % 10 <> 3 AND doc_id % 5 <> 4",
    "s02_admission_report": f"WITH {FILES} SELECT 'FILE_TOO_LARGE' AS code, path FROM files WHERE strlen(content) > 10000 UNION ALL SELECT 'TOO_MANY_FILES', NULL FROM files HAVING count(*) > 100 UNION ALL SELECT 'BATCH_TOO_LARGE', NULL FROM files HAVING sum(strlen(content)) > 100000",
    "s03_classify_sources": f"WITH {FILES} SELECT doc_id, kind, CASE doc_id % 5 WHEN 0 THEN 'text/markdown' WHEN 2 THEN 'text/x-python' WHEN 3 THEN 'application/x-ndjson' ELSE 'text/plain' END AS media_type, CASE doc_id % 5 WHEN 0 THEN 'text/markdown' WHEN 3 THEN 'application/x-ndjson' ELSE 'text/plain' END AS canonical_type FROM files",
    "s04_source_id": f"WITH {FILES} SELECT doc_id, source_id FROM named",
    "s05_revision_id": f"WITH {FILES} SELECT doc_id, 'sha256:' || sha256(content) AS fingerprint, 'revision_' || substr(sha256(encode(source_id) || '\\x00'::BLOB || encode(content)), 1, 32) AS revision_id FROM named",
    "s06_captured_at": "SELECT 'conversation:' || conv_id AS source_id, strftime(min(TIMESTAMP '2024-01-01' + to_seconds(conv_id * 1000 - turn * 60)) FILTER (WHERE turn % 3 < 2), '%Y-%m-%dT%H:%M:%SZ') AS captured_at FROM conversations GROUP BY conv_id",
    "s07_manifest": f"""WITH {FILES}, r AS (SELECT DISTINCT batch_key, sha256(source_id || '|sha256:' || sha256(content)) AS h FROM named), g4 AS (SELECT batch_key, substr(sha256(h), 1, 4) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM r GROUP BY ALL), g2 AS (SELECT batch_key, substr(b, 1, 2) AS b, sha256(string_agg(h, '' ORDER BY b)) AS h FROM g4 GROUP BY batch_key, substr(b, 1, 2))
        SELECT 'batch_' || substr(sha256(string_agg(h, '' ORDER BY b)), 1, 32) AS batch_id, batch_key FROM g2 GROUP BY batch_key""",
    "s08_incremental_import": "SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN 'FAILED' WHEN doc_id % 3 = 0 AND doc_id % 9 <> 0 THEN 'UNCHANGED' ELSE 'IMPORTED' END AS import_status FROM documents",
    "s09_batch_status": """WITH i AS (SELECT source AS batch_key, CASE WHEN doc_id % 10 = 7 THEN 'F' WHEN doc_id % 3 = 0 AND doc_id % 9 <> 0 THEN 'U' ELSE 'I' END AS x FROM documents), n AS (SELECT batch_key, count(*) FILTER (WHERE x = 'I') AS imported, count(*) FILTER (WHERE x = 'U') AS unchanged, count(*) FILTER (WHERE x = 'F') AS failed FROM i GROUP BY 1)
        SELECT *, CASE WHEN failed = 0 THEN 'COMPLETED' WHEN imported + unchanged = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS status FROM n""",
    "s10_immutability_violations": f"""WITH {FILES}, r AS (SELECT doc_id, 'revision_' || substr(sha256(encode(source_id) || '\\x00'::BLOB || encode(content)), 1, 32) AS revision_id FROM named)
        SELECT revision_id, 'CONTENT_HASH_MISMATCH' AS code FROM r WHERE doc_id % 17 = 0 UNION ALL SELECT revision_id, 'REVISION_REDEFINED' FROM r WHERE doc_id % 50 = 0""",
    "s11_messages": "SELECT conv_id, turn, m::INTEGER AS message_no, CASE WHEN turn % 3 = 2 THEN 'plain line' WHEN m = 1 THEN 'tail' ELSE text END AS message FROM conversations, (VALUES (0), (1)) AS v(m) WHERE m = 0 OR turn % 3 = 1",
    "s12_validate_exports": "SELECT 'x' || page_id AS export_id, CASE page_id % 3 WHEN 0 THEN 'EVENT_INVALID' WHEN 1 THEN 'CITATION_UNRESOLVED' ELSE 'VERSION_MISMATCH' END AS code FROM pages WHERE (page_id % 3 = 0 AND page_id % 9 = 0) OR (page_id % 3 = 1 AND page_id % 5 = 0) OR (page_id % 3 = 2 AND page_id % 4 = 0)",
    "s13_replace_snapshot": "SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY 1",
    "e01_line_spans": f"{_D} SELECT revision_id, line_no, start_byte, start_byte + strlen(line) AS end_byte FROM spans",
    "e02_mask_fences": f"{_D} SELECT revision_id, line_no FROM open_",
    "e03_directives": f"{_D} SELECT revision_id, start_byte, directive_kind, payload FROM ds",
    "e04_conversation_directives": "SELECT 'revision_' || conv_id AS revision_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS line_no, 'WORK' AS directive_kind, 'P1 | check ' || turn AS payload FROM conversations QUALIFY turn % 2 = 0",
    "e05_fact_claims": f"""{_D} SELECT revision_id, start_byte, {_CODE} AS code, f[1] AS subject_id, f[2] AS predicate, CASE WHEN f[2] = 'order.priority@1' THEN upper(f[3]) WHEN f[2] = 'order.supplier@1' THEN 'supplier:supplier-7' ELSE f[3] END AS object_value,
        CASE WHEN f[2] = 'order.supplier@1' THEN 'supplier' END AS object_type, nullif(f[4], '') AS environment, CASE WHEN len(f) > 4 THEN substr(f[5], 1, 10) ELSE '2024-01-01' END AS valid_from, 'sha256:' || sha256(line) AS excerpt_hash FROM {_FACT}""",
    "e06_decision_records": f"""{_D} SELECT 'decision_extract_' || substr(sha256('{{"kind":"decision","payload":"' || payload || '","revision_id":"' || revision_id || '","start":' || start_byte || '}}'), 1, 24) AS decision_id, CASE WHEN k % 5 = 0 THEN payload ELSE 'take ' || o_orderpriority END AS conclusion,
        'Extracted from Orders of ' || c || '.' AS rationale, CASE WHEN k % 5 = 0 THEN '' ELSE 'a,b' END AS alternatives FROM ds WHERE directive_kind = 'DECISION'""",
    "e07_question_records": f"{_D} SELECT revision_id, start_byte, 'Why ' || k AS question, CASE WHEN k % 5 = 0 THEN 'Extracted from Orders of ' || c || '.' ELSE 'because | it' END AS context FROM ds WHERE directive_kind = 'QUESTION'",
    "e08_work_records": f"{_D} SELECT revision_id, start_byte, CASE WHEN k % 3 = 0 THEN 'P1' ELSE 'P2' END AS priority, CASE WHEN k % 3 = 1 THEN 'P9 | ' ELSE '' END || 'do ' || k AS description FROM ds WHERE directive_kind = 'WORK'",
    "e09_skill_records": f"{_D} SELECT 'skill:ship-' || k AS skill_id, start_byte, CASE WHEN k % 5 = 0 THEN payload ELSE 'now,later' END AS triggers, CASE WHEN k % 5 = 0 THEN payload ELSE 'pack,send' END AS steps, CASE WHEN k % 5 = 0 THEN 'NON_EMPTY' ELSE 'CONTAINS:ok,NON_EMPTY' END AS rules FROM ds WHERE directive_kind = 'SKILL'",
    "e10_extraction_caps": f"""{_D}, size AS (SELECT revision_id, sum(length(line) + 1) - 1 AS n FROM spans GROUP BY 1), o AS (SELECT ds.*, directive_kind <> 'SKILL' AND NOT (directive_kind = 'FACT' AND (k % 6 = 0 AND k % 9 = 0 OR k % 6 = 1 AND k % 2 = 0)) AS counts FROM ds JOIN size USING (revision_id) WHERE n <= 900),
        b AS (SELECT *, coalesce(sum(counts::INTEGER) OVER (PARTITION BY revision_id ORDER BY start_byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
        SELECT revision_id, start_byte, NULL AS note FROM b WHERE before < 5 UNION ALL SELECT DISTINCT revision_id, NULL, 'OPERATION_LIMIT_REACHED' FROM b WHERE before >= 5 UNION ALL SELECT revision_id, NULL, 'EXTRACTION_CHARS_EXCEEDED' FROM size WHERE n > 900""",
    "e11_stage_drafts": f"""{_D} SELECT 'batch_' || (c % 7) AS batch_key, revision_id, 'OPERATIONS' AS draft_kind, count(*) AS operations FROM ds WHERE directive_kind <> 'SKILL' GROUP BY c, revision_id HAVING count(*) % 2 = 1
        UNION ALL SELECT 'batch_' || (c % 7), revision_id, 'SKILL', 1 FROM ds WHERE directive_kind = 'SKILL'""",
    "e12_expire_drafts": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'REVIEWED' WHEN ts <= TIMESTAMP '2024-01-15' THEN 'EXPIRED' ELSE 'DRAFT' END AS status FROM events",
    "e13_draft_state": """SELECT 'draft_' || user_id AS draft_id, arg_max(CASE event_type WHEN 'signup' THEN 'DRAFT' WHEN 'view' THEN 'REVIEWED' WHEN 'error' THEN 'REJECTED' ELSE 'COMMITTED' END, event_id) FILTER (WHERE event_type <> 'click') AS status,
        count(*) FILTER (WHERE event_type IN ('signup', 'click')) AS version, 'doc ' || max(event_id) FILTER (WHERE event_type IN ('signup', 'click')) AS document FROM events GROUP BY user_id""",
}
