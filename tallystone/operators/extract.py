"""Extraction of typed candidates from text.

Lines keep exact byte ranges of their source; a directive is a line `KIND: payload`. Nothing is cut from a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.canon import canonical, digest, short_id, slug
from tallystone.sources.ingest import messages, parsed_time

# What opens or closes a fence, and what makes a directive.
FENCE = r"^ {0,3}(`{3,}|~{3,})(.*)$"
DIRECTIVE = r"(?i)^\s*(FACT|DECISION|QUESTION|WORK|SKILL)\s*:\s*(.+?)\s*$"


def line_spans(sources: DataFrame) -> DataFrame:
    """The source's columns but content, with line_no, line, start_byte, end_byte of every non-empty line.

    Lines end at \\n, \\r or \\r\\n; ends are not part of a line, but count for offsets, as do blank lines.
    """
    keep = [c for c in sources.columns if c != "content"]
    pieces = F.split(F.col("content").cast("string"), r"(?<=\n)|(?<=\r)(?!\n)")
    each = sources.select(*keep, F.posexplode(pieces).alias("line_no", "raw"))
    size = F.octet_length("raw").cast("long")
    w = Window.partitionBy("revision_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("start_byte", F.sum(size).over(w) - size).withColumn("line", F.rtrim("raw", F.lit("\r\n")))
    return each.withColumn("end_byte", F.col("start_byte") + F.octet_length("line")).where("line <> ''").drop("raw")


def mask_fences(lines: DataFrame, key: list[str], order: str = "line_no", text: str = "line") -> DataFrame:
    """Lines outside fenced blocks and without indentation, for Markdown; other lines pass. Needs a boolean column markdown.

    A fence closes at a bare run of its own character that is at least as long. Only the few fence lines of a source are folded.
    """
    marks = lines.where(F.col("markdown") & F.col(text).rlike(FENCE)).select(*key, F.col(order).alias("at"), F.regexp_extract(text, FENCE, 1).alias("run"), F.trim(F.regexp_extract(text, FENCE, 2)).alias("rest"))
    rows = F.array_sort(F.collect_list(F.struct("at", F.substring("run", 1, 1).alias("c"), F.length("run").alias("n"), (F.col("rest") == "").alias("bare"))))
    span = "array<struct<low:bigint,high:bigint>>"
    start = F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("low"), F.array().cast(span).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        opens, closes = acc["c"] == "", (acc["c"] == m["c"]) & (m["n"] >= acc["n"]) & m["bare"]
        done = F.concat(acc["out"], F.array(F.struct(acc["low"].alias("low"), m["at"].cast("long").alias("high"))))
        return F.struct(F.when(opens, m["c"]).when(closes, "").otherwise(acc["c"]).alias("c"), F.when(opens, m["n"]).otherwise(acc["n"]).alias("n"), F.when(opens, m["at"].cast("long")).otherwise(acc["low"]).alias("low"), F.when(~opens & closes, done).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.when(acc["c"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["low"].alias("low"), F.lit((1 << 62)).cast("long").alias("high")))))

    spans = marks.groupBy(*key).agg(rows.alias("rows")).select(*key, F.aggregate("rows", start, step, finish).alias("spans"))
    j = lines.join(spans, key, "left")
    inside = F.coalesce(F.exists("spans", lambda s: (F.col(order) >= s["low"]) & (F.col(order) <= s["high"])), F.lit(False))
    hidden = F.col("markdown") & (inside | F.col(text).rlike(r"^[ \t]") | F.col(text).rlike(FENCE))
    return j.where(~hidden).drop("spans")


def directives(lines: DataFrame, text: str = "line") -> DataFrame:
    """directive_kind (upper case) and payload of the lines that are directives; sources of kind code have none."""
    out = lines.withColumns({"directive_kind": F.upper(F.regexp_extract(text, DIRECTIVE, 1)), "payload": F.regexp_extract(text, DIRECTIVE, 2)})
    return out.where("kind <> 'code' and directive_kind <> ''")


def conversation_directives(sources: DataFrame) -> DataFrame:
    """The directives in the texts of JSON Lines messages; the span and excerpt are the whole JSON line's."""
    spans = messages(line_spans(sources))
    inner = spans.select("*", F.posexplode(F.split("message", r"\r\n|\r|\n")).alias("inner_no", "inner")).withColumn("markdown", F.lit(True))
    open_ = mask_fences(inner, ["revision_id", "line_no", "message_no"], "inner_no", "inner")
    return directives(open_, "inner").drop("markdown")


def _fields(payload: Column, limit: int = -1) -> Column:
    return F.transform(F.split(payload, r"\|", limit), lambda x: F.trim(x))


def _directive_id(prefix: str, kind: str) -> Column:
    seed = canonical(F.struct(F.lit(kind).alias("kind"), "payload", "revision_id", F.col("start_byte").alias("start")))
    return short_id(prefix, seed)


def fact_claims(directives: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per FACT: claim fields, evidence span and code (null if it is a claim).

    subject | predicate | object | environment [| valid_from]; an untyped entity object gets the predicate's first type, an enum is upper-cased,
    a time that is missing or invalid is the capture time where the predicate needs one.
    """
    d = directives.where("directive_kind = 'FACT'").withColumn("f", _fields(F.col("payload")))
    part = lambda i: F.get("f", F.lit(i))
    d = d.withColumns({"subject_id": part(0), "predicate": part(1), "raw_object": part(2), "environment": F.nullif(part(3), F.lit("")), "subject_type": F.substring_index(part(0), ":", 1)})
    j = d.join(registry.select(F.col("key").alias("predicate"), "subject_types", F.col("object_kind"), "object_types", "temporal"), "predicate", "left")
    code = F.when(F.size("f") < 4, "FACT_DIRECTIVE_INVALID").when(F.col("object_kind").isNull(), "UNKNOWN_PREDICATE").when(~F.array_contains("subject_types", F.col("subject_type")), "SUBJECT_TYPE_NOT_ALLOWED")
    typed = F.instr("raw_object", ":") > 0
    first = F.get("object_types", F.lit(0))
    value = F.when(F.col("object_kind") == "enum", F.upper("raw_object")).when((F.col("object_kind") == "entity") & ~typed, F.concat(first, F.lit(":"), F.substring(slug(F.col("raw_object")), 1, 120))).otherwise(F.col("raw_object"))
    kind = F.when(F.col("object_kind") == "entity", F.when(typed, F.substring_index("raw_object", ":", 1)).otherwise(first))
    given = F.when(F.size("f") > 4, parsed_time(part(4))).otherwise(F.col("captured_at"))
    start = F.when((F.col("temporal") == "REQUIRED") & given.isNull(), F.col("captured_at")).otherwise(given)
    j = j.withColumns({"code": code, "object_value": value, "object_type": kind, "valid_from": start})
    seed = canonical(F.struct("environment", "object_value", "predicate", "revision_id", F.col("start_byte").alias("start"), "subject_id"))
    return j.select("revision_id", "start_byte", "end_byte", "code", F.when(F.col("code").isNull(), short_id("claim_extract_", seed)).alias("claim_id"), "subject_id", "predicate", "object_kind", "object_value", "object_type", "environment", "valid_from", digest(F.col("line")).alias("excerpt_hash"))


def decision_records(directives: DataFrame) -> DataFrame:
    """Title | conclusion | rationale | alternative;alternative. A lone title is its own conclusion; the rationale defaults to the source."""
    d = directives.where("directive_kind = 'DECISION'").withColumn("f", _fields(F.col("payload")))
    part = lambda i: F.nullif(F.get("f", F.lit(i)), F.lit(""))
    alone = F.size("f") < 2
    alternatives = F.filter(F.transform(F.split(F.coalesce(F.get("f", F.lit(3)), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return d.select(_directive_id("decision_extract_", "decision").alias("decision_id"), "revision_id", "start_byte", F.get("f", F.lit(0)).alias("title"), F.when(alone, F.get("f", F.lit(0))).otherwise(F.get("f", F.lit(1))).alias("conclusion"), F.coalesce(part(2), F.concat(F.lit("Extracted from "), "title", F.lit("."))).alias("rationale"), alternatives.alias("alternatives"), F.lit("ACTIVE").alias("status"))


def question_records(directives: DataFrame) -> DataFrame:
    """Question | context; the context defaults to the source."""
    d = directives.where("directive_kind = 'QUESTION'").withColumn("f", _fields(F.col("payload"), 2))
    context = F.coalesce(F.nullif(F.get("f", F.lit(1)), F.lit("")), F.concat(F.lit("Extracted from "), "title", F.lit(".")))
    return d.select(_directive_id("question_extract_", "question").alias("question_id"), "revision_id", "start_byte", F.get("f", F.lit(0)).alias("question"), context.alias("context"), F.lit("OPEN").alias("status"))


def work_records(directives: DataFrame) -> DataFrame:
    """P0..P3 | description; without a valid priority it is P2 and the whole payload the description."""
    d = directives.where("directive_kind = 'WORK'").withColumn("f", _fields(F.col("payload"), 2))
    priority = F.upper(F.get("f", F.lit(0)))
    good = (F.size("f") > 1) & priority.isin("P0", "P1", "P2", "P3")
    return d.select(_directive_id("workitem_extract_", "work").alias("work_item_id"), "revision_id", "start_byte", F.when(good, priority).otherwise("P2").alias("priority"), F.when(good, F.get("f", F.lit(1))).otherwise(F.trim("payload")).alias("description"), F.lit("TODO").alias("status"))


def skill_records(directives: DataFrame) -> DataFrame:
    """Purpose | trigger, trigger | step; step | TYPE:value; ... Triggers and steps default to the purpose, rules to NON_EMPTY."""
    d = directives.where("directive_kind = 'SKILL'").withColumn("f", _fields(F.col("payload")))
    items = lambda i, sep: F.filter(F.transform(F.split(F.get("f", F.lit(i)), sep), lambda x: F.trim(x)), lambda x: x != "")
    own = F.array(F.get("f", F.lit(0)))
    rule = lambda x: F.concat(F.upper(F.trim(F.substring_index(x, ":", 1))), F.when(F.instr(x, ":") > 0, F.concat(F.lit(":"), F.trim(F.regexp_replace(x, "^[^:]*:", "")))).otherwise(""))
    rules = F.transform(F.coalesce(items(3, ";"), F.array().cast("array<string>")), rule)
    return d.select(
        F.concat(F.lit("skill:"), slug(F.get("f", F.lit(0)))).alias("skill_id"), "revision_id", "start_byte", F.get("f", F.lit(0)).alias("purpose"), F.when(F.size("f") > 1, items(1, ",")).otherwise(own).alias("triggers"),
        F.when(F.size("f") > 2, items(2, ";")).otherwise(own).alias("steps"), F.when(F.size(rules) > 0, rules).otherwise(F.array(F.lit("NON_EMPTY"))).alias("rules"), F.lit("DRAFT").alias("status"),
    )


def extraction_caps(sources: DataFrame, operations: DataFrame, max_chars: int = 2 << 20, max_tokens: int = 512 << 10, max_operations: int = 128) -> tuple[DataFrame, DataFrame]:
    """(kept operations, diagnostics (revision_id, code)). The caps are the feature: too long a source yields nothing, and after the
    128th counting operation of a source every further directive is dropped. Skills and invalid facts (code not null) don't count.
    """
    size = F.length(F.col("content").cast("string"))
    tokens = F.ceil(F.octet_length("content") / 4)
    large = sources.select("revision_id", F.when(size > max_chars, "EXTRACTION_CHARS_EXCEEDED").when(tokens > max_tokens, "EXTRACTION_TOKENS_EXCEEDED").alias("code")).where("code is not null")
    w = Window.partitionBy("revision_id").orderBy("start_byte", "directive_kind", "payload")
    counts = ((F.col("directive_kind") != "SKILL") & F.col("code").isNull()).cast("int")
    numbered = operations.join(large.select("revision_id"), "revision_id", "left_anti").withColumn("before", F.coalesce(F.sum(counts).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    over = numbered.where(F.col("before") >= max_operations).select("revision_id").distinct().withColumn("code", F.lit("OPERATION_LIMIT_REACHED"))
    return numbered.where(F.col("before") < max_operations).drop("before"), large.unionByName(over)


def stage_drafts(operations: DataFrame, existing: DataFrame) -> DataFrame:
    """New drafts (draft_id, batch_key, revision_id, draft_kind, digest, operations): one for each source's operations, one for each skill.

    Drafts that `existing` has by (batch_key, digest, draft_kind) are left out.
    """
    row = digest(F.concat_ws("|", "revision_id", "start_byte", "directive_kind", "payload"))
    o = operations.withColumn("h", row)
    facts = o.where("directive_kind <> 'SKILL'").groupBy("batch_key", "revision_id").agg(digest(F.array_join(F.array_sort(F.collect_list("h")), "")).alias("digest"), F.count("*").alias("operations")).withColumn("draft_kind", F.lit("OPERATIONS"))
    skills = o.where("directive_kind = 'SKILL'").select("batch_key", "revision_id", F.col("h").alias("digest"), F.lit(1).cast("long").alias("operations"), F.lit("SKILL").alias("draft_kind"))
    drafts = facts.unionByName(skills).dropDuplicates(["batch_key", "digest", "draft_kind"])
    new = drafts.join(existing.select("batch_key", "digest", "draft_kind"), ["batch_key", "digest", "draft_kind"], "left_anti")
    return new.withColumn("draft_id", short_id("draft_", F.concat_ws("|", "batch_key", "draft_kind", "digest")))


def expire_drafts(drafts: DataFrame, now: str) -> DataFrame:
    """Drafts, with those in DRAFT whose expires_at is not after now as EXPIRED."""
    due = (F.col("status") == "DRAFT") & (F.col("expires_at") <= F.lit(now).cast("timestamp"))
    return drafts.withColumn("status", F.when(F.coalesce(due, F.lit(False)), "EXPIRED").otherwise(F.col("status")))


def draft_state(updates: DataFrame) -> DataFrame:
    """(draft_id, status, version, document): the latest of each; a new document raises the version, a status alone doesn't.

    updates: draft_id, seq, status, document (null where it didn't change).
    """
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return updates.groupBy("draft_id").agg(latest("status"), F.count("document").alias("version"), latest("document"))
