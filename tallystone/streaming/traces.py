"""Traces and event streams (T01-T10), in batch and as Structured Streaming.

Order is by sequence number: events are judged one by one as they arrive, and early, late and repeated ones are rejected, as in an append-only session. The streams
give what the batch forms give for the same order of arrival, whatever their micro-batches are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.canon import canonical, digest, first_code, short_id
from tallystone.operators.folds import fold_rows
from tallystone.streaming.stateful import fold_stream, keep_state_in_rocksdb


def session_ids(events: DataFrame) -> DataFrame:
    """Events with session_id normalized (valid ids stay, others become a digest) and trace_id. events: raw_session."""
    raw = F.col("raw_session")
    good = raw.rlike("^[A-Za-z0-9_.:-]{1,64}$")
    session = F.when(good, raw).otherwise(short_id("session_", F.coalesce(raw, F.lit("")), 32))
    return events.withColumn("session_id", session).withColumn("trace_id", short_id("trace_", F.col("session_id"), 32))


def normalize_events(payloads: DataFrame) -> DataFrame:
    """(session_id, event_id, sequence, event_type, occurred_at, summary, code) of hook payloads; without a time they get code HOOK_TIMESTAMP_MISSING.

    payloads: session_id, payload (JSON), arrival. A missing id is a digest of the payload, a missing sequence the place in the session by arrival.
    """
    get = lambda f: F.nullif(F.get_json_object("payload", f"$.{f}"), F.lit(""))
    at = F.coalesce(get("occurred_at"), get("timestamp"))
    p = payloads.withColumns({"at": at, "tool": get("tool_name")})
    w = Window.partitionBy("session_id").orderBy("arrival")
    place = F.when(F.col("at").isNotNull(), F.count("at").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.select("session_id", F.coalesce(get("event_id"), short_id("trace_event_", F.col("payload"))).alias("event_id"), F.coalesce(get("sequence").try_cast("long"), place).alias("sequence"), F.lit("TOOL").alias("event_type"), F.col("at").alias("occurred_at"), F.coalesce(get("summary"), F.concat_ws(" ", F.lit("PostToolUse"), "tool")).alias("summary"), F.when(F.col("at").isNull(), "HOOK_TIMESTAMP_MISSING").alias("code"))


def _next_event(state: tuple, sequence: int | None, kind: str | None) -> tuple:
    count, closed = state
    if closed:
        return state, "SESSION_CLOSED"
    if sequence != count + 1:
        return state, "SEQUENCE_MISMATCH"
    return (count + 1, kind == "FINAL"), None


_ARRIVAL = ["arrival", "event_id", "sequence"]


def _typed(events: DataFrame) -> DataFrame:
    """Events that have no event_type get a null one: none of them is FINAL."""
    return events if "event_type" in map(str.lower, events.columns) else events.withColumn("event_type", F.lit(None).cast("string"))


def ordered_append(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of (session_id, arrival, event_id, sequence, event_type) with code: null if accepted, SEQUENCE_MISMATCH unless the sequence is the next one, SESSION_CLOSED after a FINAL event. Without the column event_type no event is FINAL.

    Each event is judged when it arrives: one that is early is rejected, like one that is late. State is a count and a flag per session; with ttl_ms it goes
    after so much time without events.
    """
    columns = ["session_id", "event_id", "sequence", "event_type"]
    return fold_stream(_typed(stream), "session_id", _ARRIVAL, ["sequence", "event_type"], columns, "code string", (0, False), "count long, closed boolean", _next_event, ttl_ms)


def ordered_append_batch(events: DataFrame) -> DataFrame:
    """T03 over a whole table in order of arrival, by the rule of the stream: (session_id, event_id, sequence, event_type, code, accepted).

    The accepted sequence numbers are 1, 2, 3...: the first arrival of n after that of n - 1, up to a FINAL event. A session's events stream through one task.
    """
    rows = _typed(events).select("session_id", *_ARRIVAL, "event_type")
    told = fold_rows(rows, "session_id", _ARRIVAL, ["sequence", "event_type"], "code string", (0, False), _next_event)
    return told.select("session_id", "event_id", "sequence", "event_type", "code", F.col("code").isNull().alias("accepted"))


def trace_check(events: DataFrame) -> DataFrame:
    """(trace_id, code) of traces that aren't sequences 1..n of distinct ids, or end before they start; null for sound ones. events: trace_id, sequence, event_id, occurred_at."""
    g = events.groupBy("trace_id").agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), F.count("*").alias("n"), F.countDistinct("sequence").alias("s"), F.countDistinct("event_id").alias("ids"), F.min_by("occurred_at", "sequence").alias("start"), F.max_by("occurred_at", "sequence").alias("end"))
    code = first_code(((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("s") != F.col("n")), "SEQUENCE_NOT_CONTIGUOUS"), (F.col("ids") != F.col("n"), "EVENT_ID_REPEATED"), (F.col("start") > F.col("end"), "ENDS_BEFORE_START"))
    return g.select("trace_id", code.alias("code"))


def _receipts(events: DataFrame, *by: Column | str) -> DataFrame:
    """Receipts of groups of events, aggregated step by step, so that no group is ever one list.

    An event's hash covers its sequence, so the sums of the hashes' four 64-bit words tell the events and their order.
    """
    h = F.sha2(canonical(F.struct("event_id", "event_type", "sequence")), 256)
    words = [F.sum(F.conv(F.substring("h", 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    g = events.withColumn("h", h).groupBy(*by).agg(F.count("*").alias("events"), F.array_sort(F.collect_set("event_type")).alias("types"), F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("ended_at"), F.concat_ws("|", *words).alias("sums"))
    return g.select("trace_id", "events", "types", "started_at", "ended_at", digest(F.col("sums")).alias("content_hash"))


def finalize_traces(events: DataFrame) -> DataFrame:
    """(trace_id, events, types, started_at, ended_at, content_hash): a receipt per trace, its hash over the events and their order. Repeated events count."""
    return _receipts(events, "trace_id")


def finalize_stream(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """T05 over a stream: a receipt as soon as the watermark (`delay` behind the latest occurred_at) has passed `gap` after a trace's last event.

    Append output: each receipt comes once. A trace that pauses for longer than the gap has one receipt for each of its parts; events behind the watermark are dropped.
    Events without a time belong to no part. State is one row per open part.
    """
    return _receipts(events.withWatermark("occurred_at", delay), "trace_id", F.session_window("occurred_at", gap))


def capture_idempotency(traces: DataFrame, prior: DataFrame) -> DataFrame:
    """(trace_id, outcome): UNCHANGED for the same bytes, TRACE_CONFLICT for others under one id, else CAPTURED. Both: trace_id, content_hash."""
    j = traces.join(prior.select("trace_id", F.col("content_hash").alias("old")), "trace_id", "left")
    return j.select("trace_id", F.when(F.col("old").isNull(), "CAPTURED").when(F.col("old") == F.col("content_hash"), "UNCHANGED").otherwise("TRACE_CONFLICT").alias("outcome"))


def prune(traces: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(traces that didn't end before the cutoff, one row of scanned, removed and retained)."""
    old = F.coalesce(F.col("ended_at") < F.lit(cutoff).cast("timestamp"), F.lit(False))
    return traces.where(~old), traces.agg(F.count("*").alias("scanned"), F.count_if(old).alias("removed"), F.count_if(~old).alias("retained"))


def cursor_page(log: DataFrame, after: int, limit: int) -> DataFrame:
    """The next rows by seq after a cursor, with has_more."""
    rows = log.where(F.col("seq") > after).orderBy("seq").limit(limit + 1)
    return rows.withColumn("n", F.row_number().over(Window.orderBy("seq"))).withColumn("has_more", F.max("n").over(Window.partitionBy()) > limit).where(F.col("n") <= limit).drop("n")


def trace_detail(receipts: DataFrame, sources: DataFrame) -> DataFrame:
    """(trace_id, position, event_type, code): events of a receipt's source; TRACE_HASH_MISMATCH where its bytes aren't the receipt's. sources: trace_id, content (JSON list of events)."""
    j = receipts.select("trace_id", "content_hash").join(sources, "trace_id", "left")
    code = first_code((F.col("content").isNull(), "TRACE_NOT_FOUND"), (digest(F.col("content")) != F.col("content_hash"), "TRACE_HASH_MISMATCH"))
    j = j.withColumn("code", code)
    events = F.when(F.col("code").isNull(), F.from_json("content", "array<struct<event_type:string>>"))
    return j.select("trace_id", "code", F.posexplode_outer(events).alias("position", "e")).select("trace_id", "position", F.col("e.event_type").alias("event_type"), "code")


def _with_letter(events: DataFrame) -> DataFrame:
    code = first_code((F.try_parse_json("payload").isNull(), "PAYLOAD_NOT_JSON"), (F.coalesce(F.get_json_object("payload", "$.session_id"), F.lit("")) == "", "SESSION_MISSING"))
    return events.withColumns({"code": code, "letter_id": short_id("letter_", F.coalesce("payload", F.lit("")))})


def dead_letters(events: DataFrame) -> DataFrame:
    """(letter_id, code): bad payloads, each content once. events: payload."""
    return _with_letter(events).where("code is not null").select("letter_id", "code").distinct()


def dead_letter_streams(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T10 over a stream: (events with good payloads, letters), each to be written by a query of its own with its own checkpoint.

    A letter comes once however often its content comes back: the ids that have come are kept in state, in RocksDB. A bad event never stops the stream.
    """
    keep_state_in_rocksdb(stream.sparkSession)
    told = _with_letter(stream)
    return told.where("code is null").drop("code", "letter_id"), told.where("code is not null").select("letter_id", "code").dropDuplicates(["letter_id"])
