"""Streams that stop and start again from their checkpoints, against the batch forms."""

import datetime
import json
import random
import time

import pytest

from tallystone.operators import ledger, views
from tallystone.streaming import stateful, traces


def add(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, made, schema, tmp_path):
    """What the stream adds to its file sink when it runs over what is there, from the same checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = made(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(180)
    assert q.exception() is None
    return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]


def test_idempotency_survives_a_restart(spark, tmp_path):
    schema = "proposal_id string, idempotency_key string, proposal_hash string, arrival long"
    rows = [("p1", "k", "h1", 1), ("p2", "k", "h1", 2), ("p3", "k", "h2", 3), ("p4", None, "h", 4), ("p5", "m", None, 5)]
    later = [("p6", "m", None, 6), ("p7", "k", "h1", 7), ("p8", "n", "h1", 8)]
    add(spark, rows, schema, tmp_path / "in")
    run(spark, stateful.idempotency_stream, schema, tmp_path)
    add(spark, later, schema, tmp_path / "in")
    got = run(spark, stateful.idempotency_stream, schema, tmp_path)
    batch = ledger.idempotency(spark.createDataFrame(rows + later, schema))
    assert sorted(got) == sorted(tuple(r) for r in batch.select("proposal_id", "outcome", "receipt_of").collect()) and len(got) == 7


def test_first_writer_wins_survives_a_restart(spark, tmp_path):
    schema = "aggregate_id string, arrival long, proposal_id string, base_version long"
    draw = random.Random(3)
    rows = [(draw.choice("ab"), i, f"p{i:03}", draw.choice([1, 2, 3, 4, 5, None])) for i in range(120)]
    add(spark, rows[:60], schema, tmp_path / "in")
    run(spark, stateful.first_writer_wins_stream, schema, tmp_path)
    add(spark, rows[60:], schema, tmp_path / "in")
    got = run(spark, stateful.first_writer_wins_stream, schema, tmp_path)
    batch = ledger.first_writer_wins(spark.createDataFrame(rows, schema))
    assert sorted(got, key=str) == sorted((tuple(r) for r in batch.select("proposal_id", "aggregate_id", "admitted").collect()), key=str)
    assert sum(ok for _, _, ok in got) >= 4


def cut(rows, seed):
    """rows in order of arrival as a few consecutive parts of random sizes."""
    draw = random.Random(seed)
    ends = sorted(draw.sample(range(1, len(rows)), draw.randint(1, 5)))
    return [rows[a:b] for a, b in zip([0, *ends], [*ends, len(rows)], strict=True)]


EVENTS = "session_id string, arrival long, event_id string, sequence long, event_type string"
BIG = 1 << 60


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ordered_append_agrees_with_batch_however_arrivals_are_cut(spark, tmp_path, seed):
    draw = random.Random(seed)
    at, rows = {"s": 0, "t": 0, None: 0}, []
    for i in range(150):
        who = draw.choice(list(at))
        wanted = draw.choice([at[who] + 1] * 4 + [at[who] + 2, at[who], None, BIG + 1])
        at[who] += wanted == at[who] + 1
        rows.append((who, BIG + i, f"e{i}", wanted, draw.choice(["TOOL"] * 30 + ["FINAL"])))
    for part in cut(rows, seed):
        draw.shuffle(part)  # rows of one micro-batch come in any order
        add(spark, part, EVENTS, tmp_path / "in")
    got = run(spark, traces.ordered_append, EVENTS, tmp_path)
    batch = traces.ordered_append_batch(spark.createDataFrame(rows, EVENTS)).drop("accepted")
    want = [tuple(r) for r in batch.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {"SEQUENCE_MISMATCH", None} <= {r[4] for r in want}


def test_ordered_append_judges_each_arrival_at_once(spark, tmp_path):
    rows = [("s", 1, "two", 2, "TOOL"), ("s", 2, "one", 1, "TOOL"), ("s", 3, "three", 3, "TOOL"), ("s", 4, "end", 2, "FINAL"), ("s", 5, "late", 3, "TOOL")]
    add(spark, rows, EVENTS, tmp_path / "in")
    got = {r[1]: r[4] for r in run(spark, traces.ordered_append, EVENTS, tmp_path)}
    assert got == {"two": "SEQUENCE_MISMATCH", "one": None, "three": "SEQUENCE_MISMATCH", "end": None, "late": "SESSION_CLOSED"}


def test_ordered_append_without_types_closes_no_session(spark, tmp_path):
    untyped = EVENTS.removesuffix(", event_type string")
    rows = [("s", i, f"e{i}", q) for i, q in enumerate([2, 1, 1, 2, None, 3])]
    add(spark, rows, untyped, tmp_path / "in")
    got = run(spark, traces.ordered_append, untyped, tmp_path)
    assert sorted(r[1] for r in got if r[4] is None) == ["e1", "e3", "e5"]
    batch = traces.ordered_append_batch(spark.createDataFrame(rows, untyped)).drop("accepted")
    assert sorted(got, key=str) == sorted((tuple(r) for r in batch.collect()), key=str)
    # a name in other letters is the column
    named = spark.createDataFrame([("s", 1, "a", 1, "FINAL"), ("s", 2, "b", 2, "TOOL")], EVENTS.replace("event_type", "Event_Type"))
    assert {r["event_id"]: r["code"] for r in traces.ordered_append_batch(named).collect()} == {"a": None, "b": "SESSION_CLOSED"}


def test_ordered_append_of_a_long_session_survives_a_restart(spark, tmp_path):
    n = 6_000
    add(spark, [("s", i, f"e{i}", i, "TOOL") for i in range(1, n + 1)], EVENTS, tmp_path / "in")
    run(spark, traces.ordered_append, EVENTS, tmp_path)
    add(spark, [("s", n + 1, "again", 7, "TOOL"), ("s", n + 2, "end", n + 1, "FINAL"), ("s", n + 3, "late", n + 2, "TOOL"), ("t", n + 4, "lost", None, "TOOL")], EVENTS, tmp_path / "in")
    got = {r[1]: r[4] for r in run(spark, traces.ordered_append, EVENTS, tmp_path)}
    assert len(got) == n + 4 and sum(c is None for c in got.values()) == n + 1
    assert [got[x] for x in ("again", "end", "late", "lost")] == ["SEQUENCE_MISMATCH", None, "SESSION_CLOSED", "SEQUENCE_MISMATCH"]


def test_state_goes_after_its_time(spark, tmp_path):
    """With ttl_ms a session that had no events for so long starts anew."""
    add(spark, [("s", 1, "a", 1, "TOOL")], EVENTS, tmp_path / "in")
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    q = traces.ordered_append(stream, 500).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start(str(tmp_path / "out"))

    def codes(n):
        for _ in range(120):
            time.sleep(0.5)
            assert q.exception() is None
            got = [tuple(r) for r in spark.read.schema("event_id string, code string").parquet(str(tmp_path / "out")).collect()] if (tmp_path / "out" / "_spark_metadata").exists() else []
            if len(got) >= n:
                return dict(got)
        raise AssertionError("no output")

    try:
        assert codes(1) == {"a": None}
        time.sleep(1)
        add(spark, [("s", 2, "b", 1, "TOOL")], EVENTS, tmp_path / "in")
        assert codes(2) == {"a": None, "b": None}
    finally:
        q.stop()


def test_receipts_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    schema = "trace_id string, event_id string, sequence long, event_type string, occurred_at timestamp"
    start = datetime.datetime(2024, 1, 1)
    of = lambda t, first, n: [(t, f"{t}{i}", i, "TOOL" if i % 3 else "TEST", start + datetime.timedelta(minutes=first + 5 * i)) for i in range(1, n + 1)]
    early, later = of("a", 0, 9), of("b", 30, 12)
    # what only moves the watermark on
    end = [("z", "z1", 1, "TOOL", start + datetime.timedelta(days=1))]
    made = traces.finalize_stream
    for rows in (early[:5] + later[:2], early[5:] + later[2:]):
        random.Random(0).shuffle(rows)
        add(spark, rows, schema, tmp_path / "in")
    assert {r[0] for r in run(spark, made, schema, tmp_path)} <= {"a"}
    add(spark, end, schema, tmp_path / "in")
    run(spark, made, schema, tmp_path)
    add(spark, [("z", "z2", 2, "TOOL", start + datetime.timedelta(days=1))], schema, tmp_path / "in")
    got = run(spark, made, schema, tmp_path)
    want = [tuple(r) for r in traces.finalize_traces(spark.createDataFrame(early + later, schema)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) == 2
    swapped = [(t, e, {1: 2, 2: 1}.get(n, n), k, at) for t, e, n, k, at in early]
    hashes = lambda rows: {r["content_hash"] for r in traces.finalize_traces(spark.createDataFrame(rows, schema)).collect()}
    assert hashes(early) != hashes(swapped) and hashes(early) == hashes(early[::-1])


def test_telemetry_of_a_stream_comes_once(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string"
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(minutes=i), "error" if i % 2 else "view") for i in range(40)]
    parts = [rows[:20], rows[10:30], rows[25:] + rows[38:]]
    for part in parts:
        add(spark, part, schema, tmp_path / "in")
    got = run(spark, lambda s: views.telemetry_stream(s, "error"), schema, tmp_path)
    want = [tuple(r) for r in views.telemetry(spark.createDataFrame([r for p in parts for r in p], schema), "error").collect()]
    assert sorted(got) == want and len(want) == 20


def test_dead_letters_of_a_stream_come_once(spark, tmp_path):
    good = [json.dumps({"session_id": f"s{i}"}) for i in range(4)]
    bad = ["{", "{}", None]
    parts = [good[:2] + bad[:2], [bad[0], good[2], bad[2]], [bad[1], bad[2], good[3], bad[0]]]
    letters = lambda s: traces.dead_letter_streams(s)[1]
    for part in parts[:2]:
        add(spark, [(x,) for x in part], "payload string", tmp_path / "in")
    run(spark, letters, "payload string", tmp_path)
    add(spark, [(x,) for x in parts[2]], "payload string", tmp_path / "in")
    got = run(spark, letters, "payload string", tmp_path)
    want = [tuple(r) for r in traces.dead_letters(spark.createDataFrame([(x,) for x in bad], "payload string")).collect()]
    assert sorted(got) == sorted(want) and len(want) == 3
    (tmp_path / "other").mkdir()
    (tmp_path / "in").rename(tmp_path / "other" / "in")
    kept = run(spark, lambda s: traces.dead_letter_streams(s)[0], "payload string", tmp_path / "other")
    assert sorted(x for (x,) in kept) == good
