"""Cases that the given tables don't hold."""

from pyspark.sql import functions as F

from tallystone.operators import claims, extract, ledger, policy


def test_fences_close_only_at_their_own_kind(spark):
    lines = ["FACT: a", "```", "FACT: b", "~~~", "``", "```` x", "````", "FACT: c", "~~~~", "FACT: d", "~~~", "FACT: e", "~~~~~", "  FACT: f", "FACT: g"]
    df = spark.createDataFrame([("r", i, x, True) for i, x in enumerate(lines)], "revision_id string, line_no int, line string, markdown boolean")
    assert [r["line"] for r in extract.mask_fences(df, ["revision_id"]).orderBy("line_no").collect()] == ["FACT: a", "FACT: c", "FACT: g"]


def test_line_spans_are_bytes_and_skip_blank_lines(spark):
    df = spark.createDataFrame([("r", "é\r\n\nb\rc")], "revision_id string, content string")
    assert [tuple(r) for r in extract.line_spans(df).select("line", "start_byte", "end_byte").orderBy("start_byte").collect()] == [("é", 0, 2), ("b", 5, 6), ("c", 7, 8)]


def test_touching_intervals_do_not_overlap(spark):
    row = spark.sql("select timestamp'2024-01-01' a, timestamp'2024-02-01' b, timestamp'2024-03-01' c, cast(null as timestamp) n")
    o = claims.valid_time_overlap
    got = row.select(o(F.col("a"), F.col("b"), F.col("b"), F.col("c")), o(F.col("a"), F.col("c"), F.col("b"), F.col("n")), o(F.col("n"), F.col("n"), F.col("n"), F.col("n"))).first()
    assert tuple(got) == (False, True, True)


def test_polarity_conflicts_of_many_ignore_time(spark):
    from tallystone.plans.derive import registry

    base = spark.sql("select 'customer:1' subject_id, 'customer' subject_type, 'order.supplier@1' predicate, 'entity' object_kind, 'supplier:1' object_value, 'supplier' object_type, cast(null as string) component, 'F' environment, cast(null as string) region, cast(null as string) tenant, 'ACTIVE' status, 1 version")
    a = base.selectExpr("*", "'a' claim_id", "'POSITIVE' polarity", "timestamp'2020-01-01' valid_from", "timestamp'2020-02-01' valid_to", "1L seq")
    b = base.selectExpr("*", "'b' claim_id", "'NEGATIVE' polarity", "timestamp'2021-01-01' valid_from", "timestamp'2021-02-01' valid_to", "2L seq")
    assert [r["kind"] for r in claims.conflict_pairs(a.unionByName(b), registry(spark)).collect()] == ["POLARITY_CONFLICT"]


def test_chain_check_finds_the_first_bad_entry(spark):
    events = spark.createDataFrame([(1, i, f"p{i}") for i in range(1, 8)], "k int, seq long, payload string")
    chain = ledger.hash_chain_build(events, "k")
    assert ledger.hash_chain_check(chain, "k").count() == 0
    bad = chain.withColumn("payload", F.when(F.col("seq") >= 4, "x").otherwise(F.col("payload")))
    assert ledger.hash_chain_check(bad, "k").first()["first_invalid"] == 4
    assert ledger.sequence_gaps(chain.where("seq <> 3"), "k").first()["seq"] == 4


def test_unsafe_references(spark):
    refs = {"https://a/b+c": True, "https://a/%2e%2e/b": False, "a\\b": False, "a/./b": False, "%zz": True, "a" + "%25" * 1 + "25" * 12 + "2e": False, None: False}
    df = spark.createDataFrame([(r,) for r in refs], "ref string")
    assert {r["ref"]: r["ok"] for r in df.select("ref", policy.safe_ref(F.col("ref")).alias("ok")).collect()} == refs
