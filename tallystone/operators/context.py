"""Context selection for many requests at once.

Sizes are the items' bytes plus ENVELOPE for each, not those of a self-describing document, so packing agrees with its rule but not to
the byte. What a record scores without a request's terms and references is the same for all requests, so candidates are kept as one shared order and
few rows of each request's own; only results that list every record for every request make such rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.operators.retrieval import BROADCAST_QUERIES, QUERY_BLOCK, term_hits
from tallystone.sources.scratch import written

# The default budget, scores, and hints that a request may not use.
DEFAULT_BUDGET, ENVELOPE = 64 * 1024, 32
EXPLICIT, TERM, SCENARIO_TERM, OPEN_CONFLICT, CONTINUITY = 10_000, 20, 10, 30, 3
FORBIDDEN_HINTS = ["partition", "tenant", "workspace"]
NO_TERM = "[^A-Za-z0-9_:.@/-]+"


def normalize_requests(requests: DataFrame) -> DataFrame:
    """Requests with sorted distinct refs, terms, depth, budget and code. budget: the smaller of bytes and tokens * 4, else 64 KiB.

    requests: request_id, task, query, refs, depth, budget_bytes, budget_tokens, hints map.
    """
    none = F.array().cast("array<string>")
    words = F.transform(F.split(F.concat_ws(" ", "task", "query"), NO_TERM), lambda t: F.lower(t))
    terms = F.array_sort(F.array_distinct(F.filter(words, lambda t: F.length(t) > 1)))
    code = F.when(F.arrays_overlap(F.map_keys("hints"), F.array(*map(F.lit, FORBIDDEN_HINTS))), "HINT_FORBIDDEN").when((F.col("budget_bytes") <= 0) | (F.col("budget_tokens") <= 0), "BUDGET_INVALID")
    budget = F.coalesce(F.least("budget_bytes", F.col("budget_tokens") * 4), F.lit(DEFAULT_BUDGET))
    return requests.select("request_id", F.array_sort(F.array_distinct(F.coalesce("refs", none))).alias("refs"), terms.alias("terms"), F.coalesce("depth", F.lit("SUMMARY")).alias("depth"), budget.cast("long").alias("budget"), code.alias("code"))


def _points(requests: DataFrame, rows: DataFrame, hays: list[str], score: Column) -> DataFrame:
    """(request_id, id, score) of the rows that hold terms of a request; score sees how many of its terms each of `hays` holds."""
    asked = requests.select("request_id", F.explode("terms").alias("term"))
    hits = term_hits(asked.select("term").distinct(), rows, hays, requests.count() <= BROADCAST_QUERIES)
    met = hits.join(asked, "term").groupBy("request_id", "id").agg(*[F.sum(h).alias(h) for h in hays])
    return met.select("request_id", "id", score.cast("long").alias("score"))


def _explicit(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """(request_id, id, score) of the rows that a request refers to."""
    return requests.select("request_id", F.explode("refs").alias("id")).join(rows.select("id"), "id").select("request_id", "id", F.lit(EXPLICIT).cast("long").alias("score"))


def _record_rows(records: DataFrame) -> DataFrame:
    """(id, hay, own): what a record scores for every request."""
    k = F.col("kind")
    own = F.when(F.col("priority") == "P0", 15).when(F.col("priority") == "P1", 8).otherwise(0) + F.when((k == "CONFLICT") & (F.col("status") == "OPEN"), OPEN_CONFLICT).otherwise(0) + F.when(k.isin("DECISION_RECORD", "OPEN_QUESTION", "WORK_ITEM"), CONTINUITY).otherwise(0)
    return records.select(F.col("object_id").alias("id"), F.lower(F.concat_ws(" ", "title", "summary", "document")).alias("hay"), own.cast("long").alias("own"))


def _own_records(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """(request_id, id, score) of the records that a request refers to or has terms in: all others score what they do for any request."""
    met = _points(requests, rows, ["hay"], F.col("hay") * TERM).unionByName(_explicit(requests, rows)).groupBy("request_id", "id").agg(F.sum("score").alias("points"))
    return met.join(rows.select("id", "own"), "id").select("request_id", "id", (F.col("points") + F.col("own")).alias("score"))


def for_each_request(shared: DataFrame, own: DataFrame, requests: DataFrame, key: list[str]) -> DataFrame:
    """own, and every row of shared for each request that has none with its key. Both: key columns and score. Requests come in blocks, each of which meets each row once."""
    n = requests.count()
    blocks = written(requests.select("request_id").withColumn("b", F.pmod(F.xxhash64("request_id"), F.lit(max(1, -(-n // QUERY_BLOCK))))), "request-blocks")
    named = blocks.groupBy("b").agg(F.collect_list("request_id").alias("of"))
    taken = own.join(F.broadcast(blocks) if n <= BROADCAST_QUERIES else blocks, "request_id").groupBy(*key, "b").agg(F.collect_list("request_id").alias("taken"))
    # a row becomes as many as there are requests: a number of partitions that isn't merged for being small
    spread = shared.repartition(int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    met = spread.crossJoin(F.broadcast(named) if n <= BROADCAST_QUERIES else named).join(taken, [*key, "b"], "left")
    rest = met.select(F.explode(F.array_except("of", F.coalesce("taken", F.array().cast("array<string>")))).alias("request_id"), *[c for c in shared.columns])
    return own.select("request_id", *shared.columns).unionByName(rest)


def score_records(requests: DataFrame, records: DataFrame) -> DataFrame:
    """(request_id, id, score): explicit reference, terms found as substrings, priority P0 or P1, open conflict, and a base for decisions, questions and work."""
    rows = written(_record_rows(records), "record-rows")
    shared = rows.where("own > 0").select("id", F.col("own").alias("score"))
    return for_each_request(shared, _own_records(requests, rows), requests, ["id"])


def score_views(requests: DataFrame, views: DataFrame) -> DataFrame:
    """(request_id, id, score) of views: 10 for each term, and for an explicit reference as for records."""
    rows = views.select(F.col("artifact_id").alias("id"), F.lower(F.concat_ws(" ", "title", "document")).alias("hay"))
    return _points(requests, rows, ["hay"], F.col("hay") * SCENARIO_TERM).unionByName(_explicit(requests, rows)).groupBy("request_id", "id").agg(F.sum("score").alias("score"))


def score_skills(requests: DataFrame, skills: DataFrame, limit: int = 5) -> DataFrame:
    """The best approved skills of each request: 3 for a term in the triggers, 1 for one only in purpose or preconditions; ties by id."""
    rows = skills.where("status = 'APPROVED'").select(F.col("skill_id").alias("id"), F.lower(F.array_join("triggers", " ")).alias("t"), F.lower(F.concat_ws(" ", F.col("purpose"), F.array_join("triggers", " "), F.array_join("preconditions", " "))).alias("hay"))
    # skills of equal texts score alike for any request, so only the first of them can be among its best
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("t", "hay").orderBy("id"))).where(F.col("at") <= limit).drop("at")
    # what the triggers hold, the whole text holds as well
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), "id")
    return _points(requests, rows, ["t", "hay"], 2 * F.col("t") + F.col("hay")).where("score > 0").withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("n")


def order_candidates(records: DataFrame, views: DataFrame, skills: DataFrame) -> DataFrame:
    """(request_id, position, kind, id, score): all candidates of a request by score, kind and id."""
    rows = records.withColumn("kind", F.lit("record")).unionByName(views.withColumn("kind", F.lit("scenario"))).unionByName(skills.withColumn("kind", F.lit("skill")))
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), "kind", "id")
    return rows.select("request_id", F.row_number().over(w).alias("position"), "kind", "id", "score")


def candidates(requests: DataFrame, records: DataFrame, views: DataFrame, skills: DataFrame, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """(shared, own): the candidates of X05 without a row for each request and record.

    shared: (kind, id, score), which is the same for every request; own: (request_id, kind, id, score) of what a request refers to or has terms in, which stands in place of the shared row of the same kind and id.
    A row of own never scores less than its shared row.
    """
    rows = written(_record_rows(records), "record-rows")
    shared = rows.where("own > 0").select(F.lit("record").alias("kind"), "id", F.col("own").alias("score"))
    kinds = {"record": _own_records(requests, rows), "scenario": score_views(requests, views), "skill": score_skills(requests, skills, limit)}
    own = [df.select("request_id", F.lit(kind).alias("kind"), "id", "score") for kind, df in kinds.items()]
    return shared, own[0].unionByName(own[1]).unionByName(own[2])


#: Rows of the shared order that every request may walk from memory; beyond them only rows that can still fit are met.
SHARED_HEAD = 4096
PACKED = "request_id string, kind string, id string, left long, open boolean"


def _merge(head: list[tuple], least_behind: int | None, skip: bool):
    """Walks each request's own rows, in order, merged with the shared head. Yields what is included, and for each request what is left and whether rows behind the head may still fit.

    head: (key, kind, id, size) in order, key = (-score, kind, id). Before the shared row of an id comes its own row, if there is one, as that scores at least as much.
    """
    ids = {(kind, id_): k for k, (_, kind, id_, _) in enumerate(head)}
    # the smallest size from each row of the head on
    least = [0] * (len(head) + 1)
    least[-1] = least_behind if least_behind is not None else 1 << 62
    for k in range(len(head) - 1, -1, -1):
        least[k] = min(head[k][3], least[k + 1])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        request, left, at, stopped, replaced, later = None, 0, 0, True, set(), 1 << 62

        def take(kind: str, id_: str, size: int) -> None:
            nonlocal left, stopped
            if stopped:
                return
            if size <= left:
                left -= size
                out.append((request, kind, id_, None, None))
            elif not skip:
                stopped = True

        def shared_up_to(key: tuple | None) -> None:
            nonlocal at
            while at < len(head) and (key is None or head[at][0] < key) and not stopped and left >= least[at]:
                _, kind, id_, size = head[at]
                if at not in replaced:
                    take(kind, id_, size)
                at += 1

        def done() -> None:
            if request is not None:
                shared_up_to(None)
                more = not stopped and least_behind is not None and left >= min(least_behind, later)
                out.append((request, None, None, left, more))

        for batch in batches:
            for row in batch.to_pylist():
                if row["request_id"] != request:
                    done()
                    request, left, at, replaced, later = row["request_id"], row["budget"], 0, set(), 1 << 62
                    stopped = (row["must"] or 0) > row["budget"]
                if row["id"] is None:
                    continue
                key = (-row["score"], row["kind"], row["id"])
                if (row["kind"], row["id"]) in ids:
                    replaced.add(ids[row["kind"], row["id"]])
                if not row["first"]:
                    shared_up_to(key)
                    if least_behind is not None and key > head[-1][0]:
                        later = min(later, row["size"])
                        continue
                take(row["kind"], row["id"], row["size"])
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist([dict(zip(_PACKED_NAMES, r, strict=True)) for r in out], schema=_PACKED_TYPES)
                out.clear()
        done()
        yield pa.RecordBatch.from_pylist([dict(zip(_PACKED_NAMES, r, strict=True)) for r in out], schema=_PACKED_TYPES)

    return walk


_PACKED_NAMES = [c.split()[0] for c in PACKED.split(", ")]
_PACKED_TYPES = pa.schema([("request_id", pa.string()), ("kind", pa.string()), ("id", pa.string()), ("left", pa.int64()), ("open", pa.bool_())])


def pack_shared(shared: DataFrame, own: DataFrame, requests: DataFrame, skip: bool, head: int = SHARED_HEAD) -> tuple[DataFrame, DataFrame]:
    """X06 and X07 over `candidates`: (included: request_id, kind, id; requests: request_id, code), without a row for each request and record.

    shared: kind, id, score, bytes; own: request_id, kind, id, score, bytes, mandatory. Rows go by score, kind and id; skip: what doesn't fit is skipped (X06), else the first that doesn't fit ends
    it, after the mandatory ones (X07). The first rows of the shared order are walked from memory, merged with each request's own, as long as the smallest row ahead still fits. Requests
    whose budget outlasts the head meet the rows behind it that are small enough.
    """
    order = [F.desc("score"), "kind", "id"]
    shared = written(shared.select("kind", "id", "score", (F.col("bytes") + ENVELOPE).cast("long").alias("size")), "shared-order")
    first = [((-r["score"], r["kind"], r["id"]), r["kind"], r["id"], r["size"]) for r in shared.orderBy(*order).limit(head).collect()]  # `head` rows at most
    behind = F.lit(False)
    if first and len(first) == head:
        (score, kind, id_) = first[-1][0]
        behind = F.struct((-F.col("score")).alias("s"), F.col("kind"), F.col("id")) > F.struct(F.lit(score).cast("long").alias("s"), F.lit(kind).alias("kind"), F.lit(id_).alias("id"))
    least_behind = shared.where(behind).agg(F.min("size")).first()[0] if first and len(first) == head else None
    own = written(own.select("request_id", "kind", "id", "score", (F.col("bytes") + ENVELOPE).cast("long").alias("size"), F.coalesce("mandatory", F.lit(False)).alias("mandatory")), "own-candidates")
    must = own.where("mandatory").groupBy("request_id").agg(F.sum("size").alias("must"))
    asked = written(requests.select("request_id", F.col("budget").cast("long").alias("budget")).join(must, "request_id", "left"), "budgets")
    limits = asked.withColumn("must", F.lit(None).cast("long") if skip else F.col("must"))
    rows = limits.join(own, "request_id", "left").withColumn("first", (F.lit(not skip) & F.col("mandatory")))
    dealt = rows.repartition("request_id").sortWithinPartitions("request_id", F.desc(F.coalesce("first", F.lit(True))), *order)
    packed_rows = written(dealt.select("request_id", "budget", "must", "kind", "id", "score", "size", "first").mapInArrow(_merge(first, least_behind, skip), PACKED), "packed")
    included = packed_rows.where("id is not null").select("request_id", "kind", "id")
    open_ = packed_rows.where("open").select("request_id", "left")
    if least_behind is not None and open_.limit(1).count():
        # of rows behind the head, those that fit into what such a request has left
        mine = own.where(behind).where("not mandatory" if not skip else "true").select("request_id", "kind", "id", "score", "size").join(open_, "request_id")
        theirs = shared.where(behind).crossJoin(F.broadcast(open_) if open_.count() <= BROADCAST_QUERIES else open_)
        theirs = theirs.where(F.col("size") <= F.col("left")) if skip else theirs
        theirs = theirs.join(own.select("request_id", "kind", "id"), ["request_id", "kind", "id"], "left_anti")
        rest = mine.unionByName(theirs.select(mine.columns))
        if skip:
            walked = rest.repartition("request_id").sortWithinPartitions("request_id", *order).select("request_id", "left", "kind", "id", "size")
            more = walked.mapInArrow(_fill, "request_id string, kind string, id string")
        else:
            w = Window.partitionBy("request_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
            more = rest.withColumn("used", F.sum("size").over(w)).where("used <= left")
        included = included.unionByName(written(more.select("request_id", "kind", "id"), "packed-more"))
    if skip:
        lost = own.where("mandatory").join(included, ["request_id", "kind", "id"], "left_anti").select("request_id", F.lit("CONTEXT_REFERENCE_EXCEEDS_BUDGET").alias("code")).distinct()
        return included, asked.select("request_id").join(lost, "request_id", "left")
    return included, asked.select("request_id", F.when(F.col("must") > F.col("budget"), "CONTEXT_BUDGET_EXCEEDED").alias("code"))


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Greedy over sorted rows: what fits into what is left."""
    request, left = object(), 0
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for k, (of, given, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("request_id", "left", "size")), strict=True)):
            if of != request:
                request, left = of, given
            if size <= left:
                keep[k], left = True, left - size
        yield batch.filter(pa.array(keep)).select(["request_id", "kind", "id"])


def report_shared(shared: DataFrame, own: DataFrame, included: DataFrame, requests: DataFrame) -> DataFrame:
    """X10 over `pack_shared`: (request_id, section, included, omitted, first_omitted) for each kind of which a request has candidates, without a row for each request and record."""
    key = ["request_id", "kind"]
    every = shared.groupBy("kind").agg(F.count("*").alias("n"))  # one row per kind
    base = requests.select("request_id").crossJoin(F.broadcast(every))
    alone = own.join(shared.select("kind", "id"), ["kind", "id"], "left_anti").groupBy(*key).agg(F.count("*").alias("more"))
    got = included.groupBy(*key).agg(F.count("*").alias("included"), F.collect_set("id").alias("ids"))  # as many as a budget holds
    most = got.agg(F.max("included")).first()[0] or 0
    w = Window.partitionBy("kind").orderBy("id")
    # one more than any request includes of a kind: the first that it lacks is among them
    small = shared.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most + 1).groupBy("kind").agg(F.array_sort(F.collect_list("id")).alias("smallest"))
    missed = own.join(included, [*key, "id"], "left_anti").groupBy(*key).agg(F.min("id").alias("own_omitted"))
    out = base.join(alone, key, "full").join(got, key, "left").join(missed, key, "left").join(F.broadcast(small), "kind", "left")
    shared_omitted = F.get(F.filter("smallest", lambda x: ~F.coalesce(F.array_contains("ids", x), F.lit(False))), 0)
    n = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
    n_in = F.coalesce("included", F.lit(0))
    return out.select("request_id", F.col("kind").alias("section"), n_in.alias("included"), (n - n_in).alias("omitted"), F.least(shared_omitted, "own_omitted").alias("first_omitted"))


def pack_skip(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, id, position, included, code): greedy by position; what doesn't fit is skipped, later items may still fit.

    candidates: request_id, position, id, bytes, mandatory. A mandatory item that doesn't fit gives code CONTEXT_REFERENCE_EXCEEDS_BUDGET to all rows of its
    request. All candidates are walked: rows are sorted within partitions and only a running total is kept, so a request may have any number.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        request, used = None, 0
        for batch in batches:
            flags = []
            for of, size, budget in zip(batch["request_id"], batch["bytes"], batch["budget"], strict=True):
                if of != request:
                    request, used = of, 0
                fits = used + size + ENVELOPE <= budget
                used += size + ENVELOPE if fits else 0
                flags.append(fits)
            yield batch[["request_id", "id", "position", "mandatory"]].assign(included=flags)

    rows = candidates.join(requests.select("request_id", "budget"), "request_id").select("request_id", "position", "id", "bytes", "mandatory", "budget")
    schema = rows.select("request_id", "id", "position", "mandatory").schema.add("included", "boolean")
    walked = written(rows.repartition("request_id").sortWithinPartitions("request_id", "position", "id").mapInPandas(walk, schema), "pack")
    broken = walked.where("mandatory and not included").select("request_id", F.lit("CONTEXT_REFERENCE_EXCEEDS_BUDGET").alias("code")).distinct()
    return walked.join(broken, "request_id", "left").select("request_id", "id", "position", "included", "code")


def pack_prefix(items: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, id, included): mandatory items first, then by position until the first that doesn't fit. A mandatory part over budget gives code CONTEXT_BUDGET_EXCEEDED."""
    w = Window.partitionBy("request_id").orderBy(F.desc("mandatory"), "position", "id").rowsBetween(Window.unboundedPreceding, 0)
    j = items.join(requests.select("request_id", "budget"), "request_id").withColumn("used", F.sum(F.col("bytes") + ENVELOPE).over(w))
    must = items.where("mandatory").groupBy("request_id").agg(F.sum(F.col("bytes") + ENVELOPE).alias("must"))
    j = j.join(must, "request_id", "left").withColumn("code", F.when(F.col("must") > F.col("budget"), "CONTEXT_BUDGET_EXCEEDED"))
    return j.select("request_id", "id", (F.col("code").isNull() & (F.col("used") <= F.col("budget"))).alias("included"), "code")


def project_depth(records: DataFrame, depth: Column) -> DataFrame:
    """Records with document only for DETAIL and EVIDENCE, evidence only for EVIDENCE."""
    return records.withColumn("document", F.when(depth.isin("DETAIL", "EVIDENCE"), F.col("document"))).withColumn("evidence", F.when(depth == "EVIDENCE", F.col("evidence")))


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up; 0 for null."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4)


def truncation_report(packed_rows: DataFrame) -> DataFrame:
    """(request_id, section, included, omitted, first_omitted): counts per section and the smallest omitted id."""
    return packed_rows.groupBy("request_id", "section").agg(F.count_if("included").alias("included"), F.count_if(~F.col("included")).alias("omitted"), F.min(F.when(~F.col("included"), F.col("id"))).alias("first_omitted"))
