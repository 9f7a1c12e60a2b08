"""Serial folds over streams with transformWithState: the streaming forms of T03, L01 and L05.

One rule decides, in batch and stream alike: rows of a key are judged one by one in order of arrival. A micro-batch holds rows that arrived
together, so it is sorted by arrival before it is folded from the state that the batches before it left; however one order of arrival is cut
into micro-batches, the results are the same. What a task holds of a key is bounded by the micro-batch (`maxFilesPerTrigger` and the like).

State lives in RocksDB, so a store of many keys isn't bound by memory. It is kept for good unless ttl_ms is given: then a key's state
goes after so much processing time without a change, and the key starts anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """transformWithState needs this provider; queries take it from the session when they start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Fold(StatefulProcessor):
    """One value of state per key: step(state, *inputs) gives the next state and the results of each row of a key, in order."""

    def __init__(self, order: list[str], inputs: list[str], keep: list[str], results: list[str], start: tuple, state: str, step: Callable, ttl_ms: int | None):
        self.order, self.inputs, self.keep, self.results = order, inputs, keep, results
        self.start, self.schema, self.step, self.ttl_ms = start, StructType.fromDDL(state), step, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.schema, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        at, told = tuple(self.state.get()) if self.state.exists() else self.start, []
        # as Spark sorts: nulls first
        for row in sorted(rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in self.order)):
            at, *got = self.step(at, *(row[c] for c in self.inputs))
            told.append(Row(**{c: row[c] for c in self.keep}, **dict(zip(self.results, got, strict=True))))
        self.state.update(at)
        return iter(told)

    def close(self) -> None:
        pass


def fold_stream(stream: DataFrame, key: str, order: list[str], inputs: list[str], keep: list[str], results: str, start: tuple, state: str, step: Callable, ttl_ms: int | None = None) -> DataFrame:
    """The columns `keep` with those of `results`: step(state, *inputs) gives the next state and the results of each row of a key, in order. `start` is the state of a new key, `state` its schema."""
    keep_state_in_rocksdb(stream.sparkSession)
    added = StructType.fromDDL(results)
    schema = StructType([*(stream.schema[c] for c in keep), *added.fields])
    rows = stream.select(*dict.fromkeys([key, *order, *inputs, *keep])).groupBy(key)
    return rows.transformWithState(Fold(order, inputs, keep, added.names, start, state, step, ttl_ms), schema, "Append", "None" if ttl_ms is None else "ProcessingTime")


def idempotency_stream(proposals: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """L01 over a stream: (proposal_id, outcome, receipt_of). State is the first proposal of a key and its hash. Rows without a key have no result, as in the batch form."""

    def step(first: tuple, proposal_id: str, proposal_hash: str) -> tuple:
        known, holder, hashed = first
        if not known:
            return (True, proposal_id, proposal_hash), "NEW", proposal_id
        if holder is not None and holder == proposal_id:
            return first, "NEW", holder
        if hashed is not None and hashed == proposal_hash:
            return first, "REPLAY", holder
        return first, "IDEMPOTENCY_KEY_REUSE", None

    rows = proposals.where("idempotency_key is not null")
    return fold_stream(rows, "idempotency_key", ["arrival", "proposal_id"], ["proposal_id", "proposal_hash"], ["proposal_id"], "outcome string, receipt_of string", (False, None, None), "known boolean, proposal_id string, proposal_hash string", step, ttl_ms)


def first_writer_wins_stream(proposals: DataFrame, initial: int = 1, ttl_ms: int | None = None) -> DataFrame:
    """L05 over a stream: (proposal_id, aggregate_id, admitted). State is the version of an aggregate."""

    def step(version: tuple, base: int | None) -> tuple:
        ok = base == version[0]
        return (version[0] + ok,), ok

    return fold_stream(proposals, "aggregate_id", ["arrival", "proposal_id"], ["base_version"], ["proposal_id", "aggregate_id"], "admitted boolean", (initial,), "version long", step, ttl_ms)
