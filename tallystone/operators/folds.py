"""Serial folds over the rows of a key, where each row's result depends on those before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def fold_rows(rows: DataFrame, key: str, order: list[str], inputs: list[str], results: str, start: object, step: Callable) -> DataFrame:
    """rows with the columns of `results`: step(state, *inputs) gives the next state and the results of each row of a key, in order.

    Rows are sorted within partitions and stream by, so a key may have any number of them: only its state is held. Rows
    without a key are one key. Keys are dealt to tasks by hash; what one key has to do is serial by its nature.
    """
    added = StructType.fromDDL(results)
    types = [to_arrow_type(f.dataType) for f in added]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), start
        for batch in batches:
            out = [[] for _ in types]
            for of, *values in zip(*(batch.column(c).to_pylist() for c in (key, *inputs)), strict=True):
                if of != current:
                    current, state = of, start
                state, *got = step(state, *values)
                for column, value in zip(out, got, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(out, types, strict=True))], [*batch.schema.names, *added.names])

    dealt = rows.repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(walk, StructType([*rows.schema.fields, *added.fields]))
