"""Numbers and running values over one long order, in parallel: rows are dealt by ranges of the order, each range is reduced to one row, the few rows are summed up, and each range goes on from there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallystone.sources.scratch import written


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(at, at + batch.num_rows))], [*batch.schema.names, "__part", "__at"])
        at += batch.num_rows


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place (from 0) in the order, which should tell all rows apart. No task gets more than a range of them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("__part int, __at long").fields])
    ranged = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_count, schema), "numbered")
    # one row per range
    begin = ranged.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__begin", F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    return ranged.join(F.broadcast(begin.select("__part", "__begin")), "__part").withColumn(name, F.coalesce("__begin", F.lit(0)) + F.col("__at")).drop("__part", "__at", "__begin")


def last_before(rows: DataFrame, key: str, order: str, value: Column, name: str, number: str | None = None) -> DataFrame:
    """rows with the last value that isn't null of the rows of the same key before it, by order, and their number (from 1) within the key; a key of any size is dealt over all tasks.

    Rows are cut into ranges of (key, order). Within a range a row looks back; a range's last value of a key is carried to the ranges behind it, of which a key has few.
    Rows of equal key and order should not differ in value.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.withColumn("__value", value).repartitionByRange(n, key, order).withColumn("__part", F.spark_partition_id()), "ranged")
    here = Window.partitionBy("__part", key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy("__part", F.col(key).alias("__key")).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(order))).alias("__last"), F.count("*").alias("__n"))
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("__part").alias("__of"), "__key", F.last("__last", ignorenulls=True).over(earlier).alias("__carried"), F.sum("__n").over(earlier).alias("__before")).where("__before is not null")
    looked = ranged.withColumns({"__seen": F.last("__value", ignorenulls=True).over(here), "__at": F.count("*").over(here)})
    joined = looked.join(carried, (F.col("__part") == F.col("__of")) & F.col(key).eqNullSafe(F.col("__key")), "left")
    told = {name: F.coalesce("__seen", "__carried")} | ({number: F.coalesce("__before", F.lit(0)) + F.col("__at") + 1} if number else {})
    return joined.withColumns(told).drop("__value", "__part", "__seen", "__at", "__of", "__key", "__carried", "__before")
