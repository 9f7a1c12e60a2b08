"""A shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a few ids that one task sorts or groups.
TASK_ROWS = 250_000


def task_parts(*tables: DataFrame) -> int:
    """Parts of at most about TASK_ROWS rows for tables that meet by a key of few rows.

    Left to itself Spark joins small parts until they have a number of bytes, as they are compressed, and short ids compress so well that such a part holds millions of rows;
    and a grouping starts where rows are read, over all that one task reads. Rows dealt by this number keep a task's memory as it is, however many rows there are.
    """
    rows = max(t.count() for t in tables)
    return max(-(-rows // TASK_ROWS), int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")))


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own in local mode and an error on a cluster, whose executors couldn't see that folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tallystone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage and outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
