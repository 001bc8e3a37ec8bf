"""Tables and the shared folder of registered queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table that one task holds at most, about, where the number of tasks follows the table.
ROWS_A_TASK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see; a temporary one only for a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and spark.sparkContext.master.startswith("local"):
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{(named or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of few bytes and much work each, dealt out by key: a file of millions of them may be one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def tasks_for(rows: DataFrame) -> int | None:
    """Tasks that keep each to ROWS_A_TASK of a table's rows, whatever its size; none where Spark's least number does so.

    Counting a file reads its footer only.
    """
    n = -(-rows.count() // ROWS_A_TASK)
    return n if n > rows.sparkSession.sparkContext.defaultParallelism else None
