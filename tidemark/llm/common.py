"""Helpers that several operators share: the shared folder, written tables, table paths."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: the session's ``spark.checkpoint.dir``.

    Only where that is unset, a folder of our own is used: a temporary one for a
    local master, one in the warehouse otherwise.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.applicationId not in _OWN:
        if context.master.startswith("local"):
            own = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        else:
            own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tidemark"
        _OWN[context.applicationId] = own
    return _OWN[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, name: str = "rec") -> F.Column:
    """All columns of a row as one struct, so that working columns can't clash with the caller's names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def same(a: F.Column, b: F.Column) -> F.Column:
    return a.eqNullSafe(b)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once nothing reads them any more."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python a few hundred rows at a time, so that very long ones fit together."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
