"""Folders and tables that all executors see."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; on one machine, where that is unset, under the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of a table that a task of a shuffle gets at first.
ROWS_A_TASK = 250_000
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def dealt_by_size(df: DataFrame) -> DataFrame:
    """df, after telling Spark into how many partitions shuffles of so many rows begin; it merges small ones by itself.

    With a fixed number of partitions the rows that a task sorts, and so its memory, would grow with the input.
    """
    conf = df.sparkSession.conf
    conf.set(INITIAL, max(int(conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_A_TASK)))
    return df


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table, written once into a new shared folder and read back, for steps that several others read."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_by(df: DataFrame, name: str, column: str, times: int = 1) -> DataFrame:
    """As `kept`, in buckets by a column, so that this table and all that is made of its rows meet by keys that hold the column without a shuffle.

    Buckets are as many as shuffles of the rows that were last dealt by size begin with, `times` over if the table has so many rows for each of those. Spark knows
    them by an entry of the session's catalog, with the folder's name.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    view = f"spark_catalog.default.{path.rpartition('/')[2].replace('-', '_')}"
    buckets = times * int(spark.conf.get(INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).bucketBy(buckets, column).saveAsTable(view)
    # Under names of their own: a union tells how its rows lie only if its columns don't say of which table they are.
    return spark.table(view).alias(name).select(*[F.col(c).alias(c) for c in df.columns])


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """A derived table kept as Parquet: built if absent or if `rebuild`, and read from there."""
    if not rebuild:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass  # not there yet
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
