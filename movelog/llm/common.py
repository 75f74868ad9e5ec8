"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import map_frames  # noqa: F401 - the operators take it from here

#: Characters of text that a Python task holds as numpy arrays at one time, and rows of an Arrow batch.
BLOCK_CHARS = 500_000
BATCH_ROWS = 1_000
#: Ids up to this many are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows: texts are long, and a Python worker should stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the id and the text, under fixed names, and the columns to keep; a null text counts as empty.

    Selecting first makes extra columns, whatever their names, harmless.
    """
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep)


def placed_in_files(df: DataFrame, name: str = "place") -> DataFrame:
    """df, read from files, with each row's place from 0 in the order in which they were written."""
    at = df.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias(name))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    starts = at.groupBy("__file").agg(F.count(F.lit(1)).alias("__n")).select(F.col("__file").alias("__of"), before.alias("__start"))
    return at.join(F.broadcast(starts), F.col("__file") == F.col("__of")).withColumn(name, F.col(name) + F.col("__start")).drop("__file", "__of", "__start")


def blocks(frames: Iterator[pd.DataFrame], column: str = "text", limit: int = BLOCK_CHARS) -> Iterator[pd.DataFrame]:
    """Cuts batches so that each holds about `limit` characters at most, or one row."""
    for frame in frames:
        if not len(frame):
            continue
        part = frame[column].str.len().cumsum().sub(1).clip(lower=0).floordiv(limit)
        if part.iloc[-1] == 0:
            yield frame
        else:
            for _, rows in frame.groupby(part.to_numpy(), sort=False):
                yield rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; on one machine, where it is unset, one set here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def most_frequent(counts: DataFrame, limit: int, n: str = "n") -> DataFrame:
    """The rows with the highest counts, at most `limit` of them: all from the lowest power of two on that leaves so few.

    Only the number of rows by power of two reaches the driver, and no task sorts or holds the rows.
    """
    sizes = counts.groupBy(F.floor(F.log2(F.col(n))).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("power")).collect()
    total, least = 0, None
    for row in sizes:
        total += row["rows"]
        if total > limit:
            break
        least = 2 ** row["power"]
    return counts.where(F.lit(False) if least is None else F.col(n) >= least)
