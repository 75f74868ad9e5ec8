"""Archives as they arrive: the batch parser over a stream of files, with an account of what is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.parse import judged, reject_counts, rejects, usable_moves
from ..sources.archive import SEPARATOR, framed


def stream_games(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of games, one row each, from the text files of a folder."""
    return framed(spark.readStream.option("lineSep", SEPARATOR).text(folder))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, keyword: str = "blitz") -> StreamingQuery:
    """Parses all files that are there and not yet done, then stops.

    Under `out` come the move table (moves), the games that were dropped with their reasons (rejects),
    and for each batch how many games ended in each way (counts). A batch that is repeated after a
    failure writes the same folders again, so that nothing counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        seen = judged(batch, keyword).persist()
        try:
            for name, df in (("moves", usable_moves(seen)), ("rejects", rejects(seen)), ("counts", reject_counts(seen))):
                df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            seen.unpersist()

    return stream_games(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def moves(spark: SparkSession, out: str) -> DataFrame:
    """All moves that have been ingested."""
    return spark.read.parquet(f"{out}/moves").drop("batch")


def outcomes(spark: SparkSession, out: str) -> DataFrame:
    """reason, n over all batches."""
    return spark.read.parquet(f"{out}/counts").groupBy("reason").agg(F.sum("n").alias("n"))
