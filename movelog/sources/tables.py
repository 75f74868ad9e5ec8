"""Move tables, dataset tables and vectors: readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the raw move table, by their names in files.
RAW_MOVES = "GameId string, Date string, White string, Black string, WhiteElo int, BlackElo int, TimeControl string, Termination string, GameResult string, HalfMove int, Move string, Eval double, Clock int"
#: File name -> name in this package.
RAW_NAMES = {"GameId": "game_id", "Date": "date", "White": "white", "Black": "black", "WhiteElo": "white_elo", "BlackElo": "black_elo", "TimeControl": "time_control", "Termination": "termination", "GameResult": "result", "HalfMove": "half_move", "Move": "move", "Eval": "eval", "Clock": "clock"}
#: Sort keys of each dataset table.
ORDER = {"players": ("rating_bin", "split_by_player", "player"), "games": ("split_by_player", "split_by_games", "game_id"), "moves": ("game_id", "half_move"), "player_games": ("split_by_player", "split_by_games", "player", "game_id")}


def select_renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Only the mapped columns, source name -> new name; the scan reads no others."""
    return df.select([F.col(f"`{source}`").alias(name) for source, name in mapping.items()])


def read_moves(spark: SparkSession, path: str, schema: str = RAW_MOVES, mapping: dict[str, str] | None = None) -> DataFrame:
    """A move table from CSV with a header, plain or compressed."""
    return select_renamed(spark.read.schema(schema).csv(path, header=True), mapping or RAW_NAMES)


def write_moves(moves: DataFrame, path: str) -> None:
    """A move table as gzipped CSV under the file names."""
    back = {name: source for source, name in RAW_NAMES.items()}
    known = [c for c in moves.columns if c in back]
    moves.select([F.col(c).alias(back[c]) for c in known]).write.csv(path, header=True, compression="gzip")


def order_output(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A total order over all output files: ranges of the keys, sorted within."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_dataset(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """The dataset's tables, each in its order; Parquet is partitioned by the player split where there is one."""
    for name, df in tables.items():
        writer = order_output(df, ORDER[name]).write.mode("overwrite")
        if fmt == "csv":
            writer.csv(f"{folder}/{name}", header=True)
        elif "split_by_player" in df.columns:
            writer.partitionBy("split_by_player").parquet(f"{folder}/{name}")
        else:
            writer.parquet(f"{folder}/{name}")


def write_embeddings(vectors: DataFrame, path: str) -> None:
    """Long vectors (key columns, source_col, vec), partitioned by the column they are from."""
    vectors.write.mode("overwrite").partitionBy("source_col").parquet(path)
