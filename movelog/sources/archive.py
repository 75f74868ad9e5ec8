"""Game archives: text blocks that begin with an event tag."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What opens a game at the start of a line, and so what separates two games.
OPENING = '[Event "'
SEPARATOR = "\n" + OPENING
#: The same after a line end that is a carriage return alone.
_RETURN = re.compile("\r(?=" + re.escape(OPENING) + ")")


def framed(text: DataFrame) -> DataFrame:
    """game: the games of a text table that was read with SEPARATOR, with the opening put back that the separator has taken.

    A game begins at every line that begins with the opening, and at no other. A record begins right
    after a separator, unless it is the first of its file; that one has its own opening, or it is text
    before the first game, which goes. Which record is a file's first is told by the place of its split
    within the file: split by split, the first record of a split that begins at 0.
    Line ends become single line feeds.
    """
    rows = text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for batch in batches:
            games: list[str] = []
            for value, path, start in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                first, split = start == 0 and split != (path, start), (path, start)
                parts = _RETURN.split(value if first else OPENING + value)
                games += [clean(part) for part in parts if part.startswith(OPENING)]
            yield pa.RecordBatch.from_pydict({"game": games}, pa.schema([("game", pa.string())]))

    return rows.mapInArrow(run, "game string")


def clean(game: str) -> str:
    return game.replace("\r\n", "\n").replace("\r", "\n").rstrip(" \t\n")


def read_games(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """One row `game` per game of plain or compressed archives; bytes that aren't UTF-8 are replaced.

    A compressed archive is read by one task, so its games are dealt out again before any parsing.
    """
    games = framed(spark.read.option("lineSep", SEPARATOR).text(path))
    return games.repartition(partitions) if partitions else games


def archive_text(moves: DataFrame) -> DataFrame:
    """game_id, game: an archive block of each game of a move table with event, site and eval_text."""
    tag = lambda name, c: F.concat(F.lit(f'[{name} "'), c.cast("string"), F.lit('"]'))
    clock = F.col("clock").cast("int")
    annotation = F.concat_ws(
        " ",
        F.when(F.col("eval_text").isNotNull(), F.concat(F.lit("[%eval "), F.col("eval_text"), F.lit("]"))),
        F.when(clock.isNotNull(), F.format_string("[%%clk %d:%02d:%02d]", F.floor(clock / 3600), F.floor(clock / 60) % 60, clock % 60)),
    )
    number = F.concat(F.ceil(F.col("half_move") / 2).cast("string"), F.when(F.col("half_move") % 2 == 1, ".").otherwise("..."))
    token = F.concat(number, F.lit(" "), F.col("move"), F.when(annotation != "", F.concat(F.lit(" { "), annotation, F.lit(" }"))).otherwise(""))
    per_game = moves.groupBy("game_id").agg(
        *[F.min(c).alias(c) for c in ("event", "site", "date", "white", "black", "white_elo", "black_elo", "time_control", "termination", "result")],
        F.array_sort(F.collect_list(F.struct("half_move", token.alias("token")))).alias("tokens"),
    )
    tags = [tag("Event", F.col("event")), tag("Site", F.col("site")), tag("Date", F.date_format("date", "yyyy.MM.dd")), tag("White", F.col("white")), tag("Black", F.col("black"))]
    tags += [tag("WhiteElo", F.col("white_elo")), tag("BlackElo", F.col("black_elo")), tag("TimeControl", F.col("time_control")), tag("Termination", F.col("termination")), tag("Result", F.col("result"))]
    body = F.concat(F.array_join(F.transform("tokens", lambda t: t["token"]), " "), F.lit(" "), F.col("result"))
    return per_game.select("game_id", F.concat(F.concat_ws("\n", *tags), F.lit("\n\n"), body).alias("game"))


def write_archive(games: DataFrame, path: str) -> None:
    """Games as plain text, a blank line after each."""
    games.select("game").write.option("lineSep", "\n\n").text(path)
