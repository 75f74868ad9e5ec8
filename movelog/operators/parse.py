"""Games of archive text to rows: native columns from the header tags to the numbered moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bad_mate, clock_seconds, id_from_url, parse_elo, parse_eval

# The tags and patterns of the archive format, which decide what counts as a move.
TAGS = ("Event", "Site", "Date", "White", "Black", "WhiteElo", "BlackElo", "TimeControl", "Termination", "Result")
KEYWORD = "blitz"
RESULT = r"\s*(?:0-1|1-0|1/2-1/2)\s*$"
MOVE = r"(\d+)(?:\.\.\.)?\.?\s*((?:(?:[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8])(?:=[QRBN])?|(?:O-O(?:-O)?|0-0(?:-0)?))(?:\+\+?|\#)?)(?:[!?]{1,2})?(?:\s*\{([^}]+)\})?"
SECTION = r"(?s)\n\n(.+?)\n\n\["
OPEN_SECTION = r"(?s)\n\n(.+)"
EVAL = r"\[%eval\s+([^\]]+)\]"
CLOCK = r"\[%clk\s+([^\]]+)\]"


def tag(game: Column, name: str) -> Column:
    return F.regexp_extract(game, rf'\[{name} "([^"]+)"\]', 1)


def extract_tags(games: DataFrame) -> DataFrame:
    """All columns, and one for each tag; a missing tag is empty."""
    return games.select("*", *[tag(F.col("game"), t).alias(t) for t in TAGS])


def filter_event(games: DataFrame, keyword: str = KEYWORD) -> DataFrame:
    """Games whose event names the keyword in any case; it runs before any move is parsed."""
    return games.where(F.lower(tag(F.col("game"), "Event")).contains(keyword.lower()))


def move_section(game: Column) -> Column:
    """What follows the first blank line, up to a blank line before another tag, without the result at its end."""
    bounded, open_end = F.regexp_extract(game, SECTION, 1), F.regexp_extract(game, OPEN_SECTION, 1)
    return F.regexp_replace(F.when(bounded != "", bounded).otherwise(open_end), RESULT, "")


#: Private-use characters that stand between moves and their parts while a section is cut up.
BEGIN, PART, END = "\ue000", "\ue001", "\ue002"


def section_moves(section: Column) -> Column:
    """The moves of a section as an array of (number, move, eval_text, clock_text), in order.

    The move pattern runs over the section once: it puts marks around each move and its parts, and
    what follows only cuts at the marks. Text between moves lies outside the marks and goes.
    """
    bare = F.translate(section, BEGIN + PART + END, "\ufffd" * 3)
    marked = F.regexp_replace(bare, F.lit(MOVE), F.lit(f"{BEGIN}$1{PART}$2{PART}$3{END}"))
    found = F.split(marked, BEGIN)
    each = F.transform(F.slice(found, 2, 1 << 30), lambda m: F.split(F.substring_index(m, END, 1), PART))
    note = lambda m, pattern: F.nullif(F.trim(F.regexp_extract(m[2], pattern, 1)), F.lit(""))
    return F.transform(each, lambda m: F.struct(m[0].cast("int").alias("number"), m[1].alias("move"), note(m, EVAL).alias("eval_text"), note(m, CLOCK).alias("clock_text")))


def made_once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """All columns and one more, behind a generator: the optimizer does not put its expression into several places, as it may a projection's."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def numbered(games: DataFrame, moves: str = "moves") -> DataFrame:
    """One row per move of an array of moves: half_move is its place in the text, whatever its number says (move_number)."""
    rest = [c for c in games.columns if c != moves]
    rows = games.select(*rest, F.posexplode(moves).alias("__place", "__move"))
    return rows.select(*rest, (F.col("__place") + 1).alias("half_move"), F.col("__move.number").alias("move_number"), "__move.move", "__move.eval_text", "__move.clock_text")


def explode_moves(games: DataFrame, section: str = "section") -> DataFrame:
    """One row per move of a section."""
    return numbered(made_once(games, section_moves(F.col(section)), "__moves").drop(section), "__moves")


def judged(games: DataFrame, keyword: str = KEYWORD) -> DataFrame:
    """Games with their tags, moves and reason to be dropped (null: kept). Only eligible games are looked through for moves, once."""
    tagged = extract_tags(games).withColumn("game_id", id_from_url(F.col("Site")))
    early = F.when(F.col("Event") == "", "no_header").when(~F.lower("Event").contains(keyword.lower()), "not_eligible").when(F.col("game_id") == "", "no_id")
    seen = made_once(tagged, F.when(early.isNull(), section_moves(move_section(F.col("game")))), "moves")
    spoilt = F.exists("moves", lambda m: (m["clock_text"].isNotNull() & clock_seconds(m["clock_text"]).isNull()) | bad_mate(m["eval_text"]))
    return seen.withColumn("reason", F.coalesce(early, F.when(F.size("moves") == 0, "no_moves").when(spoilt, "parse_failure")))


def usable_moves(seen: DataFrame) -> DataFrame:
    """The move rows of judged games that are kept."""
    usable = seen.where("reason IS NULL").select(
        "game_id",
        F.try_to_date("Date", "yyyy.MM.dd").alias("date"),
        F.col("White").alias("white"),
        F.col("Black").alias("black"),
        parse_elo(F.col("WhiteElo")).alias("white_elo"),
        parse_elo(F.col("BlackElo")).alias("black_elo"),
        F.col("TimeControl").alias("time_control"),
        F.col("Termination").alias("termination"),
        F.col("Result").alias("result"),
        "moves",
    )
    moves = numbered(usable).withColumn("eval", parse_eval(F.col("eval_text"))).withColumn("clock", clock_seconds(F.col("clock_text")))
    return moves.drop("eval_text", "clock_text")


def reject_counts(seen: DataFrame) -> DataFrame:
    """reason, n: how many judged games ended in each way."""
    return seen.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def rejects(seen: DataFrame) -> DataFrame:
    """reason, Site, game of the judged games that are dropped."""
    return seen.where("reason IS NOT NULL").select("reason", "Site", "game")


def parse_games(games: DataFrame, keyword: str = KEYWORD) -> tuple[DataFrame, DataFrame]:
    """The move rows of all usable games, and how many games ended in each way (reason, n)."""
    seen = judged(games, keyword)
    return usable_moves(seen), reject_counts(seen)


def misnumbered(moves: DataFrame) -> DataFrame:
    """Games in which a move's number disagrees with its place in the text."""
    return moves.where(F.col("move_number") != F.ceil(F.col("half_move") / 2)).select("game_id").distinct()
