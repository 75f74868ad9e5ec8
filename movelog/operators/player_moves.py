"""The player-move table: games of players joined with their moves, with flags and times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import increment_seconds, normalize_color
from ..sources.shared import kept
from .checks import Checks, strict_all


def per_game_cap(player_games: DataFrame, max_half_move: int) -> DataFrame:
    """game_id, cap: the least cutoff over a game's views, and at most max_half_move."""
    return player_games.groupBy("game_id").agg(F.least(F.min("plies_both_gt_thr"), F.lit(max_half_move)).alias("cap"))


def flag_used(rows: DataFrame, caps: DataFrame, drop_first: int) -> DataFrame:
    """is_used: after the opening and within the game's cap; no row is dropped."""
    flag = (F.col("half_move") > drop_first) & (F.col("half_move") <= F.col("cap"))
    return rows.join(caps, "game_id").withColumn("is_used", F.coalesce(flag, F.lit(False))).drop("cap")


def used_length(rows: DataFrame, legacy: bool = False) -> DataFrame:
    """game_id, used_length: half-moves with a used row; in legacy mode only games that have one."""
    counts = rows.groupBy("game_id").agg(F.countDistinct(F.when(F.col("is_used"), F.col("half_move"))).alias("used_length"))
    return counts.where("used_length > 0") if legacy else counts


def join_one_to_many(left: DataFrame, right: DataFrame, key: str, left_key: list[str], right_key: list[str], check: bool = True) -> DataFrame:
    """An inner join whose sides have unique keys of their own."""
    if check:
        strict_all(Checks(left).unique("left side", *left_key).report(), Checks(right).unique("right side", *right_key).report())
    return left.join(right, key)


def input_checks(player_games: DataFrame, moves: DataFrame) -> DataFrame:
    """what, n, samples: what is wrong with the two inputs, with one aggregate for each key of each table."""
    games = player_games.select(F.lower("player_color").alias("player_color"), "player", "game_id", "time_control", "plies_both_gt_thr", "player_elo", "opponent_elo")
    of_games = (
        Checks(games)
        .allowed("colours", "player_color", ["white", "black"])
        .numeric("numbers of player games", "plies_both_gt_thr", "player_elo", "opponent_elo")
        .row("time controls without an increment", increment_seconds(F.col("time_control")).isNull(), "game_id", "time_control")
        .unique("a game with two rows of a colour", "game_id", "player_color")
        .unique("a game with two rows of a player", "player", "game_id")
    )
    of_moves = (
        Checks(moves.select("game_id", "half_move", "clock", "clock_delta", "fen_before", "fen_after", "move_uci"))
        .numeric("numbers of moves", "half_move", "clock", "clock_delta")
        .nulls("nulls in moves", "game_id", "half_move", "fen_before", "fen_after", "move_uci")
        .unique("a half-move with two rows", "game_id", "half_move")
    )
    return of_games.report().union(of_moves.report())


def game_checks(player_games: DataFrame, moves: DataFrame, drop_first: int, max_half_move: int, min_segment: int) -> DataFrame:
    """what, n, samples: games without moves, and games with too few used half-moves, by one aggregate over both tables' games."""
    caps = per_game_cap(player_games, max_half_move)
    used = F.count_if((F.col("half_move") > drop_first) & (F.col("half_move") <= F.col("cap")))
    games = caps.join(moves.select("game_id", "half_move"), "game_id", "left").groupBy("game_id").agg(F.count("half_move").alias("moves"), used.alias("used_length"))
    return Checks(games).row("games without moves", F.col("moves") == 0, "game_id").row("short games", (F.col("moves") > 0) & (F.col("used_length") < min_segment), "game_id", "used_length").report()


def build_player_moves(player_games: DataFrame, moves: DataFrame, drop_first: int, max_half_move: int, min_segment: int, check: bool = True, save: bool = False) -> DataFrame:
    """One row per player, game and half-move: flags, clock changes and thinking times.

    moves carries move_uci, fen_before, fen_after and clock_delta. With `check`, what `input_checks` and
    `game_checks` find raises, all of it in one job; without it, it passes. `save` writes both inputs
    once before, where they are not tables yet but dear to compute.
    """
    games = player_games.select("player", "game_id", "rating_bin", "split_by_player", "split_by_games", "player_color", "player_elo", "opponent_elo", "time_control", "plies_both_gt_thr")
    each = moves.select("game_id", "half_move", "move", "move_uci", "fen_before", "fen_after", "clock", "clock_delta")
    if save:
        games, each = kept(games, "player-games"), kept(each, "annotated-moves")
    if check:
        strict_all(input_checks(games, each), game_checks(games, each, drop_first, max_half_move, min_segment))
    own = games.withColumn("player_color", normalize_color(F.col("player_color"))).drop("plies_both_gt_thr")
    rows = flag_used(join_one_to_many(own, each, "game_id", ["player", "game_id"], ["game_id", "half_move"], check=False), per_game_cap(games, max_half_move), drop_first)
    return rows.withColumn("move_thinking_time", F.col("clock_delta") + increment_seconds(F.col("time_control")))
