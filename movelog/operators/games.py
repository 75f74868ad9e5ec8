"""Moves to games, games to the two players' views, and what is kept of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rating_bin

GAME_COLUMNS = ("date", "white", "black", "white_elo", "black_elo", "time_control", "termination", "result")


def base_moves(moves: DataFrame) -> DataFrame:
    return moves.where(F.col("game_id").isNotNull() & F.col("half_move").isNotNull())


def filter_month(df: DataFrame, month: str, column: str = "date") -> DataFrame:
    """Rows of a month `YYYY-MM`, as a date range that reaches the scan."""
    first = F.lit(f"{month}-01").cast("date")
    return df.where((F.col(column) >= first) & (F.col(column) < F.add_months(first, 1)))


def filter_time_control(df: DataFrame, time_control: str) -> DataFrame:
    return df.where(F.col("time_control") == time_control)


def first_ply_where(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("half_move")))


def games_meta(moves: DataFrame, threshold: float = 3) -> DataFrame:
    """One row per game, with the last ply before either clock falls to the threshold.

    Null clocks never fall; a game without clocks keeps its full length. Of a header that differs
    between a game's rows the least value counts.

    A game's header stands in all its rows, so it is grouped by, not aggregated: the buffers of the
    aggregate over moves are numbers alone, which a hash table holds without sorting the moves. What
    is left, a row for each header of a game, is all that the second aggregate has to sort.
    """
    low = F.col("clock") <= threshold
    numbers = [F.max("half_move").alias("n_plies"), first_ply_where((F.col("half_move") % 2 == 1) & low).alias("white_ply"), first_ply_where((F.col("half_move") % 2 == 0) & low).alias("black_ply")]
    headers = moves.groupBy("game_id", *GAME_COLUMNS).agg(*numbers)
    plies = [F.max("n_plies").alias("n_plies"), F.min("white_ply").alias("first_white_leq_thr_ply"), F.min("black_ply").alias("first_black_leq_thr_ply")]
    grouped = headers.groupBy("game_id").agg(*[F.min(c).alias(c) for c in GAME_COLUMNS], *plies)
    return grouped.withColumn("plies_both_gt_thr", F.coalesce(F.least("first_white_leq_thr_ply", "first_black_leq_thr_ply") - 1, F.col("n_plies")))


def perspectives(games: DataFrame) -> DataFrame:
    """Two rows per game, as white and as black, in one pass."""
    side = lambda own, other: F.struct(
        F.col(own).alias("player"), F.col(other).alias("opponent"), F.col(f"{own}_elo").alias("player_elo"), F.col(f"{other}_elo").alias("opponent_elo"), F.lit(own).alias("player_color")
    )
    rest = [c for c in games.columns if c not in ("white", "black", "white_elo", "black_elo")]
    return games.select(*rest, F.inline(F.array(side("white", "black"), side("black", "white"))))


def player_stats(player_games: DataFrame, min_games: int = 10) -> DataFrame:
    """player, avg_elo, n_games of players with enough games."""
    return player_games.groupBy("player").agg(F.avg("player_elo").alias("avg_elo"), F.count(F.lit(1)).alias("n_games")).where(F.col("n_games") >= min_games)


def binned(stats: DataFrame, lo: int = 1100, hi: int = 2200, step: int = 100) -> DataFrame:
    return stats.withColumn("avg_bin", rating_bin(F.col("avg_elo"), lo, hi, step))


def join_players(player_games: DataFrame, players: DataFrame) -> DataFrame:
    """Games of chosen players, with their averages; the small side is broadcast if its size allows."""
    return player_games.join(players.select("player", "avg_elo", "avg_bin", "n_games"), "player")


def eligible(player_games: DataFrame, players: DataFrame, min_plies: int, same_bin: bool = True, bins: tuple[int, int, int] = (1100, 2200, 100)) -> DataFrame:
    """Games long enough, and played at a rating in the player's average bin."""
    rows = join_players(player_games.where(F.col("plies_both_gt_thr") >= min_plies), players)
    rows = rows.withColumn("player_bin", rating_bin(F.col("player_elo"), *bins))
    return rows.where(F.col("player_bin") == F.col("avg_bin")) if same_bin else rows


def enough_games(rows: DataFrame, n: int) -> DataFrame:
    """avg_bin, player, avg_elo, n_games, n_eligible of players with n eligible games at least."""
    return rows.groupBy("avg_bin", "player").agg(F.min("avg_elo").alias("avg_elo"), F.min("n_games").alias("n_games"), F.count(F.lit(1)).alias("n_eligible")).where(F.col("n_eligible") >= n)


def restrict_to_players(rows: DataFrame, players: DataFrame) -> DataFrame:
    return rows.join(players.select("avg_bin", "player"), ["avg_bin", "player"], "left_semi")


def drop_vs_selected(rows: DataFrame, pool: DataFrame) -> DataFrame:
    """Games whose opponent isn't in the pool."""
    return rows.join(pool.select(F.col("player").alias("opponent")), "opponent", "left_anti")


def selected_games(rows: DataFrame) -> DataFrame:
    return rows.select("game_id").distinct()


def game_split_any(rows: DataFrame) -> DataFrame:
    """A game is test if any of its views is."""
    return rows.groupBy("game_id").agg(F.when(F.max((F.col("split_by_player") == "test").cast("int")) == 1, "test").otherwise("train").alias("split_by_player"))


def truncate_at_cutoff(moves: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Moves of the given games up to each game's cutoff (game_id, cutoff)."""
    return moves.join(cutoffs, "game_id").where(F.col("half_move") <= F.col("cutoff")).drop("cutoff")
