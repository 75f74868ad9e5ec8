"""Repeatable samples and splits: hashed orders within strata, never random state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_bucket, hash_order
from .games import drop_vs_selected, enough_games, restrict_to_players


@dataclass(frozen=True)
class Selection:
    """Sizes and salts of a selection. A test share is of the configured size, rounded half to even."""

    preselect: int = 50
    candidates_factor: int = 2
    final: int = 10
    games_each: int = 3
    test_share: float = 0.2
    test_game_share: float = 0.3
    player_salt: str = "players"
    game_salt: str = "games"
    drop_vs_selected: bool = True

    @property
    def test_players(self) -> int:
        return round(self.final * self.test_share)


#: The hexadecimal digits of a digest that make its slice: a stratum falls into 65,536 slices.
SLICE_DIGITS = 4


def rank_in(by: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def cut_top_n(df: DataFrame, by: list[str], key: str, n: int, salt: str) -> DataFrame:
    """n rows of each stratum by the hash of the key and then the key, for any n; no stratum is sorted, joined or held whole.

    Rows are counted by stratum and slice of the hash, in every task before anything is shuffled. The
    counts of a stratum, one for each slice, tell how many rows each slice gives: all of them before the
    slice of the n-th row, some of that one. Rows of slices past every stratum's last do not move; the
    others meet their slice's number by stratum and slice, and each slice is ranked on its own.
    """
    # Null keys come first, as in the order itself.
    place = lambda: F.coalesce(F.conv(F.substring(hash_order(salt, F.col(key)), 1, SLICE_DIGITS), 16, 10).cast("int"), F.lit(-1))
    upto = F.sum("__rows").over(Window.partitionBy(*by).orderBy("__slice"))
    counts = df.select(*by, place().alias("__slice")).groupBy(*by, "__slice").agg(F.count(F.lit(1)).alias("__rows")).withColumn("__left", F.lit(n) - upto + F.col("__rows"))
    wanted = counts.where("__left > 0").select(*[F.col(c).alias(f"__of_{c}") for c in by], F.col("__slice").alias("__of_slice"), "__left")
    last = wanted.agg(F.max("__of_slice").alias("__last"))  # one row
    rows = df.withColumn("__slice", place()).join(F.broadcast(last), F.col("__slice") <= F.col("__last"))
    same = [F.col("__slice") == F.col("__of_slice"), *[F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by]]
    ranked = rows.join(wanted, same).withColumn("__rank", rank_in([*by, "__slice"], hash_order(salt, F.col(key)), F.col(key)))
    return ranked.where("__rank <= __left").select(*df.columns)


def hash_top_n(df: DataFrame, by: list[str], key: str, n: int, salt: str) -> DataFrame:
    """n rows of each stratum, by the hash of the key and then the key.

    Up to spark.sql.optimizer.windowGroupLimitThreshold Spark itself keeps the best n of each task
    before it shuffles; a larger n is cut by counts.
    """
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        return cut_top_n(df, by, key, n, salt)
    return df.withColumn("__rank", rank_in(by, hash_order(salt, F.col(key)), F.col(key))).where(F.col("__rank") <= n).drop("__rank")


def split_fixed_count(df: DataFrame, by: list[str], key: str, n_test: int, salt: str, name: str = "split_by_player") -> DataFrame:
    """The first n_test of each stratum are test, the others train."""
    return df.withColumn(name, F.when(rank_in(by, hash_order(salt, F.col(key)), F.col(key)) <= n_test, "test").otherwise("train"))


def split_by_hash(df: DataFrame, key: str, share: float, salt: str, name: str = "split_by_games") -> DataFrame:
    """Rows whose key falls into the first share of a million buckets are test."""
    bucket = hash_bucket(F.concat(F.col(key), F.lit(salt)))
    return df.withColumn(name, F.when(bucket < int(share * 1_000_000), "test").otherwise("train"))


def sample_per_group(df: DataFrame, by: list[str], keys: tuple[str, ...], n: int) -> DataFrame:
    """n rows of each group, by the hash of the joined keys."""
    order = F.md5(F.concat(*[F.col(k) for k in keys]))
    return df.withColumn("__rank", rank_in(by, order, *[F.col(k) for k in keys])).where(F.col("__rank") <= n).drop("__rank")


def preselect_players(binned: DataFrame, n: int) -> DataFrame:
    return hash_top_n(binned, ["avg_bin"], "player", n, "")


def candidate_players(rows: DataFrame, s: Selection) -> DataFrame:
    return hash_top_n(enough_games(rows, s.games_each), ["avg_bin"], "player", s.final * s.candidates_factor, f"{s.player_salt}:candidate:")


def final_players(rows: DataFrame, s: Selection) -> DataFrame:
    chosen = hash_top_n(enough_games(rows, s.games_each), ["avg_bin"], "player", s.final, f"{s.player_salt}:final:")
    return split_fixed_count(chosen, ["avg_bin"], "player", s.test_players, f"{s.player_salt}:test:")


def select_players(rows: DataFrame, s: Selection) -> tuple[DataFrame, DataFrame]:
    """The final players with their split, and the eligible games they may be sampled from.

    Under the opponent rule, games against anyone of the candidate pool go before the players are
    chosen; the pool, not the final choice, decides.
    """
    if s.drop_vs_selected:
        pool = candidate_players(rows, s)
        rows = drop_vs_selected(restrict_to_players(rows, pool), pool)
    players = final_players(rows, s)
    return players, restrict_to_players(rows, players)


def attach_splits(rows: DataFrame, players: DataFrame, games: DataFrame) -> DataFrame:
    """Game rows with both splits and the player's counts."""
    own = players.select("avg_bin", "player", "split_by_player", "n_eligible")
    return rows.join(own, ["avg_bin", "player"]).join(games.select("game_id", "split_by_games"), "game_id")


def sample_games(rows: DataFrame, s: Selection) -> DataFrame:
    return sample_per_group(rows, ["avg_bin", "player"], ("game_id", "player"), s.games_each)
