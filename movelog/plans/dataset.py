"""The whole dataset build: moves and parameters to players, games, moves and player games."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.games import binned, eligible, game_split_any, games_meta, perspectives, player_stats, selected_games, truncate_at_cutoff
from ..operators.sampling import Selection, attach_splits, preselect_players, sample_games, select_players, split_by_hash
from ..sources.shared import kept

# The columns of the dataset's files, in their order.
GAME_OUTPUT = ("split_by_player", "split_by_games", "game_id", "date", "white", "black", "white_elo", "black_elo", "time_control", "termination", "result", "n_plies", "plies_both_gt_thr")
PLAYER_GAME_OUTPUT = ("split_by_player", "split_by_games", "rating_bin", "player", "opponent", "player_color", "game_id", "player_elo", "opponent_elo", "avg_elo", "date", "time_control", "termination", "result", "n_plies", "plies_both_gt_thr")


@dataclass(frozen=True)
class DatasetParams:
    threshold: float = 3
    min_plies: int = 2
    min_games: int = 10
    same_bin: bool = True
    bins: tuple[int, int, int] = (1100, 2200, 100)
    selection: Selection = field(default_factory=Selection)


SMALL = DatasetParams(selection=Selection(preselect=8, candidates_factor=2, final=2, games_each=1, test_share=0.5))


@dataclass
class Dataset:
    """The steps of a build. What several steps read is written once: the game summary, eligible games, final players and sampled games."""

    moves: DataFrame
    params: DatasetParams = DatasetParams()
    meta: DataFrame | None = None

    @cached_property
    def summary(self) -> DataFrame:
        """One row per game; `meta`, where the caller has it already."""
        return self.meta if self.meta is not None else kept(games_meta(self.moves, self.params.threshold), "games-meta")

    @cached_property
    def player_games(self) -> DataFrame:
        return perspectives(self.summary)

    @cached_property
    def preselected(self) -> DataFrame:
        return preselect_players(binned(player_stats(self.player_games, self.params.min_games), *self.params.bins), self.params.selection.preselect)

    @cached_property
    def eligible(self) -> DataFrame:
        p = self.params
        return kept(eligible(self.player_games, self.preselected, p.min_plies, p.same_bin, p.bins), "eligible")

    @cached_property
    def selected(self) -> tuple[DataFrame, DataFrame]:
        """The final players, and the eligible games they may be sampled from."""
        players, pool = select_players(self.eligible, self.params.selection)
        return kept(players, "final-players"), pool

    @property
    def final(self) -> DataFrame:
        return self.selected[0]

    @property
    def pool(self) -> DataFrame:
        return self.selected[1]

    @cached_property
    def game_split(self) -> DataFrame:
        s = self.params.selection
        return split_by_hash(selected_games(self.pool), "game_id", s.test_game_share, s.game_salt)

    @cached_property
    def sampled(self) -> DataFrame:
        return kept(sample_games(attach_splits(self.pool, self.final, self.game_split), self.params.selection), "sampled")

    def players(self) -> DataFrame:
        return self.final.select(F.col("avg_bin").alias("rating_bin"), "player", "split_by_player", "avg_elo", F.col("n_games").alias("n_games_month"), F.col("n_eligible").alias("n_eligible_games"))

    def player_games_out(self) -> DataFrame:
        return self.sampled.withColumnRenamed("avg_bin", "rating_bin").select(*PLAYER_GAME_OUTPUT)

    def games(self) -> DataFrame:
        splits = game_split_any(self.sampled).join(self.sampled.select("game_id", "split_by_games").distinct(), "game_id")
        return self.summary.join(splits, "game_id").select(*GAME_OUTPUT)

    def moves_out(self) -> DataFrame:
        cutoffs = self.summary.select("game_id", F.col("plies_both_gt_thr").alias("cutoff")).join(selected_games(self.sampled), "game_id", "left_semi")
        return truncate_at_cutoff(self.moves, cutoffs)

    def tables(self) -> dict[str, DataFrame]:
        return {"players": self.players(), "games": self.games(), "moves": self.moves_out(), "player_games": self.player_games_out()}
