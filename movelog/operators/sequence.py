"""Ordered work within games: lags, prefixes, windows of evaluation, carried states."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.frames import map_frames, plain_rows

GAME = ("player", "game_id")


def clock_delta(moves: DataFrame, keys: tuple[str, ...] = ("game_id",)) -> DataFrame:
    """clock_delta: the mover's clock two half-moves before, less this one; 0 where either is null."""
    before = F.lag("clock", 2).over(Window.partitionBy(*keys).orderBy("half_move"))
    return moves.withColumn("clock_delta", F.coalesce(before - F.col("clock"), F.lit(0.0)))


def in_eval_window(place: Column, color: Column, opening: int) -> Column:
    """Every second half-move after the opening, from the first at which the player moves; place counts from 0."""
    start = opening + F.when(color == "white", 0).otherwise(1)
    return (place >= start) & ((place - start) % 2 == 0)


def eval_window(moves: DataFrame, opening: int, keys: tuple[str, ...] = GAME) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("half_move")) - 1
    return moves.withColumn("__place", place).where(in_eval_window(F.col("__place"), F.col("player_color"), opening)).drop("__place")


def count_positions(moves: DataFrame, opening: int, keys: tuple[str, ...] = GAME) -> DataFrame:
    """n_positions per game that eval_window would give, from the counts alone."""
    sizes = moves.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("player_color").alias("player_color"))
    left = F.col("n") - opening - F.when(F.col("player_color") == "white", 0).otherwise(1)
    return sizes.select(*keys, F.greatest(F.lit(0), F.ceil(left / 2)).cast("long").alias("n_positions"))


def prefixes(moves: DataFrame, columns: dict[str, str], opening: int, keys: tuple[str, ...] = GAME, current: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the evaluation window with arrays of what came before: column -> name of its array.

    Columns in `current` include the row itself. One array per game is built, and each row of the
    window takes its slice, so the bytes that are shuffled grow with the game, not with its square.
    Only the places of the window are exploded.
    """
    rest = [c for c in moves.columns if c not in keys]
    rows = moves.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("half_move", *[c for c in rest if c != "half_move"]))).alias("__rows"))
    n = F.size("__rows")
    places = F.filter(F.sequence(F.lit(0), n - 1), lambda p: in_eval_window(p, F.get("__rows", p)["player_color"], opening))
    each = rows.where(n > 0).select(*keys, "__rows", F.explode(places).alias("__place")).withColumn("__row", F.get("__rows", F.col("__place")))

    def before(c: str, name: str) -> Column:
        return F.transform(F.slice("__rows", 1, F.col("__place") + (1 if c in current else 0)), lambda r: r[c]).alias(name)

    out = [before(c, name) for c, name in columns.items()]
    return each.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest], *out)


def prefix_with_candidate(rows: DataFrame, prefix: str, candidate: str, name: str) -> DataFrame:
    """The prefix followed by another last action; null without one."""
    return rows.withColumn(name, F.when(F.col(candidate).isNotNull(), F.concat(F.col(prefix), F.array(candidate))))


def folded(rows: Iterable[dict], state: Any, step: Callable[[Any, dict], Any]) -> tuple[list, list, Any]:
    """The states before and after each row, and the last one."""
    before, after = [], []
    for row in rows:
        before.append(state)
        state = step(state, row)
        after.append(state)
    return before, after, state


def ordered_fold(df: DataFrame, keys: list[str], order: str, init: Any, step: Callable[[Any, dict], Any], state_type: str = "string") -> DataFrame:
    """All columns, and the state before and after each row; `step(state, row)` gives the next state.

    Groups are streams: rows come sorted by keys and order, and the state is carried from one batch
    to the next, so that no group is held whole. Steps see Python values: whole numbers are never
    floats, and a null is None. Where the step can be said as a column, `sql_fold` does the same without Python.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, init
        for frame in frames:
            before, after = [], []
            for key, rows in groupby(plain_rows(frame), lambda row: [row[k] for k in keys]):
                if key != now:
                    now, state = key, init
                one, other, state = folded(rows, state, step)
                before += one
                after += other
            yield frame.assign(state_before=pd.Series(before, frame.index, object), state_after=pd.Series(after, frame.index, object))

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, F.col(order).asc_nulls_last())
    return map_frames(ordered, fold, StructType([*df.schema.fields, *StructType.fromDDL(f"state_before {state_type}, state_after {state_type}").fields]))


def sql_fold(df: DataFrame, keys: list[str], order: str, value: str, init: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """The same for a step that is a column expression of the state and one value.

    A game's rows become one array, and one aggregate over it appends a state for each row, so that
    every step is taken once.
    """
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("__rows"))
    states = F.aggregate("__rows", F.array(init), lambda s, r: F.concat(s, F.array(step(F.element_at(s, -1), r[value]))))
    at = rows.select(*keys, "__rows", states.alias("__states")).select(*keys, "__states", F.posexplode("__rows").alias("__place", "__row"))
    row = [F.col(f"__row.{order}").alias(order), F.col(f"__row.{value}").alias(value)]
    return at.select(*keys, *row, F.get("__states", F.col("__place")).alias("state_before"), F.get("__states", F.col("__place") + 1).alias("state_after"))


def successor_state(df: DataFrame, state: str, action: str, step: Callable[[str, str], str], name: str = "state_after") -> DataFrame:
    """The state after the action, or null and the failure's text; null actions give neither.

    Whatever a step raises is that row's failure, by its text or, if it has none, by its kind.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            after, failure = [], []
            for row in plain_rows(frame[[*dict.fromkeys((state, action))]]):
                try:
                    after.append(None if row[action] is None else step(row[state], row[action]))
                    failure.append(None)
                except Exception as e:  # noqa: BLE001 - the caller's rules may raise anything
                    after.append(None)
                    failure.append(str(e) or type(e).__name__)
            yield frame.assign(**{name: pd.Series(after, frame.index, object), "failure": pd.Series(failure, frame.index, object)})

    return map_frames(df, run, StructType([*df.schema.fields, *StructType.fromDDL(f"`{name}` string, failure string").fields]))
