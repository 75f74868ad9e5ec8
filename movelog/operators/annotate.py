"""Moves with the states before and after them: the caller's rules carried through every game."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..functions.frames import map_frames, plain_rows
from .checks import Checks, strict_all

#: Of a state and a move, gives the move in coordinate notation and the next state; raises if the move is not allowed.
Rules = Callable[[str, str], tuple[str, str]]


def order_checks(moves: DataFrame) -> DataFrame:
    """what, n, samples: doubled half-moves, and games whose half-moves do not run from 1 to their count."""
    rows = Checks(moves.select("game_id", "half_move")).nulls("half-moves without a number", "game_id", "half_move").unique("doubled half-moves", "game_id", "half_move")
    return rows.contiguous("games with gaps", ["game_id"], "half_move").report()


def annotate_moves(moves: DataFrame, start: str, rules: Rules, check: bool = True) -> DataFrame:
    """All columns, and move_uci, fen_before, fen_after, clock_delta and failure.

    clock_delta is the mover's clock two half-moves before less this one, 0 where either is null. A move
    that the rules refuse has its failure's text; it and the rest of its game have no states. Games are
    streams: one shuffle by game, and no game is held whole. With `check`, doubled half-moves and gaps raise.
    """
    if check:
        strict_all(order_checks(moves))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        game, state, clocks = object(), start, (None, None)
        for frame in frames:
            rows = plain_rows(frame[["game_id", "move", "clock"]])
            made: list[tuple] = []
            for row in rows:
                if row["game_id"] != game:
                    game, state, clocks = row["game_id"], start, (None, None)
                before, uci, failure = state, None, None
                if state is not None:
                    try:
                        uci, state = rules(state, row["move"])
                    except Exception as e:  # noqa: BLE001 - the caller's rules may raise anything
                        state, failure = None, str(e) or type(e).__name__
                delta = 0.0 if row["clock"] is None or clocks[0] is None else clocks[0] - row["clock"]
                clocks = (clocks[1], row["clock"])
                made.append((uci, before if state is not None else None, state, delta, failure))
            columns = zip(("move_uci", "fen_before", "fen_after", "clock_delta", "failure"), zip(*made, strict=True), strict=True) if made else ()
            yield frame.assign(**{name: pd.Series(values, frame.index, object) for name, values in columns})

    ordered = moves.repartition("game_id").sortWithinPartitions("game_id", "half_move")
    added = StructType.fromDDL("move_uci string, fen_before string, fen_after string, clock_delta double, failure string")
    return map_frames(ordered, run, StructType([*moves.schema.fields, *added.fields]))
