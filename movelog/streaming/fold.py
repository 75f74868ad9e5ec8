"""An ordered fold over a stream: the state of every game is carried from batch to batch and from run to run."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

#: Types whose values travel as text, and what reads them.
NUMBERS = {"byte": int, "short": int, "integer": int, "long": int, "float": float, "double": float}
#: Keyed state with timers is kept by this provider.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of a stream that share a value of the state are those of one of so many buckets.
BUCKETS = 1024


class OrderedFold(StatefulProcessor):
    """Folds the rows of a bucket of games, each game in the order of its numbers, whenever they come.

    A row is folded as soon as all rows before it were; until then it waits in the state. If nothing
    comes for a game while the stream's arrivals move on by `patience` milliseconds, a timer gives it up as
    abandoned: what waits is folded in order over the gap. A row whose number has been passed is late:
    it comes out with null states.

    A state call costs Python some tenths of a millisecond, so the games of a bucket share one value: for each
    game its next number, its state, the rows that wait by number, and when it is given up.
    """

    def __init__(self, schema: StructType, out: StructType, order: str, first: int, start: Any, step: Callable[[Any, dict], Any], patience: int):
        self.schema, self.out, self.order, self.first, self.start, self.step, self.patience = schema, out, order, first, start, step, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.games = handle.getValueState("games", "pickled binary")

    def standing(self) -> dict[str, tuple[int, Any, dict[int, tuple], int]]:
        """The games of the bucket: next number, state, waiting rows and time of giving up."""
        held = self.games.get()
        return pickle.loads(held[0]) if held else {}

    @staticmethod
    def read(values: pd.Series, of: StructField) -> list:
        """The values of a column that came in; numbers came as text, what is neither number nor text in a struct."""
        kind, values = of.dataType.typeName(), values.tolist()
        if kind in NUMBERS:
            return [value if value is None else NUMBERS[kind](value) for value in values]
        return values if kind == "string" else [value[of.name] for value in values]

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        """Rows as a frame in which whole numbers stay whole."""
        return pd.DataFrame({f.name: pd.Series([r[k] for r in rows], dtype="Int64" if NUMBERS.get(f.dataType.typeName()) is int else object) for k, f in enumerate(self.out.fields)})

    def folded(self, rows: list[tuple], place: int, state: Any) -> tuple[list[tuple], int, Any]:
        """Folds rows with their numbers; gives them with their states, the next number and the state after."""
        out = []
        for number, row in rows:
            after = self.step(state, dict(zip(self.schema.names, row, strict=True)))
            out.append((*row, state, after, False))
            place, state = number + 1, after
        return out, place, state

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        games, came, arrived = self.standing(), {}, 0
        at = self.schema.names.index(self.order)
        for frame in rows:
            arrived = max(arrived, int(frame["arrival"].max().timestamp() * 1000))
            columns = [self.read(frame[f"c{k}"], f) for k, f in enumerate(self.schema.fields)]
            for game, row in zip(frame["key"].tolist(), zip(*columns, strict=True), strict=True):
                came.setdefault(game, []).append(row)
        out, left = [], False
        for game, values in came.items():
            place, state, waiting, _ = games.get(game) or (self.first, self.start, {}, 0)
            for row in values:
                if row[at] is None or row[at] < place or row[at] in waiting:
                    out.append((*row, None, None, True))
                else:
                    waiting[row[at]] = row
            ready = []
            while (number := place + len(ready)) in waiting:
                ready.append((number, waiting.pop(number)))
            done, place, state = self.folded(ready, place, state)
            games[game] = place, state, waiting, arrived + self.patience
            left = left or bool(waiting)
            out += done
        self.games.update((pickle.dumps(games, pickle.HIGHEST_PROTOCOL),))
        if left:
            self.handle.registerTimer(arrived + self.patience)
        if out:
            yield self.frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Gives up the games that wait since then; those that rows have come for have a later time, and a timer of their own."""
        games, out = self.standing(), []
        for game, (place, state, waiting, until) in games.items():
            if waiting and until <= expiredTimerInfo.getExpiryTimeInMs():
                done, place, state = self.folded(sorted(waiting.items()), place, state)
                games[game] = place, state, {}, until
                out += done
        if out:
            self.games.update((pickle.dumps(games, pickle.HIGHEST_PROTOCOL),))
            yield self.frame(out)

    def close(self) -> None:
        pass


def fold_stream(
    rows: DataFrame, keys: list[str], order: str, start: Any, step: Callable[[Any, dict], Any], state_type: str = "string", first: int = 1, patience: int = 3_600_000, buckets: int = BUCKETS
) -> DataFrame:
    """All columns, state_before, state_after and late, of a stream of rows numbered from `first` within each group.

    Whatever order files come in and however many runs read them, rows have the states that the batch
    fold gives them. A number that comes twice counts the first time; the other row is late. Groups are
    dealt into `buckets` by a hash; a task holds one bucket, so streams of very many groups should have more.
    A checkpoint goes on with the number that it began with.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    states = StructType.fromDDL(f"state_before {state_type}, state_after {state_type}")
    out = StructType([*rows.schema.fields, *states.fields, StructField("late", BooleanType())])
    fold = OrderedFold(rows.schema, out, order, first, start, step, patience)
    # Numbers travel as text, as a null beside them would make floats of them, and what pandas has types of its own for as structs; the watermark follows the rows' arrival.
    sent = {"string": F.col, **dict.fromkeys(NUMBERS, lambda c: F.col(c).cast("string"))}
    columns = [sent.get(f.dataType.typeName(), F.struct)(f"`{f.name}`").alias(f"c{k}") for k, f in enumerate(rows.schema.fields)]
    came = rows.select(F.to_json(F.struct(*keys)).alias("key"), *columns, F.current_timestamp().alias("arrival")).withWatermark("arrival", "0 seconds")
    dealt = came.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(statefulProcessor=fold, outputStructType=out, outputMode="append", timeMode="EventTime")
