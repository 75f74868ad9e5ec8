"""Batch scoring: grids of parameters, engines started once, work without duplicates, and results back in place."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.frames import map_frames, whole_frame
from ..functions.text import is_missing

#: A scorer gets a frame of inputs and returns one value per row.
Scorer = Callable[[pd.DataFrame], pd.Series]
#: Starts the scorer of a parameter, which may have a `close` method.
Start = Callable[[str], Scorer]

#: Engines that a worker keeps at one time, and those it has, the longest unused first.
KEPT_ENGINES = 4
_engines: OrderedDict[tuple[str, str], Scorer] = OrderedDict()

#: Failing inputs (and values of each column) that a worker remembers of an engine, rows of the first part that
#: an engine gets, and the attempts of a worker's engines; what is remembered is dropped with the engine.
REMEMBERED, FIRST_PART = 200_000, 1_000
_attempts: dict[tuple[str, str], Attempts] = {}


def score(df: DataFrame, inputs: list[str], scorer: Scorer, result: str = "score", kind: str = "long") -> DataFrame:
    """The inputs and the scorer's result, in Arrow batches; whole numbers stay whole beside nulls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{result: scorer(frame)})

    rows = df.select(*inputs)
    return map_frames(rows, run, StructType([*rows.schema.fields, *StructType.fromDDL(f"`{result}` {kind}").fields]))


def score_grid(df: DataFrame, keys: list[str], inputs: list[str], params: list[str], scorer: Scorer, kind: str = "long") -> DataFrame:
    """keys, param, score: every row once for each parameter; only keys and inputs go to the scorer.

    The parameters are the caller's short list, so they are exploded in place; no shuffle is needed.
    """
    grid = df.select(*dict.fromkeys([*keys, *inputs]), F.explode(F.array(*[F.lit(p) for p in params])).alias("param"))
    return score(grid, [*dict.fromkeys([*keys, *inputs]), "param"], scorer, kind=kind).select(*keys, "param", "score")


def engine(run: str, param: str, start: Start) -> Scorer:
    """This worker's engine for a parameter: started when first asked for, then kept from task to task."""
    at = (run, param)
    if at not in _engines:
        while len(_engines) >= KEPT_ENGINES:
            dropped, old = _engines.popitem(last=False)
            _attempts.pop(dropped, None)
            getattr(old, "close", lambda: None)()
        _engines[at] = start(param)
    _engines.move_to_end(at)
    return _engines[at]


def tried(scorer: Scorer, frame: pd.DataFrame, whole: bool = True) -> tuple[list, list]:
    """Results and failures of a frame's rows. A frame that fails is halved, so that only rows that fail by themselves have a failure.

    A frame of which it is known that it fails is halved without being scored (`whole` false): if the
    first half of one that failed is right, the second has the fault.
    """
    if not len(frame):
        return [], []
    if whole or len(frame) == 1:
        try:
            found = list(scorer(frame))
            if len(found) != len(frame):
                raise ValueError(f"{len(found)} results for {len(frame)} rows")
            return found, [None] * len(found)
        except Exception as e:  # noqa: BLE001 - an engine may raise anything
            if len(frame) == 1:
                return [None], [str(e) or type(e).__name__]
    half = len(frame) // 2
    first = tried(scorer, frame.iloc[:half])
    second = tried(scorer, frame.iloc[half:], any(f is not None for f in first[1]))
    return first[0] + second[0], first[1] + second[1]


class Attempts:
    """An engine's attempts at frames, and the inputs it has failed on.

    Rows that are likely to fail are tried one by one and apart from the rest, which then succeeds at
    once more often: those whose inputs have failed before, and those with a value in one column that
    has failed and never passed since. Every row is still tried: what is remembered only says in
    which company. An engine's first frames are cut into parts that double, so that what the first of
    them teach spares the others.
    """

    def __init__(self, inputs: list[str]):
        self.inputs, self.failing, self.part = inputs, set(), FIRST_PART
        self.suspect, self.cleared = {c: set() for c in inputs}, {c: set() for c in inputs}

    def marks(self, frame: pd.DataFrame) -> tuple[pd.Series, dict[str, pd.Series]] | None:
        """Hashes of the rows' inputs, together and by column; None where they cannot be hashed."""
        try:
            return pd.util.hash_pandas_object(frame[self.inputs], index=False), {c: pd.util.hash_pandas_object(frame[c], index=False) for c in self.inputs}
        except TypeError:
            return None

    def learn(self, whole: pd.Series, by_column: dict[str, pd.Series], failed: np.ndarray) -> None:
        """A value of a column is suspect while it has failed only; one that has passed is so never again."""
        if failed.any() and len(self.failing) < REMEMBERED:
            self.failing.update(whole[failed])
        for c, values in by_column.items():
            if failed.any() and len(self.suspect[c]) < REMEMBERED:
                self.suspect[c].update(set(values[failed]) - self.cleared[c])
            if passed := self.suspect[c].intersection(values[~failed]):
                self.suspect[c] -= passed
                self.cleared[c] |= passed if len(self.cleared[c]) < REMEMBERED else set()

    def __call__(self, scorer: Scorer, frame: pd.DataFrame) -> tuple[list, list]:
        found, failed, at = [], [], 0
        while at < len(frame):
            values, faults = self.attempt(scorer, frame.iloc[at : at + self.part])
            at, self.part = at + self.part, 2 * self.part
            found += values
            failed += faults
        return found, failed

    def attempt(self, scorer: Scorer, frame: pd.DataFrame) -> tuple[list, list]:
        if (marks := self.marks(frame)) is None:
            return tried(scorer, frame)
        whole, by_column = marks
        apart = whole.isin(self.failing).to_numpy()
        for c, values in by_column.items():
            apart |= values.isin(self.suspect[c]).to_numpy()
        rest = np.flatnonzero(~apart)
        values, faults = tried(scorer, frame.iloc[rest] if len(rest) < len(frame) else frame)
        if len(rest) == len(frame):
            found, failed = values, faults
        else:
            found, failed = [None] * len(frame), [None] * len(frame)
            for place, value, fault in zip(rest.tolist(), values, faults, strict=True):
                found[place], failed[place] = value, fault
            places = np.flatnonzero(apart)
            few = frame.iloc[places]  # single rows are cut from a small frame
            for k, place in enumerate(places.tolist()):
                (found[place],), (failed[place],) = tried(scorer, few.iloc[k : k + 1])
        self.learn(whole, by_column, np.array([f is not None for f in failed]))
        return found, failed


def score_with_engines(df: DataFrame, keys: list[str], inputs: list[str], params: list[str], start: Start, kind: str = "long", tasks_each: int | None = None) -> DataFrame:
    """keys, param, score, failure: every row once for each parameter, by engines that are dear to start.

    Work is dealt by parameter: each task has rows of one parameter only, in `tasks_each` tasks for each
    (by default the share of all cores or of all shuffle partitions, whichever is more), and each worker
    starts an engine once for a parameter. Rows that an engine fails on have a null score and the
    failure's text; the rest of their batch is scored.
    """
    run, spark = uuid.uuid4().hex, df.sparkSession
    parallel = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = tasks_each or max(1, -(-parallel // max(len(params), 1)))
    wanted = [*dict.fromkeys([*keys, *inputs])]
    grid = df.select(*wanted, F.posexplode(F.array(*[F.lit(p) for p in params])).alias("__place", "param"))
    task = (F.col("__place") * each + F.pmod(F.xxhash64(*keys), F.lit(each))).cast("int")
    dealt = grid.withColumn("__task", task).repartitionById(max(len(params) * each, 1), "__task").drop("__place", "__task")

    out = dealt.select(*keys, "param")
    schema = StructType([*out.schema.fields, *StructType.fromDDL(f"score {kind}, failure string").fields])
    wanted_arrow, passed = to_arrow_schema(schema), out.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = whole_frame(batch)
            (param,) = set(frame["param"])  # a task has one
            found, failed = _attempts.setdefault((run, param), Attempts(inputs))(engine(run, param, start), frame)
            made = [pa.array(pd.Series(x, dtype=object), f.type, from_pandas=True) for x, f in zip((found, failed), list(wanted_arrow)[-2:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).cast(wanted_arrow.field(c).type) for c in passed], *made], schema=wanted_arrow)

    return dealt.mapInArrow(scored, schema)


def widen_scores(long: DataFrame, keys: list[str], params: list[str], prefix: str) -> DataFrame:
    """One column `<prefix>_<param>` for each parameter, which are given, so no job looks for them."""
    wide = long.groupBy(*keys).pivot("param", params).agg(F.first("score"))
    return wide.select(*keys, *[F.col(f"`{p}`").alias(f"{prefix}_{p}") for p in params])


def score_where(df: DataFrame, mask: Column, keys: list[str], inputs: list[str], scorer: Scorer, name: str = "score") -> DataFrame:
    """The scorer's result in the rows of the mask with a whole key, null in the others; rows stay where they are."""
    wanted = [*dict.fromkeys([*keys, *inputs])]
    known = [F.col(k).isNotNull() for k in keys]
    marked = df.withColumn("__scored", F.coalesce(reduce(Column.__and__, known, mask), F.lit(False)))
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"`{name}` long").fields])
    arrow, own = to_arrow_schema(schema), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.flatnonzero(batch.column("__scored").to_numpy(zero_copy_only=False))
            values = np.full(batch.num_rows, None, object)
            if len(hit):
                values[hit] = list(scorer(whole_frame(batch.select(wanted).take(pa.array(hit)))))
            made = pa.array(values, arrow.field(name).type, from_pandas=True)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).cast(arrow.field(c).type) for c in own], made], schema=arrow)

    return marked.mapInArrow(run, schema)


def long_states(df: DataFrame, keys: list[str], columns: list[str], sentinels: tuple[str, ...] = ("", "none", "nan")) -> DataFrame:
    """keys, source_col, state of all filled cells."""
    return df.unpivot(keys, columns, "source_col", "state").where(~is_missing(F.col("state"), sentinels))


def dedup_score_scatter(df: DataFrame, keys: list[str], columns: list[str], extra: list[str], scorer: Scorer, within: list[str] | None = None, sentinels: tuple[str, ...] = ("", "none", "nan")) -> DataFrame:
    """keys, source_col, state, score: each distinct (state, extra) is scored once, whole corpus over.

    `within` adds columns to that key, such as the row's own, for scorers that see more than the state.
    """
    cells = long_states(df, [*dict.fromkeys([*keys, *extra])], columns, sentinels)
    work = [*dict.fromkeys([*(within or []), "state", *extra])]
    scored = score(cells.select(*work).distinct(), work, scorer)
    right = scored.select(*[F.col(c).alias(f"__{c}") for c in work], "score")
    same = [cells[c].eqNullSafe(right[f"__{c}"]) for c in work]
    return cells.join(right, same).select(*keys, "source_col", "state", "score")


def dedup_stats(df: DataFrame, keys: list[str], columns: list[str], extra: list[str]) -> DataFrame:
    """n_cells, n_used, n_unique: what scoring each distinct input once saves."""
    cells = df.unpivot([*dict.fromkeys([*keys, *extra])], columns, "source_col", "state")
    filled = ~is_missing(F.col("state"))
    return cells.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(filled).alias("n_used"), F.count_distinct(F.when(filled, F.struct("state", *extra))).alias("n_unique"))


def fill_with_report(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Nulls of a column to 0, and how many there were."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(0))), df.agg(F.count_if(F.col(column).isNull()).alias("n_filled"))


def early_missing(df: DataFrame, column: str, until: int = 20) -> DataFrame:
    """Rows without a state after the opening, where it must be there."""
    return df.where(is_missing(F.col(column), ("",)) & (F.col("half_move") > until))


def evaluate_missing(df: DataFrame, keys: list[str], mask: Column, scorer: Scorer, prefix: str = "fen_", made: str = "eval_") -> DataFrame:
    """Adds `eval_<x>` for each `fen_<x>` without one, in the rows of the mask; other columns stay."""
    columns = [c for c in df.columns if c.startswith(prefix) and made + c.removeprefix(prefix) not in df.columns]
    if not columns:
        return df
    scores = dedup_score_scatter(df.where(mask), keys, columns, [], scorer, sentinels=("",)).withColumnRenamed("source_col", "param")
    wide = scores.groupBy(*keys).pivot("param", columns).agg(F.first("score"))
    wide = wide.select(*keys, *[F.col(f"`{c}`").cast("int").alias(made + c.removeprefix(prefix)) for c in columns])
    return df.join(wide, keys, "left")


class ScoreStore:
    """Scores that are kept between runs: what has been scored once, by its key and parameter, is never scored again.

    Every run writes one new folder of Parquet, partitioned by parameter, and then its name into the
    manifest. Only folders of the manifest are read, so a run that dies halfway leaves nothing behind
    that counts; the folder names are new each time, so that nothing is overwritten.
    """

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], kind: str = "long"):
        """keys: the columns that a score depends on, and their types."""
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.schema = ", ".join(f"`{name}` {of}" for name, of in keys.items()) + f", score {kind}, param string"

    def runs(self) -> list[str]:
        """The names of all runs that are committed."""
        try:
            found = self.spark.read.schema("run string").json(f"{self.path}/manifest/*")
        except AnalysisException:  # no run yet
            return []
        return sorted({r["run"] for r in found.collect()})

    def stored(self) -> DataFrame:
        """keys, param, score of everything committed."""
        folders = [f"{self.path}/scores/{run}" for run in self.runs()]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return reduce(DataFrame.unionByName, [self.spark.read.schema(self.schema).parquet(folder) for folder in folders])

    def missing(self, work: DataFrame, params: list[str]) -> DataFrame:
        """keys, param: the distinct work that is not stored yet; null is a value like any other."""
        wanted = work.select(*self.keys).distinct().select("*", F.explode(F.array(*[F.lit(p) for p in params])).alias("param"))
        known = self.stored().select(*[F.col(c).alias(f"__{c}") for c in (*self.keys, "param")])
        return wanted.join(known, [wanted[c].eqNullSafe(known[f"__{c}"]) for c in (*self.keys, "param")], "left_anti")

    def add(self, work: DataFrame, params: list[str], scorer: Scorer) -> int:
        """Scores what is missing and commits it; gives how many scores are new. The scorer sees keys and param."""
        run = uuid.uuid4().hex
        folder = f"{self.path}/scores/{run}"
        score(self.missing(work, params), [*self.keys, "param"], scorer).select(*self.keys, "score", "param").write.partitionBy("param").parquet(folder)
        added = self.spark.read.schema(self.schema).parquet(folder).count()
        if added:
            self.spark.createDataFrame([(run,)], "run string").write.json(f"{self.path}/manifest/{run}")
        return added

    def scattered(self, cells: DataFrame) -> DataFrame:
        """The cells with each of their scores: a row for each cell and parameter that is stored."""
        known = self.stored().select(*[F.col(c).alias(f"__{c}") for c in self.keys], "param", "score")
        return cells.join(known, [cells[c].eqNullSafe(known[f"__{c}"]) for c in self.keys]).drop(*[f"__{c}" for c in self.keys])


def evaluate_stored(df: DataFrame, keys: list[str], mask: Column, scorer: Scorer, store: ScoreStore, prefix: str = "fen_", made: str = "eval_") -> tuple[DataFrame, int]:
    """As `evaluate_missing`, with a store: adds or fills `eval_<x>` of each `fen_<x>` in the rows of the mask; also how many states were new.

    Values that are there stay. Only states without a value that the store has never seen are scored,
    so that a table that has grown costs what it has grown by. The store's key is `state`.
    """
    columns = [c for c in df.columns if c.startswith(prefix)]
    names = {c: made + c.removeprefix(prefix) for c in columns}
    open_cells = F.array(*[F.struct(F.lit(c).alias("source_col"), F.when(F.col(names[c]).isNull() if names[c] in df.columns else F.lit(True), F.col(c)).alias("state")) for c in columns])
    cells = df.where(mask).select(*keys, F.inline(open_cells)).where(~is_missing(F.col("state"), ("",)))
    added = store.add(cells, ["eval"], scorer)
    wide = store.scattered(cells).groupBy(*keys).pivot("source_col", columns).agg(F.first("score"))
    wide = wide.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(f"`{c}`").cast("int").alias(f"__{names[c]}") for c in columns])
    out = df.join(wide, [df[k].eqNullSafe(wide[f"__{k}"]) for k in keys], "left")
    filled = [F.coalesce(*([F.col(names[c])] if names[c] in df.columns else []), F.col(f"__{names[c]}")).alias(names[c]) for c in columns]
    return out.select(*[c for c in df.columns if c not in names.values()], *filled), added
