"""The featurise job: every distinct state scored once, its vector sent to every place it came from, and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_missing
from ..operators.merge import fill_stats
from ..operators.scoring import Scorer, score
from ..sources.shared import kept
from ..sources.tables import write_embeddings


@dataclass(frozen=True)
class Features:
    """What a featurise job leaves: vectors (keys, source_col, vec), filled (source_col, n_rows, n_filled) and totals, which is one row."""

    vectors: DataFrame
    filled: DataFrame
    totals: DataFrame


def featurise(df: DataFrame, keys: list[str], prefix: str, extras: list[str], scorer: Scorer, path: str, sentinels: tuple[str, ...] = ("", "none", "nan")) -> Features:
    """Vectors of all columns by prefix, written under `path` and partitioned by the column they are of.

    The scorer gets each distinct (state, extras) of the whole table once and gives vectors. Missing
    states have null vectors; a null in an extra column, such as the opponent's rating, counts 0. The
    scored states are written before they are joined, so that a state that fills a third of all cells
    is a skewed join of two exchanges, which Spark splits. totals: n_cells, n_used, n_unique, n_filled_extras.
    """
    columns = [c for c in df.columns if c.startswith(prefix)]
    rows = df.select(*keys, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in extras], *columns)
    cells = rows.unpivot([*dict.fromkeys([*keys, *extras])], columns, "source_col", "state")
    used = ~is_missing(F.col("state"), sentinels)
    work = ["state", *extras]
    scored = kept(score(cells.where(used).select(*work).distinct(), work, scorer, "vec", "array<float>"), "scored-states")
    known = scored.select(*[F.col(c).alias(f"__{c}") for c in work], "vec")
    placed = cells.join(known, [cells[c] == known[f"__{c}"] for c in work], "left")
    write_embeddings(placed.select(*keys, "source_col", "vec"), path)
    vectors = df.sparkSession.read.parquet(path)
    counts = cells.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(used).alias("n_used"))
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in extras]) if extras else df.agg(F.lit(0).alias("none"))
    totals = counts.join(scored.agg(F.count(F.lit(1)).alias("n_unique")), F.lit(True)).join(gaps.select(sum((F.col(c) for c in gaps.columns), F.lit(0)).cast("long").alias("n_filled_extras")), F.lit(True))
    return Features(vectors, fill_stats(vectors), totals)
