"""Mixing sources to target weights by Pfair scheduling.

The texts of a source, in a hashed order, are cut into blocks of BLOCK_CHARS characters, and each
slot of the mix takes one block. With weight w, block i of a source may not start before slot
floor(i / w) and has to be done by slot ceil((i + 1) / w); the earliest deadline goes first. Then
at every slot each source has had its weight's share to within less than one block.

Weights are exact fractions and there is no period. One task deals out the slots, a row for each
block of the mix and not for each text; it holds one block of each source, so any number of sources
works, and a corpus has MAX_BLOCKS blocks at most, which are larger for larger ones. Texts then look
up the slots of their blocks. A source that ends before the others may start over (another epoch), so
that the mix keeps its weights, EPOCHS times in all at most; `mix` gives each row once unless it is
told otherwise. Until a source leaves, all shares hold; then those of the others to each other do.

Running sizes within a source come from sums over SUBS hash ranges of it, so a hot source is spread
over as many tasks. Whole rows move twice: by hash range, where they also meet the slots, and into the order of the mix. Weights that are not positive and finite are refused.

Defined results: a null source is a source of its own; null or empty texts take no room and stay;
rows that repeat a doc_id are placed one after another; an empty table gives no rows; extra columns
are kept by `mix` and ignored by `schedule`.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

BLOCK_CHARS = 20_000
#: Blocks of a corpus at most: for larger ones, blocks grow, so that the dealing task does not.
MAX_BLOCKS = 2_000_000
#: How often a source that ends before the others may come in all.
EPOCHS = 4
SUBS = 4_096
#: Slots that the dealing task gives out at one time.
DEALT_ROWS = 50_000
#: Target weights are the sources' shares of characters to this power: a hot source weighs less.
TEMPER = 0.8


def dealt(sources: Iterable[tuple[str | None, float, int]], epochs: int = EPOCHS) -> Iterator[tuple]:
    """source, block, epoch, slot, release, deadline of every block of the mix, in order of slots.

    sources: name, weight and number of blocks of each. The mix ends when the last source has had
    all its blocks. A source leaves after so many epochs, and its slots stay empty from then on. In
    whole numbers: with weights w / total, block i has the window from i * total // w to
    -(-(i + 1) * total // w).
    """
    rows = sorted(sources, key=lambda r: (r[0] is not None, r[0] or ""))
    for name, weight, _ in rows:
        if not 0 < weight < float("inf"):
            raise ValueError(f"the weight of source {name!r} is {weight}")
    exact = [Fraction(weight) for _, weight, _ in rows]
    scale = lcm(*(x.denominator for x in exact))
    parts = [int(x * scale) for x in exact]
    total, need, turn = sum(parts), [r[2] for r in rows], [0] * len(rows)
    ready = [(-(-total // w), k, 0) for k, w in enumerate(parts)]  # deadline, source, release
    heapq.heapify(ready)
    waiting: list[tuple[int, int]] = []  # release, source
    left, slot = len(rows), 0
    while left:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(turn[k] + 1) * total // parts[k]), k, release))
        deadline, k, release = heapq.heappop(ready)
        yield rows[k][0], turn[k] % need[k], turn[k] // need[k], slot, release, deadline
        turn[k] += 1
        left -= turn[k] == need[k]
        if turn[k] < need[k] * epochs:
            heapq.heappush(waiting, (turn[k] * total // parts[k], k))
        slot += 1


def placed(df: DataFrame, weights: dict[str | None, float] | None, block_chars: int, id_col: str, text_col: str, source_col: str, epochs: int, narrow: bool = False) -> DataFrame:
    """df (without its text if narrow) with __block, __offset, __order, and __turns: slot, release, deadline by epoch."""
    size = F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    order = F.xxhash64(F.col(id_col))
    rows = df.withColumn("__size", size).withColumn("__tie", F.xxhash64(text_col)).withColumn("__order", order).withColumn("__sub", F.shiftrightunsigned("__order", 52).cast("int"))
    # Sources by two columns without nulls: the join then finds the rows where the window's shuffle has put them.
    keyed = lambda rows, source: rows.withColumns({"__key": F.coalesce(F.col(source).cast("string"), F.lit("")), "__none": F.col(source).isNull()})
    rows = keyed(rows, source_col)
    rows = rows.drop(text_col) if narrow else rows
    # One row for each source and hash range: these sums alone decide where each range begins.
    sums = df.select(F.col(source_col).alias("__source"), size.alias("__size"), F.shiftrightunsigned(order, 52).cast("int").alias("__of")).groupBy("__source", "__of").agg(F.sum("__size").alias("__size"))
    sums = materialise(sums, "mix-sums")
    block_chars = max(block_chars, -(-(sums.agg(F.sum("__size")).first()[0] or 0) // MAX_BLOCKS))
    needs = sums.groupBy("__source").agg(F.sum("__size").alias("__total")).withColumn("__blocks", F.greatest(F.lit(1), F.ceil(F.col("__total") / block_chars)))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [r for frame in frames for r in zip((None if pd.isna(x) else x for x in frame["__source"]), frame["__total"].tolist(), frame["__blocks"].tolist(), strict=True)]
        found = dealt(((s, max(n, 1) ** TEMPER if weights is None else weights[s], need) for s, n, need in held), epochs)
        while part := list(islice(found, DEALT_ROWS)):
            yield pd.DataFrame(part, columns=["__name", "__block", "__epoch", "__slot", "__release", "__deadline"])

    slots = needs.repartition(1).mapInPandas(deal, "__name string, __block long, __epoch long, __slot long, __release long, __deadline long")
    turn = F.struct("__epoch", F.col("__slot").alias("slot"), F.col("__release").alias("release"), F.col("__deadline").alias("deadline"))
    slots = slots.groupBy("__name", "__block").agg(F.array_sort(F.collect_list(turn)).alias("__turns"))
    # Each hash range with the slots of the blocks in which its texts begin.
    before = Window.partitionBy("__source").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__start", F.coalesce(F.sum("__size").over(before), F.lit(0))).join(needs.select(F.col("__source").alias("__s"), "__blocks"), F.col("__source").eqNullSafe(F.col("__s")))
    block = lambda at: F.least(F.floor(at / block_chars), F.col("__blocks") - 1)
    reach = F.sequence(block(F.col("__start")), block(F.col("__start") + F.col("__size")))
    each = starts.select("__source", "__of", "__start", "__blocks", F.explode(reach).alias("__at"))
    each = each.join(slots, each["__source"].eqNullSafe(slots["__name"]) & (each["__at"] == slots["__block"]))
    starts = each.groupBy("__source", "__of", "__start", "__blocks").agg(F.min("__at").alias("__first"), F.array_sort(F.collect_list(F.struct("__at", "__turns"))).alias("__all"))
    starts = keyed(materialise(starts, "mix-starts"), "__source").withColumnRenamed("__of", "__sub").drop("__source")
    within = Window.partitionBy("__key", "__none", "__sub").orderBy("__order", F.col(id_col), "__tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__within", F.coalesce(F.sum("__size").over(within), F.lit(0)))
    rows = rows.join(starts, ["__key", "__none", "__sub"], "left")
    at = F.col("__start") + F.col("__within")
    rows = rows.withColumn("__block", block(at)).withColumn("__offset", at - F.col("__block") * block_chars)
    rows = rows.withColumn("__turns", F.get("__all", (F.col("__block") - F.col("__first")).cast("int"))["__turns"])
    return rows.drop("__start", "__within", "__size", "__key", "__none", "__blocks", "__first", "__all", "__sub", "__tie")


def schedule(df: DataFrame, weights: dict[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, block, offset, release, deadline, slot, epochs: each row's first place in the mix.

    offset counts the characters of the block before the row; slot and offset together order the mix.
    """
    narrow = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    rows = placed(narrow, weights, block_chars, "doc_id", "text", "source", epochs, narrow=True)
    first = F.get("__turns", F.lit(0))
    return rows.select("doc_id", "source", F.col("__block").alias("block"), F.col("__offset").alias("offset"), *[first[c].alias(c) for c in ("release", "deadline", "slot")], F.size("__turns").alias("epochs"))


def mix(df: DataFrame, weights: dict[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, epochs: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of df in the order of the mix, with all their columns; a short source's rows come up to `epochs` times."""
    # The row travels as one struct, so that no column of it can clash with those of the placing.
    own = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), F.struct("*").alias("row"))
    rows = placed(own, weights, block_chars, "doc_id", "text", "source", epochs, narrow=True).withColumn("__slot", F.explode(F.col("__turns.slot")))
    return rows.repartitionByRange("__slot", "__offset").sortWithinPartitions("__slot", "__offset", "__order", "doc_id").select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents"))


QUERIES = {"op8_mixing": op8_mixing}
ORACLES: dict[str, str] = {}
