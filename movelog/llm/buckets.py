"""Links between the members of band buckets: one leader for each bucket, then a complete search of the rest."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .components import components

#: Members, or probes, of one bucket that meet in one block, and the sum of their sizes.
BLOCK_ROWS, BLOCK_SIZES = 1_024, 1_000_000

#: Of a block's rows, makes the function that says which of some rows one row is linked with.
Judge = Callable[[pd.DataFrame], Callable[[int, np.ndarray], np.ndarray]]
#: Of a block's key and rows (node, part, probe and the payload), gives links between different parts: a, b.
Search = Callable[[tuple, pd.DataFrame], pd.DataFrame]


def gathered(reps: DataFrame, name: str) -> DataFrame:
    """band, node, leader of every bucket with two members or more; reps: node, bands.

    The member whose buckets are the fullest in sum leads: of a group's copies the one nearest to
    what they are copies of.
    """
    # Bands move once, in one plan for any size: most are nobody else's, and a join back to their counts would move all again.
    # A hot bucket is a narrow row for each node at most; the window's buffer spills.
    banded = reps.select("node", F.explode("bands").alias("band")).withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("band")))
    shared = materialise(banded.where("members > 1"), f"{name}-crowded")
    weights = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    weighed = materialise(shared.join(weights, "node").select("band", "node", "weight"), f"{name}-weighed")
    # Leaders are written before they are joined, as Spark splits a hot bucket only in a join of two exchanges.
    leaders = materialise(weighed.groupBy("band").agg(F.max(F.struct("weight", -F.col("node"), "node"))["node"].alias("leader")), f"{name}-leaders")
    return materialise(weighed.join(leaders, "band").select("band", "node", "leader"), f"{name}-shared")


def stars(shared: DataFrame) -> DataFrame:
    """a, b: every member with the leaders of its buckets, the smaller node first."""
    return shared.where("node != leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def complete(shared: DataFrame, links: DataFrame, sizes: DataFrame, payload: Callable[[DataFrame], DataFrame], search: Search, name: str) -> DataFrame:
    """a, b: links that join what the given links leave apart, by a search of all buckets that hold several components.

    Members outside a bucket's main component are held against all others, in blocks of bounded size.
    sizes: node, size; payload gives, for a table of nodes, their node and what the search of a block looks at.
    """
    placed = shared.drop("leader").join(components(links, f"{name}-parts"), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    # Sums by bucket and component come first, so that a hot bucket meets in partial sums.
    parts = placed.groupBy("band", "part").agg(F.count(F.lit(1)).alias("members"))
    bands = parts.groupBy("band").agg(F.max(F.struct("members", "part"))["part"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    bands = materialise(bands.select("band", "main"), f"{name}-bands")
    rest = placed.join(bands, "band").join(sizes, "node")
    rest = materialise(rest.withColumn("probe", F.col("part") != F.col("main")).drop("main"), f"{name}-open")
    room = lambda rows, size: F.ceil(F.greatest(rows / BLOCK_ROWS, size / BLOCK_SIZES, F.lit(1))).cast("int")
    apart = F.col("probe").cast("int")
    counts = rest.groupBy("band").agg(room(F.count(F.lit(1)), F.sum("size")).alias("m_blocks"), room(F.sum(apart), F.sum(apart * F.col("size"))).alias("p_blocks"))
    rest = rest.join(materialise(counts, f"{name}-blocks"), "band")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    members = rest.select("band", "node", "part", F.lit(False).alias("probe"), own("m_blocks", 1).alias("i"), every("p_blocks").alias("j"))
    probes = rest.where("probe").select("band", "node", "part", "probe", every("m_blocks").alias("i"), own("p_blocks", 2).alias("j"))
    held = materialise(payload(materialise(rest.select("node").distinct(), f"{name}-ids")), f"{name}-payload")
    met = members.union(probes).join(held, "node").groupBy("band", "i", "j")
    return materialise(met.applyInPandas(search, "a long, b long").distinct(), f"{name}-links")


def searched(judge: Judge) -> Search:
    """For one block: holds all its probes against its members, and gives links between different parts.

    A pair is judged in the first bucket that both are in. Parts that a link has joined are one from
    then on, so that there are fewer links than rows.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        linked = judge(rows)
        node, part, probe = rows["node"].to_numpy(), rows["part"].to_numpy().copy(), rows["probe"].to_numpy(bool)
        bands = np.stack(rows["bands"])
        first = (bands == key[0]).argmax(axis=1)[0]
        held = np.flatnonzero(~probe)
        links = []
        for k in np.flatnonzero(probe).tolist():
            near = held[part[held] != part[k]]
            near = near[~(bands[near, :first] == bands[k, :first]).any(axis=1)]
            if not len(near):
                continue
            for m in near[linked(k, near)].tolist():
                if part[m] != part[k]:
                    links.append((min(node[k], node[m]), max(node[k], node[m])))
                    part[part == part[m]] = part[k]
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run
