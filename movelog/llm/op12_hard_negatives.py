"""Hard-negative mining with segment summary filtering.

Every vector is cut into segments, and of each segment its mean and deviation are stored. For two
vectors q and x the sum over segments of width * (mean(q) * mean(x) +- deviation(q) * deviation(x)) holds their
inner product between two bounds, by Cauchy and Schwarz. Pairs that the bounds of wide segments cannot
exclude are refined with narrower ones, level by level, and only what is left is scored exactly.

1. Anchors, a stated share of the rows, are dealt into blocks of bounded size. Every block meets all
   rows, which are dealt into as many parts as there are tasks; a part streams past its anchors, and
   a task holds one block of anchors and their best rows.
2. First each anchor's positives: the best rows of its label, by upper bounds against the worst one
   held so far. Each task gives its best few; their best are the anchor's.
3. Then negatives: each positive's score sets a window, and the best rows of other labels within it
   are kept. Rows whose bounds lie outside all windows, or below what all windows hold, go unscored.

Scores are whole numbers, exact up to the ends of a long, where they stay.

Defined results: rows with a null id, label or vector, or with a null, NaN or infinite component take
no part. A shorter vector counts as filled up with zeros. A row with the anchor's own id is neither its
positive nor its negative; other rows that repeat an id count as rows of their own, and so do anchors.
Equal scores come by the smaller id. An anchor without positives, or a positive without negatives, and
an empty table give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_frames, materialise, table

#: Widths of segments, level by level.
WIDTHS = (16, 4, 2)
#: Anchors of a block, which a task holds; anchors and rows that meet at one time.
ANCHORS, CHUNK, ROWS = 32_768, 2_048, 512
#: Tasks at most, whatever the number of cells.
TASKS = 20_000
#: Rows of a part at most; every part meets every block of anchors in a task.
PART = 250_000
#: Products are whole in floating point up to here.
EXACT = 2.0**52
LONG = np.iinfo(np.int64)


@dataclass(frozen=True)
class Mining:
    """What is mined: positives for each anchor, negatives for each positive, whose scores are at least low and at most high hundredths of the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: float = 256.0


def prepared(df: DataFrame, is_anchor: Column, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """row, id, label, is_anchor, vector of the rows that take part; components become floor(scale * x)."""
    vector = F.col(vector_col)
    whole = F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * F.lit(scale), F.lit(-(2.0**63))), F.lit(2.0**63 - 1024))))
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.col("label") if label is None else label
    rows = df.where(F.col(id_col).isNotNull() & label.isNotNull() & vector.isNotNull() & F.coalesce(usable, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), is_anchor.alias("is_anchor"), whole.alias("vector"))


def summarised(rows: DataFrame) -> DataFrame:
    """The rows with the summaries of all levels: width by width, every segment's mean and deviation, each times the root of the width."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                levels = summaries(matrix(frame["vector"]))
                yield frame.assign(**{f"level{k}": list(level) for k, level in enumerate(levels)})

    levels = ", ".join(f"level{k} array<float>" for k in range(len(WIDTHS)))
    return map_frames(rows, run, f"row long, id long, label long, is_anchor boolean, vector array<long>, {levels}")


def matrix(vectors: pd.Series, width: int = 0) -> np.ndarray:
    """Vectors as rows of one matrix, shorter ones filled up with zeros."""
    lengths = vectors.map(len).to_numpy()
    width = max(width, int(lengths.max(initial=0)))
    if (lengths == width).all() and width:
        return np.stack(vectors.to_list()).astype(np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def summaries(vectors: np.ndarray) -> list[np.ndarray]:
    """For each level the means of all segments and then their deviations, so that inner products of summaries are bounds."""
    out = []
    for width in WIDTHS:
        padded = np.zeros((len(vectors), -(-vectors.shape[1] // width) * width))
        padded[:, : vectors.shape[1]] = vectors
        parts = padded.reshape(len(vectors), -1, width)
        out.append(np.concatenate([parts.mean(2), parts.std(2)], axis=1) * np.sqrt(width))
    return out


class Side:
    """Rows or anchors of a task: ids, labels, whole vectors and the summaries of each level."""

    def __init__(self, frame: pd.DataFrame, width: int = 0):
        self.id, self.label = frame["id"].to_numpy(np.int64), frame["label"].to_numpy(np.int64)
        self.vectors = matrix(frame["vector"], width)
        self.width = self.vectors.shape[1]
        if len(frame) and frame["vector"].map(len).eq(self.width).all():
            self.levels = [np.stack(frame[f"level{k}"].to_list()).astype(np.float64) for k in range(len(WIDTHS))]
        else:
            self.levels = summaries(self.vectors)
        # Stored summaries are rounded; what that may change of a product stays below this share of the lengths' product.
        self.norm = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1))
        self.exact = self.vectors.astype(np.float64)


def bounds(a: Side, x: Side, level: int, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score that the summaries of a level allow, for all pairs or for the given ones."""
    half = a.levels[level].shape[1] // 2
    left, right = a.levels[level], x.levels[level]
    if pairs is None:
        means, deviations = left[:, :half] @ right[:, :half].T, left[:, half:] @ right[:, half:].T
        room = np.outer(a.norm, x.norm)
    else:
        left, right = left[pairs[0]], right[pairs[1]]
        means, deviations = np.einsum("ij,ij->i", left[:, :half], right[:, :half]), np.einsum("ij,ij->i", left[:, half:], right[:, half:])
        room = a.norm[pairs[0]] * x.norm[pairs[1]]
    room = deviations + 1e-6 * room + 1
    return means - room, means + room


def scores(a: Side, x: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The exact inner products of pairs of rows."""
    most = float(a.norm.max(initial=0)) * float(x.norm.max(initial=0))
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 100_000):
        p, q = i[at : at + 100_000], j[at : at + 100_000]
        if most < EXACT:
            out[at : at + len(p)] = np.einsum("ij,ij->i", a.exact[p], x.exact[q]).astype(np.int64)
        else:
            out[at : at + len(p)] = [min(max(sum(u * v for u, v in zip(m, n, strict=True)), LONG.min), LONG.max) for m, n in zip(a.vectors[p].tolist(), x.vectors[q].tolist(), strict=True)]
    return out


class Best:
    """The best few rows of each slot, by score and then by smaller id."""

    def __init__(self, slots: int, n: int):
        self.n = n
        self.slot, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(slots, -np.inf)  # scores below it cannot enter a full slot

    def add(self, slot: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(slot):
            return
        slot, ids, score = np.concatenate([self.slot, slot]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, ~score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]])
        place = np.arange(len(slot)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        kept = place < self.n
        self.slot, self.id, self.score = slot[kept], ids[kept], score[kept]
        full = kept & (place == self.n - 1)
        self.least[slot[full]] = score[full]


def refined(a: Side, x: Side, allowed: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (anchor, row) of the mask that no level's bounds exclude. allowed(anchor, low, high) judges pairs by their bounds."""
    low, high = bounds(a, x, 0)
    i, j = np.nonzero(mask)
    keep = allowed(i, low[i, j], high[i, j])
    i, j = i[keep], j[keep]
    for level in range(1, len(WIDTHS)):
        if len(i) * 8 > mask.size:  # so many are left that products of whole matrices are cheaper
            low, high = (m[i, j] for m in bounds(a, x, level))
        else:
            low, high = bounds(a, x, level, (i, j))
        keep = allowed(i, low, high)
        i, j = i[keep], j[keep]
    return i, j


class Positives:
    """The best rows of each anchor's own label."""

    def __init__(self, anchors: pd.DataFrame, mining: Mining):
        self.row, self.side = anchors["row"].to_numpy(np.int64), Side(anchors)
        self.best = Best(len(anchors), mining.positives)

    def meet(self, x: Side) -> None:
        a = self.side
        mask = (a.label[:, None] == x.label) & (a.id[:, None] != x.id)
        i, j = refined(a, x, lambda i, low, high: high >= self.best.least[i], mask)
        self.best.add(i, x.id[j], scores(a, x, i, j))

    def found(self) -> pd.DataFrame:
        return pd.DataFrame({"anchor": self.row[self.best.slot], "slot": 0, "id": self.best.id, "score": self.best.score})


class Negatives:
    """For each positive of an anchor the best rows of other labels within its window. anchors: also positives, a list of (slot, score)."""

    def __init__(self, anchors: pd.DataFrame, mining: Mining):
        self.row, self.side, self.slots = anchors["row"].to_numpy(np.int64), Side(anchors), mining.positives
        self.low, self.high = (np.full((len(anchors), self.slots), fill) for fill in (LONG.max, LONG.min))
        for k, positives in enumerate(anchors["positives"]):
            for p in positives:
                # The least and the greatest whole score within the window; Python's integers do not overflow.
                self.low[k, p["slot"]], self.high[k, p["slot"]] = -(-mining.low * int(p["score"]) // 100), mining.high * int(p["score"]) // 100
        self.best = Best(self.low.size, mining.negatives)

    def meet(self, x: Side) -> None:
        a = self.side
        least = np.maximum(self.low, self.best.least.reshape(self.low.shape)).astype(np.float64)
        open_ = self.low <= self.high
        least, most = np.where(open_, least, np.inf).min(1), np.where(open_, self.high, LONG.min).max(1)
        mask = (a.label[:, None] != x.label) & (a.id[:, None] != x.id) & open_.any(1)[:, None]
        i, j = refined(a, x, lambda i, low, high: (high >= least[i]) & (low <= most[i]), mask)
        score = scores(a, x, i, j)
        for slot in range(self.slots):
            within = (score >= self.low[i, slot]) & (score <= self.high[i, slot])
            to = i[within] * self.slots + slot
            enters = score[within] >= self.best.least[to]
            self.best.add(to[enters], x.id[j[within][enters]], score[within][enters])

    def found(self) -> pd.DataFrame:
        slot = self.best.slot
        return pd.DataFrame({"anchor": self.row[slot // self.slots], "slot": slot % self.slots, "id": self.best.id, "score": self.best.score})


def met(rows: DataFrame, anchors: DataFrame, mining: Mining, kind: type[Positives] | type[Negatives], n_rows: int, n_anchors: int, name: str) -> DataFrame:
    """anchor, slot, id, score: the best rows of every part for every block of anchors.

    Each pair of a part and a block is a cell. A task reads its cells one after another, the anchors
    of a cell before its rows, and holds the anchors only.
    """
    n_blocks, n_parts = max(-(-n_anchors // ANCHORS), 1), max(-(-n_rows // PART), rows.sparkSession.sparkContext.defaultParallelism)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    levels = [f"level{k}" for k in range(len(WIDTHS))]
    shape = ["block", "part", "row", "id", "label", "vector", *levels]
    none = F.lit(None).cast("array<struct<slot: int, score: long>>").alias("positives")
    each = rows.select(every(n_blocks).alias("block"), dealt(n_parts, 1).alias("part"), *shape[2:]).select(*shape, F.lit(False).alias("is_anchor"), none)
    own = anchors.withColumn("block", dealt(n_blocks, 2)).select("*", every(n_parts).alias("part")).select(*shape, F.lit(True).alias("is_anchor"), "positives")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held, now = None, [], []
        for frame in frames:
            if not len(frame):
                continue
            keys = frame["block"].to_numpy(np.int64) * n_parts + frame["part"].to_numpy(np.int64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (frame["is_anchor"].to_numpy()[1:] != frame["is_anchor"].to_numpy()[:-1])) + 1
            for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(frame)], strict=True):
                piece = frame.iloc[at:end]
                if keys[at] != cell:
                    yield from (part.found() for part in now)
                    cell, held, now = keys[at], [], []
                if piece["is_anchor"].iloc[0]:
                    held.append(piece)
                    continue
                if held:
                    anchors, held = pd.concat(held), []
                    now = [kind(anchors.iloc[k : k + CHUNK], mining) for k in range(0, len(anchors), CHUNK)]
                for k in range(0, len(piece) if now else 0, ROWS):
                    rows = piece.iloc[k : k + ROWS]
                    for part in now:
                        meet(part, rows)
        yield from (part.found() for part in now)

    cells = each.union(own).repartition(min(n_blocks * n_parts, TASKS), "block", "part").sortWithinPartitions("block", "part", F.desc("is_anchor"))
    return materialise(map_frames(cells, run, "anchor long, slot int, id long, score long"), name)


def meet(now: Positives | Negatives, piece: pd.DataFrame) -> None:
    """Holds rows against the anchors; if the rows are longer, the anchors are filled up first."""
    x = Side(piece, now.side.width)
    if x.width > now.side.width:
        now.side = widened(now.side, x.width)
    now.meet(x)


def widened(side: Side, width: int) -> Side:
    """The same rows filled up with zeros."""
    side.vectors = np.pad(side.vectors, ((0, 0), (0, width - side.width)))
    side.exact, side.width, side.levels = side.vectors.astype(np.float64), width, summaries(side.vectors)
    return side


def ranked(found: DataFrame, by: list[str], n: int) -> DataFrame:
    """The best n rows of each group, numbered from 1; Spark keeps the best n of each task before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows as `prepared` gives them."""
    held = materialise(summarised(rows), "mine-rows")
    n_rows, n_anchors = held.count(), held.where("is_anchor").count()
    anchors = held.where("is_anchor")
    none = F.lit(None).cast("array<struct<slot: int, score: long>>").alias("positives")
    found = met(held, anchors.withColumn("positives", none), mining, Positives, n_rows, n_anchors, "mine-positives")
    positives = materialise(ranked(found, ["anchor"], mining.positives).select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "mine-best")
    of_anchor = positives.groupBy("anchor").agg(F.collect_list(F.struct(F.col("slot"), F.col("positive_score").alias("score"))).alias("positives"))
    wanted = materialise(anchors.join(of_anchor, F.col("row") == F.col("anchor")).drop("anchor"), "mine-anchors")
    found = met(held, wanted, mining, Negatives, n_rows, n_anchors, "mine-negatives")
    negatives = ranked(found, ["anchor", "slot"], mining.negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    out = negatives.join(positives, ["anchor", "slot"]).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    relabelled = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(prepared(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, label=relabelled))


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id != b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS place
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(place AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 10""",
}
