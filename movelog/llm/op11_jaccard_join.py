"""N-gram Jaccard join in metric space: pivots, Voronoi regions and windows of the triangle inequality.

The Jaccard distance of two shingle sets is a metric, so a document y within theta of x is, from any
pivot p, at a distance within theta of d(x, p). But sets that share nothing are all at distance 1,
where no pivot tells them apart. So each document first finds the pivots it can have a neighbour near:

1. Equal sets collapse to the smallest doc_id. A hash deals all shingles into parts. Two sets at similarity
   0.8 differ in d = 0.25 n shingles at most, n the size of either, and so in d parts at most: all others
   are equal. Parts have one order for the whole corpus, those with many and rare shingles first, so the
   first of the equal parts is among the first d + 1 parts of both sets. These are a set's prefix. Parts
   of two shingles and more are seldom equal by chance, so what meets grows as the corpus does. Their
   number follows a set's size by scales; a set near the end of one has a prefix in the next one too.
2. Of the documents that share a part of their prefixes, the one that shares most with others is their pivot.
   A pivot's region is all documents that have found it, so any two linked documents share a region.
   Documents that share too few parts with any of a region leave it, and regions within another one go.
3. Regions join recursively: pivots far from each other create Voronoi cells, a document enters each
   cell whose pivot is at most 2 theta farther than its nearest one, and cells are cut again until
   they are small or all of a cell is linked. Small cells compare full sets.
4. A region too large for one task is first cut around its pivot, to which all distances are found:
   documents within theta are linked with it, and the region falls into rings of width theta. A
   document is replicated over the border of its ring into the next one, as documents two rings apart
   are more than theta apart. Rings that are not all linked yet are joined as in 3, in blocks of
   bounded size that hold what lies outside the main component against all others.
5. Links are joined into components.

The order of parts changes the work, never the result: tasks count shingles over all texts, and a part's
shingles count by their rarity, as far as they are of the COMMON with the highest counts.

Defined results: null or empty texts have no shingles and are linked with nothing; rows that repeat
a doc_id count as one document in links and give one row each; a null doc_id is linked with nothing
and has a null component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .buckets import Search, complete, gathered
from .common import BROADCAST_IDS, blocks, map_frames, materialise, most_frequent, table, texts
from .components import components
from .op02_near_dedup import sets_of
from .shingles import mix, shingle_sets

#: Shingles whose rarity is by their count; the list goes to the tasks (16 bytes each).
COMMON = 500_000
#: What a shingle of no known count weighs in the order of parts; each doubling of a count takes one off.
RARE = 24
#: A scale is of sets from one power of this on; it has half as many parts again as its smallest set shingles.
SPREAD = 6
#: Below this similarity most parts may differ, and each shingle is a part.
ALIKE = 67
#: Shingles that a task counts at one time, and the count from which it reports one.
KEPT_SHINGLES, REPORTED = 2_000_000, 3
#: Documents of a region that one task joins, and the sum of their sizes.
ROOM_ROWS, ROOM_SIZES = 1_024, 1_000_000
#: Documents of a cell that are compared without further pivots, and pivots of a cell.
LEAF, PIVOTS = 48, 12
#: Cells with more documents in all than this times their parent's are not worth another cut.
PROGRESS = 2


def measured(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (null without shingles), often: shingles that a task met REPORTED times or more, in some rows."""

    def often(held: list[np.ndarray]) -> list[dict]:
        if not held:
            return []
        shingles, counts = np.unique(np.concatenate(held), return_counts=True)
        some = counts >= REPORTED
        return [{"shingle": s, "n": n} for s, n in zip(shingles[some].view(np.int64).tolist(), counts[some].tolist(), strict=True)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, last = [], 0, None
        for frame in blocks(frames):
            if last is not None:
                yield last
            sets = shingle_sets(frame.text.tolist(), width)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            last = pd.DataFrame({"doc_id": frame.doc_id.array, "n_shingles": [len(s) for s in sets], "set_key": keys, "often": None})
            held += sets
            n += sum(map(len, sets))
            if n > KEPT_SHINGLES:
                last.at[0, "often"] = often(held)
                held, n = [], 0
        if last is not None:
            last.at[0, "often"] = (last.at[0, "often"] or []) + often(held)
            yield last

    return map_frames(docs, run, "doc_id long, n_shingles long, set_key binary, often array<struct<shingle: long, n: long>>")


def common_shingles(found: DataFrame, limit: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts."""
    counts = materialise(found.select(F.inline("often")).groupBy("shingle").agg(F.sum("n").alias("n")), "join-counts")
    most = most_frequent(counts, limit).toPandas()
    shingles, n = most["shingle"].to_numpy(np.int64).view(np.uint64), most["n"].to_numpy(np.int64)
    order = np.argsort(shingles)
    return shingles[order], n[order]


def differing(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """In how many shingles, of both together, a set of n and one linked with it differ at most."""
    return n * (100 - percent) // percent


def scales(n: int, percent: int) -> Iterator[tuple[int, int]]:
    """The scales that a set of n shingles is in, and their numbers of parts: the smaller of two linked sets is at home where they meet."""
    k = 0
    while SPREAD**k <= n:
        after = SPREAD ** (k + 1)
        if n < after or n * percent < after * 100:
            yield k, max(SPREAD**k * 3 // 2, differing(-(-after * 100 // percent), percent) + 1)
        k += 1


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Hashes of the first parts of a set in the corpus's order: by the weight of their shingles, then by hash; empty parts are last."""
    keys, counts = common
    weights = np.full(len(shingles), RARE)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
        known = keys[at] == shingles
        weights[known] = np.maximum(RARE - np.frexp(counts[at[known]])[1], 1)
    if percent < ALIKE:  # of two linked sets, one lacks n - ceil(percent / 100 * n) of the other's n shingles at most
        return shingles[np.lexsort((shingles, -weights))[: len(shingles) + (-percent * len(shingles)) // 100 + 1]]
    hashes, size, out = mix(shingles), differing(len(shingles), percent) + 1, []
    for scale, n in scales(len(shingles), percent):
        part = mix(hashes + np.uint64(scale)) % np.uint64(n)
        order = np.argsort(part)
        part = part[order]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        part, weight, content = part[starts], np.add.reduceat(weights[order], starts), np.add.reduceat(hashes[order], starts)
        first = np.lexsort((part, content, -weight))[:size]
        part, content = part[first], content[first]
        if len(part) < size:
            none = np.setdiff1d(np.arange(n, dtype=np.uint64), part)[: size - len(part)]
            part, content = np.concatenate([part, none]), np.concatenate([content, np.zeros(len(none), np.uint64)])
        out.append(mix(content + mix(part * np.uint64(64) + np.uint64(scale))))
    return np.concatenate(out) if out else hashes


def without_copies(docs: DataFrame, known: DataFrame, sets: DataFrame) -> DataFrame:
    """The documents that stand for a set. The shorter of the lists of those that do and those that don't goes to the tasks, so that texts stay where they are."""
    nodes = sets.select("node")
    copies = materialise(known.select("doc_id").join(nodes, F.col("doc_id") == F.col("node"), "left_anti").distinct(), "join-copies")
    n_nodes, n_copies = nodes.count(), copies.count()
    if n_copies < n_nodes:
        return docs.where("doc_id IS NOT NULL").join(F.broadcast(copies) if n_copies <= BROADCAST_IDS else copies, "doc_id", "left_anti")
    return docs.join(F.broadcast(nodes) if n_nodes <= BROADCAST_IDS else nodes, docs.doc_id == nodes.node, "left_semi")


def prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], width: int, percent: int) -> DataFrame:
    """node, bands: the prefixes of the documents."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames):
            sets = shingle_sets(frame.text.tolist(), width)
            yield pd.DataFrame({"node": frame.doc_id, "bands": [prefix(s, sent.value, percent).view(np.int64) for s in sets]})

    return map_frames(docs, run, "node long, bands array<long>")


def distances(docs: DataFrame, pairs: DataFrame, width: int, name: str) -> DataFrame:
    """a, b, both, either: the sizes of intersection and union, from full sets."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{name}-ids")
    sets = materialise(sets_of(docs, ids, width), f"{name}-sets")
    held = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    counted = held.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("both"), (F.size("sa") + F.size("sb")).cast("long").alias("sum"))
    return materialise(counted.select("a", "b", "both", (F.col("sum") - F.col("both")).alias("either")), f"{name}-distances")


def rings(regions: DataFrame, reached: DataFrame, percent: int) -> DataFrame:
    """band, node: every document in its ring around each of its pivots, and over the border in the next ring."""
    both_ways = reached.select(F.col("a").alias("node"), F.col("b").alias("leader"), "both", "either").union(reached.select("b", "a", "both", "either"))
    far = regions.where("node != leader").join(both_ways, ["node", "leader"])
    # floor(d / theta) in whole numbers, for d = (either - both) / either.
    ring = F.expr(f"((either - both) * 100) div (either * {max(100 - percent, 1)})")
    placed = far.select("node", "leader", ring.alias("ring")).union(regions.where("node = leader").select("node", "leader", F.lit(0).cast("long")))
    each = placed.select("node", "leader", F.explode(F.array(F.col("ring"), F.col("ring") + 1)).alias("ring"))
    return each.select(F.xxhash64("leader", "ring").alias("band"), "node").distinct()


class Cell:
    """The sets of one block, as codes; finds the links between documents of different parts."""

    def __init__(self, rows: pd.DataFrame, percent: int):
        codes = np.unique(np.concatenate(rows["shingles"].to_list()), return_inverse=True)[1]
        cuts = np.concatenate([[0], np.cumsum(rows["shingles"].map(len))]).tolist()
        self.own = [codes[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.n = np.array([len(x) for x in self.own], np.int64)
        self.mark = np.zeros(int(codes.max(initial=0)) + 1, bool)
        self.node, self.part, self.percent = rows["node"].to_numpy(), rows["part"].to_numpy().copy(), percent
        self.theta = 1 - percent / 100
        self.links: list[tuple[int, int]] = []

    def both(self, k: int, others: np.ndarray) -> np.ndarray:
        """The sizes of the intersections of one set with others."""
        self.mark[self.own[k]] = True
        found = np.add.reduceat(self.mark[np.concatenate([self.own[m] for m in others.tolist()])], np.cumsum(self.n[others]) - self.n[others], dtype=np.int64)
        self.mark[self.own[k]] = False
        return found

    def link(self, k: int, others: np.ndarray, both: np.ndarray) -> None:
        """Joins the part of k with those of the others that are within theta of it."""
        near = both * 100 >= self.percent * (self.n[others] + self.n[k] - both)
        for m in others[near].tolist():
            if self.part[m] != self.part[k]:
                self.links.append((min(self.node[k], self.node[m]), max(self.node[k], self.node[m])))
                self.part[self.part == self.part[m]] = self.part[k]

    def distance(self, k: int, others: np.ndarray) -> np.ndarray:
        """Distances of one set from others; links are made on the way."""
        both = self.both(k, others)
        self.link(k, others, both)
        return 1 - both / (self.n[others] + self.n[k] - both)

    def compare(self, members: np.ndarray, seen: np.ndarray | None = None) -> None:
        """All pairs of different parts; seen: distances to pivots, which exclude what they differ in by more than theta."""
        for at, k in enumerate(members.tolist()):
            allowed = self.part[members] != self.part[k]
            allowed[: at + 1] = False
            allowed &= np.minimum(self.n[members], self.n[k]) * 100 >= np.maximum(self.n[members], self.n[k]) * self.percent
            if seen is not None:
                allowed &= (np.abs(seen - seen[:, at : at + 1]) <= self.theta + 1e-9).all(axis=0)
            if len(others := members[allowed]):
                self.link(k, others, self.both(k, others))

    def join(self, members: np.ndarray) -> None:
        """Joins a region: by Voronoi cells of new pivots, or directly if it is small."""
        parts = self.part[members]
        if (parts == parts[0]).all():
            return
        if len(members) <= LEAF:
            return self.compare(members)
        # Each pivot is the document farthest from those before; nearer than 2 theta, its cell would hold theirs.
        seen = [self.distance(int(members[0]), members)]
        while len(seen) < PIVOTS:
            nearest = np.min(seen, axis=0)
            apart = nearest > 2 * self.theta
            if not apart.any():
                break
            seen.append(self.distance(int(members[np.flatnonzero(apart)[nearest[apart].argmax()]]), members))
        seen = np.array(seen)
        nearest = seen.min(axis=0)
        cells = [members[row <= nearest + 2 * self.theta + 1e-9] for row in seen]
        if sum(map(len, cells)) > PROGRESS * len(members) or max(map(len, cells)) == len(members):
            return self.compare(members, seen)
        for cell in cells:
            self.join(cell)


def joined(percent: int) -> Search:
    """For one block: the links that join what is not linked yet."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node", ignore_index=True)  # a probe is a member too
        cell = Cell(rows, percent)
        cell.join(np.arange(len(rows)))
        return pd.DataFrame(cell.links, columns=["a", "b"], dtype=np.int64)

    return run


def possible(n: np.ndarray, met: np.ndarray, percent: int) -> np.ndarray:
    """Which documents of a region some other one may be linked with, by size and the number of parts met in any region.

    Of two linked sets, one's prefix ends before the other's in the order of parts. Its parts are equal to the
    other's but for as many as the sets differ in, and what is equal is in both prefixes.
    """
    less, more = np.minimum(n[:, None], n), np.maximum(n[:, None], n)
    near = less * 100 >= more * percent
    if percent >= ALIKE:
        near &= np.minimum(met[:, None], met) > differing(less, percent) - (less + more) * (100 - percent) // (100 + percent)
    np.fill_diagonal(near, False)
    return near.any(axis=0)


def likely(regions: DataFrame, sizes: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """The rows of regions (leader, node) that one task can hold, without documents that nothing of their region can be linked with."""

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        leader, n, m = (rows[c].to_numpy(np.int64) for c in ("leader", "size", "met"))
        cuts = [0, *(np.flatnonzero(leader[1:] != leader[:-1]) + 1).tolist(), len(rows)] if len(rows) else []
        kept = [possible(n[a:b], m[a:b], percent) for a, b in zip(cuts, cuts[1:], strict=False)]
        return rows.loc[np.concatenate([np.zeros(0, bool), *kept]), ["leader", "node"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # of the region that a batch ends in
        for frame in frames:
            if len(frame):
                frame = pd.concat([rest, frame], ignore_index=True)
                ends = frame["leader"] == frame["leader"].iat[-1]
                rest = frame[ends]
                yield found(frame[~ends])
        if rest is not None:
            yield found(rest)

    # The rows are few bytes and much work: a fixed number of tasks is not merged.
    parts = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = regions.join(sizes, "node").join(met, "node").select("leader", "node", "size", "met").repartition(parts, "leader").sortWithinPartitions("leader")
    return map_frames(rows, run, "leader long, node long").distinct()


def outermost(regions: DataFrame) -> DataFrame:
    """The regions without those that lie in another one: all of whose documents have the same other region as their largest."""
    of_leader, of_node = Window.partitionBy("leader"), Window.partitionBy("node")
    sized = regions.withColumn("rows", F.count(F.lit(1)).over(of_leader))
    largest = sized.withColumn("largest", F.max(F.struct("rows", "leader")).over(of_node)["leader"])
    ends = largest.withColumn("low", F.min("largest").over(of_leader)).withColumn("high", F.max("largest").over(of_leader))
    return ends.where("low != high OR low = leader").select("leader", "node")


def region_links(docs: DataFrame, regions: DataFrame, sizes: DataFrame, met: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: links of regions (leader, node) that one task can join."""
    near = materialise(outermost(materialise(likely(regions, sizes, met, percent), "join-likely")), "join-near")
    sets = sets_of(docs, materialise(near.select("node").distinct(), "join-near-ids"), width)
    # Sets meet their regions where they are made, and then move once.
    small = near.count() <= BROADCAST_IDS
    held = sets.join(F.broadcast(near) if small else near, "node").withColumn("part", F.col("node")).groupBy("leader")
    return materialise(held.applyInPandas(joined(percent), "a long, b long").distinct(), "join-near-links")


def large_region_links(docs: DataFrame, regions: DataFrame, sizes: DataFrame, width: int, percent: int) -> DataFrame:
    """The same of larger regions: by their pivots, then by rings, in blocks."""
    pairs = regions.where("node != leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    reached = distances(docs, materialise(pairs, "join-stars"), width, "join")
    links = materialise(reached.where(F.col("both") * 100 >= F.col("either") * F.lit(percent)).select("a", "b"), "join-links")
    held = lambda ids: sets_of(docs, ids, width)
    return links.union(complete(materialise(rings(regions, reached, percent), "join-rings"), links, sizes, held, joined(percent), "join-rest"))


def jaccard_join(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    docs = texts(df, id_col, text_col)
    all_rows = materialise(measured(docs, width), "join-measured")
    known = all_rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    sets = materialise(known.groupBy("set_key").agg(F.min("doc_id").alias("node")), "join-sets")
    reps = prefixes(without_copies(docs, known, sets), common_shingles(all_rows), width, percent)
    shared = gathered(reps, "join")
    regions = materialise(shared.select("leader", "node").distinct(), "join-regions")
    met = shared.groupBy("node").agg(F.count(F.lit(1)).alias("met"))
    of_node = known.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size")).distinct()
    sizes = materialise(regions.join(of_node, "node").groupBy("leader").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size")), "join-sizes")
    largest = of_node.groupBy("node").agg(F.max("size").alias("size"))
    fits = (F.col("rows") <= ROOM_ROWS) & (F.col("size") <= ROOM_SIZES)
    of_size = lambda fit: regions.join(sizes.where(fit).select("leader"), "leader", "left_semi")
    links = region_links(docs, of_size(fits), of_node, met, width, percent).union(large_region_links(docs, of_size(~fits), largest, width, percent))
    linked = components(links, "join-all")
    of_set = sets.join(linked, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    out = all_rows.select("doc_id", "n_shingles", "set_key").join(of_set, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op11_jaccard_join": op11_jaccard_join}
ORACLES = {
    "op11_jaccard_join": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
   ELSE list_distinct([array_to_string(words[i : i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, md5(array_to_string(list_sort(sh), chr(10))) AS key, sh FROM s),
c AS (SELECT key, min(doc_id) AS rep, any_value(n_shingles) AS n, any_value(sh) AS sh FROM n WHERE n_shingles > 0 GROUP BY key),
e AS (SELECT rep, n, unnest(sh) AS g FROM c),
rare AS (SELECT e.rep, e.n, e.g, row_number() OVER (PARTITION BY e.rep ORDER BY f.df, e.g) AS place FROM e JOIN (SELECT g, count(*) AS df FROM e GROUP BY g) f USING (g)),
pre AS (SELECT rep, n, g FROM rare WHERE place <= n - CAST(ceil(n * 0.8) AS BIGINT) + 1),
cand AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM pre x JOIN pre y ON x.g = y.g AND x.rep < y.rep AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
hit AS (SELECT a, b FROM cand JOIN c x ON x.rep = a JOIN c y ON y.rep = b
   WHERE 100 * len(list_intersect(x.sh, y.sh)) >= 80 * (x.n + y.n - len(list_intersect(x.sh, y.sh)))),
both_ways AS (SELECT a, b FROM hit UNION ALL SELECT b, a FROM hit),
reach(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
low AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a)
SELECT n.doc_id, n.n_shingles, coalesce(low.component, n.doc_id) AS component_id FROM n LEFT JOIN c ON c.key = n.key AND n.n_shingles > 0 LEFT JOIN low ON low.rep = c.rep""",
}
