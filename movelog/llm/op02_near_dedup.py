"""MinHash near-deduplication with odd sketches.

1. One pass over the texts gives each document its number of distinct shingles, a key of its whole
   set, band keys of MinHash samples, and an odd sketch: samples folded into a parity bitmap. Equal
   sets collapse to the smallest doc_id before anything else is compared.
2. Within a band bucket all members are held against one leader, a star instead of all pairs: the
   member whose buckets hold the most members in sum, as the least edited of a group's copies does.
   The population count of two sketches' XOR estimates their similarity; pairs that can reach the
   threshold are confirmed on their full shingle sets.
3. Buckets that still hold several components after that are searched completely: members outside
   the bucket's main component are held against all others of another component, in blocks of
   bounded size. A block's task tests sketches and then full sets, and only links come out of it
   that join what it has not joined yet, so that a bucket gives fewer links than members.
4. Confirmed links are joined into components.

With 30 bands of 5 samples a pair at similarity 0.8 shares no bucket in 7 of a million cases. The
sketch is made of up to 4096 one-permutation samples, more than the bands need; its test lies SIGMAS
standard deviations, which depend on the sets' sizes, below the threshold. Sets whose union has few
shingles skip it and are confirmed on full sets straight away.

Defined results: null or empty texts have no shingles and are linked with nothing; rows that repeat
a doc_id count as one document in links and give one row each; a null doc_id is linked with nothing,
has a null component and is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import Judge, complete, gathered, searched, stars
from .common import BROADCAST_IDS, blocks, map_frames, materialise, table, texts
from .components import components
from .shingles import mix, shingle_sets

BANDS, ROWS = 30, 5
SAMPLES = BANDS * ROWS
BIN_BITS = 12
SKETCH_BITS = 4096
SKETCH_WORDS = SKETCH_BITS // 64
#: The sketch test's distance from the threshold: standard deviations, and a least share.
SIGMAS, SLACK = 6, 0.05
#: Pairs whose union would have fewer shingles at the least similarity pass the sketch test.
EXACT_UNION = 100

_RNG = np.random.default_rng(7)
_XOR = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES x len(sets) MinHash samples; no set is empty."""
    h = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((SAMPLES, len(sets)), np.uint32)
    for k in range(SAMPLES):
        x = (h ^ _XOR[k]) * _MUL[k]
        out[k] = np.minimum.reduceat(x ^ (x >> np.uint32(15)), starts)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """len(sets) x BANDS keys; a key is of one band only."""
    grouped = samples.reshape(BANDS, ROWS, -1).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = mix(key + grouped[:, r])
    return key.T.view(np.int64)


def odd_sketch(shingles: np.ndarray) -> tuple[np.ndarray, int]:
    """The parity bitmap of a set's one-permutation samples, and how many samples it has.

    The hashes are sorted, so the first one with each value of the top bits is that bin's minimum.
    Bit p is the parity of how many samples fall on p.
    """
    top = shingles >> np.uint64(64 - BIN_BITS)
    samples = shingles[np.concatenate([[True], top[1:] != top[:-1]])]
    parity = (np.bincount((mix(samples) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view("<i8"), len(samples)


def features(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key, bands, sketch, bins; all but the first two are null without shingles."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames):
            sets = shingle_sets(frame.text.tolist(), width)
            full = [k for k, s in enumerate(sets) if len(s)]
            out = pd.DataFrame({"doc_id": frame.doc_id.array, "n_shingles": [len(s) for s in sets], "set_key": None, "bands": None, "sketch": None, "bins": None})
            if full:
                samples = min_hashes([sets[k] for k in full])
                rows: list[tuple] = [(None, None, None, None)] * len(sets)
                for k, band in zip(full, band_keys(samples), strict=True):
                    rows[k] = (hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), band, *odd_sketch(sets[k]))
                for name, values in zip(("set_key", "bands", "sketch", "bins"), zip(*rows, strict=True), strict=True):
                    out[name] = pd.Series(values, dtype="Int32" if name == "bins" else object)
            yield out

    return map_frames(docs, run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>, bins int")


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """node, shingles: the full sets of the documents with these ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames):
            yield pd.DataFrame({"node": frame.doc_id, "shingles": [s.view(np.int64) for s in shingle_sets(frame.text.tolist(), width)]})

    small = ids.count() <= BROADCAST_IDS
    wanted = docs.join(F.broadcast(ids) if small else ids, docs.doc_id == ids.node, "left_semi")
    return map_frames(wanted, run, "node long, shingles array<long>")


class Arrays:
    """The functions of columns that the sketch test takes, for numpy arrays."""

    exp, log, sqrt, greatest = np.exp, np.log, np.sqrt, np.maximum


def similar(a: str, b: str, least: float) -> Column:
    """Do two sketches allow the similarity: for the columns n, bins, s0, s1, ... under the prefixes a and b."""
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}s{k}").bitwiseXOR(F.col(f"{b}s{k}"))) for k in range(SKETCH_WORDS)])
    chance = F.greatest(1 - 2 * bits / SKETCH_BITS, F.lit(1e-9))
    return allowed(chance, F.col(f"{a}n") + F.col(f"{b}n"), F.col(f"{a}bins") + F.col(f"{b}bins"), least, F)


def allowed(chance, sizes, bins, least: float, by):
    """The test itself, for columns (by: functions) or arrays (by: Arrays).

    The XOR's population count estimates how many samples differ, so how many are equal. Sets of the
    least similarity have a union of sizes / (1 + least), which fills so many bins, of whose
    samples that share is equal. 2 more is what one bin that two members share costs a small set.
    """
    differ = by.log(chance) * (-SKETCH_BITS / 2)
    union = sizes / (1 + least)
    filled = (1 - by.exp(-union / (1 << BIN_BITS))) * (1 << BIN_BITS)
    return (union < EXACT_UNION) | (bins - differ >= 2 * (least * filled - slack(union, least, by)) - 2)


def slack(union, least: float, by=F):
    """How many equal samples fewer than expected the sketch test allows.

    Their variance: which bins are filled, which of their samples are equal, and the estimate of the
    samples that differ, 2 * (1 - least) of the filled bins, from the sketch's bits.
    """
    bins = 1 << BIN_BITS
    free = by.exp(-union / bins)
    filled = (1 - free) * bins
    variance = least * (1 - least) * filled + least**2 * bins * free * (1 - (1 + union / bins) * free) + SKETCH_BITS / 16 * (by.exp(filled * (8 * (1 - least) / SKETCH_BITS)) - 1)
    return by.greatest(SIGMAS * by.sqrt(variance), SLACK * filled)


def judged(percent: int) -> Judge:
    """Pairs of a block whose sizes and sketches allow the similarity are compared on their full sets."""

    def judge(rows: pd.DataFrame) -> Callable[[int, np.ndarray], np.ndarray]:
        codes = np.unique(np.concatenate(rows["shingles"].to_list()), return_inverse=True)[1]
        at = np.concatenate([[0], np.cumsum(rows["shingles"].str.len())]).tolist()
        own = [codes[a:b] for a, b in zip(at, at[1:], strict=False)]
        mark = np.zeros(int(codes.max()) + 1, bool)
        n, bins, sketch = rows["n"].to_numpy(), rows["bins"].to_numpy(), np.stack(rows["sketch"]).view(np.uint64)

        def linked(k: int, near: np.ndarray) -> np.ndarray:
            out = np.minimum(n[near], n[k]) * 100 >= np.maximum(n[near], n[k]) * percent
            at = np.flatnonzero(out)
            bits = np.bitwise_count(sketch[near[at]] ^ sketch[k]).sum(axis=1, dtype=np.int64)
            out[at] = allowed(np.maximum(1 - 2 * bits / SKETCH_BITS, 1e-9), n[near[at]] + n[k], bins[near[at]] + bins[k], percent / 100, Arrays)
            some = near[out]
            if len(some):
                mark[own[k]] = True
                both = np.add.reduceat(mark[np.concatenate([own[m] for m in some.tolist()])], np.cumsum(n[some]) - n[some], dtype=np.int64)
                mark[own[k]] = False
                out[out] = both * 100 >= percent * (n[some] + n[k] - both)
            return out

        return linked

    return judge


def confirmed(docs: DataFrame, pairs: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{name}-ids")
    sets = materialise(sets_of(docs, ids, width), f"{name}-sets")
    held = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    counted = held.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("both"), (F.size("sa") + F.size("sb")).cast("long").alias("sum"))
    return materialise(counted.where(F.col("both") * 100 >= F.lit(percent) * (F.col("sum") - F.col("both"))).select("a", "b"), f"{name}-links")


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    docs = texts(df, id_col, text_col)
    all_rows = materialise(features(docs, width), "near-features")
    known = all_rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    # Equal sets meet in partial sums before the shuffle, however many copies there are.
    grouped = known.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("bins").alias("bins"))
    reps = materialise(grouped, "near-reps")
    sketches = reps.select("node", "n", "bins", *[F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH_WORDS)])
    shared = gathered(reps, "near")

    def side(letter: str) -> DataFrame:
        return sketches.select([F.col(c).alias(letter if c == "node" else letter + c) for c in sketches.columns])

    def likely(left: str, right: str) -> Column:
        sizes = F.least(F.col(f"{left}n"), F.col(f"{right}n")) * 100 >= F.greatest(F.col(f"{left}n"), F.col(f"{right}n")) * percent
        return sizes & similar(left, right, percent / 100)

    pairs = materialise(stars(shared).join(side("b"), "b").join(side("a"), "a").where(likely("a", "b")).select("a", "b"), "near-stars")
    links = confirmed(docs, pairs, width, percent, "near-stars")
    held = lambda ids: sets_of(docs, ids, width).join(reps.select("node", "n", "bins", "sketch", "bands"), "node")
    more = complete(shared, links, reps.select("node", F.col("n").alias("size")), held, searched(judged(percent)), "near-rest")
    linked = components(links.union(more), "near-all")

    of_set = reps.select("set_key", "node").join(linked, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    out = all_rows.select("doc_id", "n_shingles", "set_key").join(of_set, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose document is kept, with all their columns."""
    gone = materialise(found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")), "near-gone")
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"] == gone["__gone"], "left_anti")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


QUERIES = {"op2_near_dedup": op2_near_dedup}
ORACLES = {
    "op2_near_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
   ELSE list_distinct([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) END AS sh FROM w),
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
SELECT n.doc_id, n.n_shingles, coalesce(low.component, n.doc_id) AS component_id, coalesce(low.component, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN c ON c.key = n.key AND n.n_shingles > 0 LEFT JOIN low ON low.rep = c.rep""",
}
