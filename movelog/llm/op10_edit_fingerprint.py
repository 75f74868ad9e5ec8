"""Document fingerprints by a randomised edit embedding.

One walk goes over each whole text: at step j it writes the character under the cursor, and a
random bit shared by all texts, chosen by j and the character, says whether the cursor moves on. Two
texts a few edits apart fall into step again, so their edit distance becomes a Hamming distance; at
anchors, which the characters around them make, a cursor waits for a step of a fixed multiple, so
that many edits in a long text do not add up.
The fingerprint samples SAMPLES coordinates of the embedding and keeps 4 bits of the characters
found there. Coordinates are drawn in groups by consistent sampling: for each group the last record
of one shared random sequence below the embedding's length, so texts of nearly one length share
nearly all coordinates.

Near texts are found by banding fingerprints, with the bits of a group as a band. Each member of a
bucket is held against the likeliest leader of its buckets, against all others where that one is not near, and `near_texts` searches what stays
apart completely in bounded blocks; pairs of like fingerprints are verified by the edit distance of
their whole texts.

Defined results: a null or empty text has the fingerprint of no coordinates (all 0) and is as like
to another empty text as 1, to any other text as 0; equal texts have equal fingerprints; rows that
repeat a doc_id follow one another in the order of a hash of their texts; rows with a null doc_id come
first, and are near nothing; a single row is its own next; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import cycle, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import Judge, complete, gathered, searched
from .common import BROADCAST_IDS, blocks, map_frames, materialise, table, texts
from .components import components
from .shingles import mix

#: A fingerprint has GROUPS groups of DIGITS coordinates, APART steps from each other: a walk that is in
#: step is so for a whole group, so that a group serves as a band. The first BANDS groups do.
GROUPS, DIGITS, APART = 16, 8, 8
SAMPLES = GROUPS * DIGITS
BANDS = 12
#: Rows of random bits; step j takes row j modulo this. Characters share bits modulo CHARS - 1.
STEPS, CHARS = 4096, 1024
GRAM = 4  # characters at a sampled coordinate
#: Anchors are places whose characters hash lower than all so near. A cursor leaves one only at a step
#: that is a multiple of WAITS[0], one anchor in RARER of WAITS[1] and so on, so that walks that have
#: drifted apart meet again.
NEAR_CHARS, WAITS, RARER = 32, (64, 512, 4096), 8
PACE, QUICK = 3.2, 2.3  # steps for each character: usual ones, and such as most walks do not undercut
#: Texts are near if their edit distance is at most this share of the longer one, in percent; the
#: likeness that fingerprints of such texts need to be compared.
NEAR_PERCENT, LIKENESS = 2, 0.15
CHAR_HASHES, PAIR_HASHES = 256, 512
MAX_RANGES = 50_000  # ranges of ids, for each of which the driver samples SAMPLED ids
SAMPLED = 16
#: Characters of texts whose walks run side by side.
WALK_CHARS = 3_000_000
#: Walks that are left when steps are taken one walk after another instead of side by side.
FEW_WALKS = 48
#: An edit distance up to this many is looked for diagonal by diagonal first.
FEW_EDITS = 40

_RNG = np.random.default_rng(1905)
_MOVE = _RNG.integers(0, 2, (STEPS, CHARS + len(WAITS)), dtype=np.uint8)
_MOVE[:, 0] = 0  # the end of a text, where the cursor stays
for _k, _steps in enumerate(WAITS):
    _MOVE[:, CHARS + _k] = np.arange(STEPS) % _steps == 0
_MOVE_ROWS = [row.tobytes() for row in _MOVE]
_WEIGHTS = _RNG.integers(1, 1 << 64, GRAM, dtype=np.uint64) | np.uint64(1)
_DRAWS = _RNG.integers(1, 1 << 64, GROUPS, dtype=np.uint64)
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def record_places(limit: float = 1e15) -> list[np.ndarray]:
    """For each group the record minima of a random sequence; the last one below n is uniform in 0..n-1."""
    rng, out = np.random.default_rng(77), []
    for _ in range(GROUPS):
        at, places = 0, [0]
        while at < limit:
            at = int((at + 1) / max(rng.random(), 1e-12))
            places.append(at)
        out.append(np.array(places, np.int64))
    return out


_PLACES = record_places()


def walked(lengths: np.ndarray) -> np.ndarray:
    """Steps over so many characters: not many more than bring the cursor to the end."""
    return np.ceil(PACE * lengths).astype(np.int64)


def low_points(values: np.ndarray, reach: int) -> np.ndarray:
    """Where a value is less than all of `reach` before and after it."""
    n, width, low = len(values), 1, values.copy()  # low: the least of so many from a place on
    while width * 2 <= reach:
        low[: n - width] = np.minimum(low[: n - width], low[width:])
        width *= 2
    low[: n - (reach - width)] = np.minimum(low[: n - (reach - width)], low[reach - width :])
    out = np.zeros(n, bool)
    out[reach : n - reach] = (values[reach : n - reach] < low[reach + 1 : n - reach + 1]) & (values[reach : n - reach] < low[: n - 2 * reach])
    return out


def sampled(lengths: np.ndarray) -> np.ndarray:
    """len(lengths) x SAMPLES coordinates of embeddings of these lengths; -1 for length 0."""
    first = np.stack([p[np.maximum(np.searchsorted(p, lengths) - 1, 0)] for p in _PLACES], axis=1)
    out = np.minimum(first[:, :, None] + APART * np.arange(DIGITS), lengths[:, None, None] - 1)
    return out.reshape(len(lengths), SAMPLES)


def laid_out(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts in a row, with room around each, where each begins, and for each place the hash of its characters and its kind of step."""
    gap = np.zeros(NEAR_CHARS + GRAM, np.uint32)
    flat = np.concatenate([gap, *(x for c in codes for x in (c + np.uint32(1), gap))])
    lengths = np.array([len(c) for c in codes], np.int64)
    starts = np.cumsum(lengths + len(gap)) - lengths
    gram = flat * _WEIGHTS[0]
    for k in range(1, GRAM):
        gram[: len(flat) - k] += flat[k:] * _WEIGHTS[k]
    gram = mix(gram)
    line = np.where(flat > 0, (flat - np.uint32(1)) % (CHARS - 1) + 1, 0).astype(np.uint16)  # class 0 is the stop alone
    height = np.where(flat > 0, (gram >> np.uint64(33)).astype(np.uint32), np.uint32(1 << 31))
    anchors = np.flatnonzero(low_points(height, NEAR_CHARS))
    for k in range(len(WAITS)):
        line[anchors] = CHARS + k
        anchors = anchors[mix(gram[anchors] + np.uint64(k + 1)) % np.uint64(RARER) == 0]
    return flat, starts, gram, line


def cursors(line: np.ndarray, starts: np.ndarray, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Where the cursor of each of some rows is at a step; all walks take their steps together, those of many steps first."""
    if not len(rows):
        return np.zeros(0, np.int64)
    need = np.zeros(len(starts), np.int64)
    np.maximum.at(need, rows, places + 1)
    order = np.argsort(-need, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by_place = np.argsort(places, kind="stable")
    row, steps = rank[rows[by_place]], int(need[order[0]])
    edges = np.searchsorted(places[by_place], np.arange(steps + 1)).tolist()
    alive = (len(need) - np.searchsorted(np.sort(need), np.arange(steps), side="right")).tolist()
    cursor, found = starts[order].copy(), np.zeros(len(rows), np.int64)
    kind, move = np.empty(len(order), np.uint16), np.empty(len(order), np.uint8)
    many = next((j for j, k in enumerate(alive) if k <= FEW_WALKS), steps)
    for j in range(many):
        a, b = edges[j], edges[j + 1]
        if a < b:
            found[a:b] = cursor[row[a:b]]
        k = alive[j]
        np.take(line, cursor[:k], out=kind[:k], mode="clip")
        np.take(_MOVE[j % STEPS], kind[:k], out=move[:k], mode="clip")
        cursor[:k] += move[:k]
    place = places[by_place]
    for r in range(alive[many] if many < steps else 0):  # the few longest go on one by one
        events = np.flatnonzero((row == r) & (place >= many))
        ahead, at, j = line[cursor[r] : cursor[r] + place[events[-1]] - many + 1].tolist(), 0, many
        moves = islice(cycle(_MOVE_ROWS), many % STEPS, None)
        for e in events.tolist():
            for bits in islice(moves, int(place[e]) - j):
                at += bits[ahead[at]]
            j, found[e] = int(place[e]), cursor[r] + at
    out = np.empty(len(rows), np.int64)
    out[by_place] = found
    return out


def drawn(flat: np.ndarray, starts: np.ndarray, gram: np.ndarray, rows: np.ndarray, columns: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The digits at cursors. One on the end stands for the last characters.

    Each group draws them by itself: where two walks wait long, groups agree by chance one by one.
    """
    at = np.where(flat[at] > 0, at, np.maximum(at - GRAM, starts[rows]))
    return (mix(gram[at] ^ _DRAWS[columns // DIGITS]) >> np.uint64(60)).astype(np.uint8)


def codes_of(batch: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in batch]


def digits_of(batch: list[str]) -> np.ndarray:
    """len(batch) x SAMPLES values of 4 bits."""
    return digits_of_edited(batch, [], [])[0]


def digits_of_edited(batch: list[str], changed: list[str], same: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The digits of texts, and of texts that have as many first characters in common with those at the same place.

    Until it sees the change, the walk over a changed text is that over the text itself; it goes on
    from a step that is a multiple of STEPS before that, where the random bits begin anew.
    """
    codes, lengths = codes_of(batch), np.array([len(t) for t in batch], np.int64)
    values, others = np.zeros((len(batch), SAMPLES), np.uint8), np.zeros((len(changed), SAMPLES), np.uint8)
    spots = sampled(walked(lengths))
    flat, starts, gram, line = laid_out(codes)
    row, column = np.nonzero(spots >= 0)
    edited_length = np.array([len(t) for t in changed], np.int64)
    seen = np.array(same, np.int64) - NEAR_CHARS - 2 * GRAM  # up to there all places are as in the text itself
    leave = np.maximum(seen * QUICK, 0).astype(np.int64) // STEPS * STEPS
    their_spots = sampled(walked(edited_length))
    their_row, their_column = np.nonzero(their_spots >= 0)
    place = their_spots[their_row, their_column]
    early, turn = np.flatnonzero(place < leave[their_row]), np.flatnonzero(leave > 0)
    at = cursors(line, starts, np.concatenate([row, turn, their_row[early]]), np.concatenate([spots[row, column], leave[turn], place[early]]))
    at, at_turn, at_early = np.split(at, [len(row), len(row) + len(turn)])
    values[row, column] = drawn(flat, starts, gram, row, column, at)
    if not len(changed):
        return values, others
    cursor = np.zeros(len(changed), np.int64)
    cursor[turn] = at_turn - starts[turn]
    fits = cursor <= seen  # a walk that was quicker has seen the change already and starts from the beginning
    cursor, leave = np.where(fits, cursor, 0), np.where(fits, leave, 0)
    good = fits[their_row[early]]
    early = early[good]
    others[their_row[early], their_column[early]] = drawn(flat, starts, gram, their_row[early], their_column[early], at_early[good])
    late = np.setdiff1d(np.arange(len(their_row)), early, assume_unique=True)
    begin = np.maximum(cursor - NEAR_CHARS - GRAM, 0)
    flat, starts, gram, line = laid_out([c[k:] for c, k in zip(codes_of(changed), begin.tolist(), strict=True)])
    row, column = their_row[late], their_column[late]
    at = cursors(line, starts + cursor - begin, row, place[late] - leave[row])
    others[row, column] = drawn(flat, starts, gram, row, column, at)
    return values, others


def hexadecimal(values: np.ndarray) -> list[str]:
    return [row.tobytes().decode() for row in _DIGITS[values]]


def likeness(a: np.ndarray, b: np.ndarray, empty_a: np.ndarray, empty_b: np.ndarray) -> np.ndarray:
    """The share of equal digits above what chance gives, from 0 to 1."""
    same = np.maximum(0.0, ((a == b).mean(axis=1) - 1 / 16) / (15 / 16))
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), same)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of every whole text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, limit=WALK_CHARS):
            batch = frame.text.tolist()
            yield pd.DataFrame({"doc_id": frame.doc_id.array, "n_chars": [len(t) for t in batch], "fingerprint": hexadecimal(digits_of(batch))})

    return map_frames(texts(df, id_col, text_col), run, "doc_id long, n_chars long, fingerprint string")


# ---------------------------------------------------------------- each text and its successor


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as much of the start of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compared(ids: list, batch: list[str]) -> pd.DataFrame:
    """Each text but the last with its edited text and its successor."""
    changed = [edited(a, b) for a, b in zip(batch, batch[1:], strict=False)]
    own, other = digits_of_edited(batch, changed, [len(t) - len(t) // 4 for t in batch[:-1]])
    none, none_changed = np.array([not t for t in batch]), np.array([not t for t in changed])
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "replace")).hexdigest()
    return pd.DataFrame(
        {
            "doc_id": pd.array(ids[: len(changed)], "Int64"),
            "n_chars": [len(t) for t in batch[:-1]],
            "edited_sha256": [sha(t) for t in changed],
            "fingerprint": hexadecimal(own[:-1]),
            "edited_fingerprint": hexadecimal(other),
            "near_edited": likeness(own[:-1], other, none[:-1], none_changed),
            "near_next": likeness(own[:-1], own[1:], none[:-1], none[1:]),
        }
    )


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def next_compared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_a_range: int = 2_000) -> DataFrame:
    """Fingerprints of each text and its edited text, and its likeness to that and to its successor.

    Ids are dealt into ranges at a bounded random sample of them, and each text moves once, packed,
    to the task of its range; a doc_id that the sample holds several times gets as many ranges, cut at
    the hash of the text. The first and the last text of each range come out beside the results
    and meet the neighbouring range's in a join of two rows for each range.
    """
    spark = df.sparkSession
    docs = texts(df, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    parts = min(max(1, -(-docs.count() // rows_a_range)), MAX_RANGES)
    drawn = docs.select("key").withColumn("draw", F.xxhash64(F.monotonically_increasing_id())).orderBy("draw").limit(SAMPLED * parts)
    sample = np.sort(np.array([r.key for r in drawn.collect()], np.int64))
    cuts = sample[[min(SAMPLED * k, len(sample) - 1) for k in range(1, parts)]] if parts > 1 else sample[:0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            key, order = (batch.column(c).to_numpy() for c in ("key", "tie"))
            low, high = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
            share = (order >> 32).astype(np.float64) / (1 << 32) + 0.5  # of the hash's range, 0 to 1
            at = low + np.where(high > low, np.minimum((high - low + 1) * share, high - low).astype(np.int64), 0)
            packed = pa.array([shrink.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), batch.column("key"), batch.column("tie"), batch.column("doc_id"), packed], names=["range", "key", "tie", "doc_id", "packed"])

    dealt = docs.withColumn("tie", F.xxhash64("text")).mapInArrow(pack, "range long, key long, tie long, doc_id long, packed binary")
    ordered = dealt.repartition(parts, "range").sortWithinPartitions("range", "key", "tie")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, batch, chars, now = [], [], 0, None

        def end(kind: str, k: int) -> pd.DataFrame:
            return pd.DataFrame({"doc_id": pd.array([ids[k]], "Int64"), kind: [now], "text": [batch[k]]})

        for frame in frames:
            for at, doc_id, packed in zip(frame["range"].tolist(), frame["doc_id"].tolist(), frame["packed"], strict=True):
                if at != now:
                    if batch:
                        yield from ([compared(ids, batch)] if len(batch) > 1 else [])
                        yield end("last_of", -1)
                    ids, batch, chars, now = [], [], 0, at
                ids.append(None if pd.isna(doc_id) else doc_id)
                batch.append(unpacked(packed))
                chars += len(batch[-1])
                if len(batch) == 1:  # the last row of a full block begins the next one, so this is a range's first
                    yield end("first_of", 0)
                elif chars > WALK_CHARS // 2:
                    yield compared(ids, batch)
                    ids, batch, chars = ids[-1:], batch[-1:], 0
        if batch:
            yield from ([compared(ids, batch)] if len(batch) > 1 else [])
            yield end("last_of", -1)

    found = materialise(map_frames(ordered, run, f"{COMPARED}, first_of long, last_of long, text string"), "edit-found")
    names = [c.split()[0] for c in COMPARED.split(", ")]
    ranges = sorted(r[0] for r in found.where("first_of IS NOT NULL").select("first_of").collect())
    after = F.broadcast(spark.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1], strict=True)), "last_of long, next long"))
    heads = found.where("first_of IS NOT NULL").select(F.col("first_of").alias("next"), F.col("text").alias("following"))
    tails = found.where("last_of IS NOT NULL").select("doc_id", "last_of", "text").join(after, "last_of").join(heads, "next")

    def close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc_id, text, following in zip(frame.doc_id.tolist(), frame.text, frame.following, strict=True):
                yield compared([None if pd.isna(doc_id) else doc_id], [text, following])

    closed = map_frames(tails.select("doc_id", "text", "following"), close, COMPARED)
    return found.where("first_of IS NULL AND last_of IS NULL").select(*names).union(closed)


# ---------------------------------------------------------------- near texts


def few_edits(x: bytes, y: bytes, most: int) -> bool:
    """Is the edit distance of two rows of 4-byte characters at most so large: the furthest place on each diagonal, edit by edit."""
    n, m = len(x) // 4, len(y) // 4

    def slide(i: int, k: int) -> int:
        step, end = 8, min(n, m - k)
        while step and i < end:
            step = min(step, end - i)
            if x[4 * i : 4 * (i + step)] == y[4 * (i + k) : 4 * (i + k + step)]:
                i += step
                step *= 2
            else:
                step //= 2
        return i

    far = {0: slide(0, 0)}
    for edits in range(most + 1):
        if far.get(m - n) == n:
            return True
        new = {}
        for k in range(max(-edits - 1, -n), min(edits + 1, m) + 1):
            i = min(max(far.get(k, -2) + 1, far.get(k - 1, -2), far.get(k + 1, -2) + 1), n, m - k)
            if i >= max(0, -k):
                new[k] = slide(i, k)
        far = new
    return False


def within(a: str, b: str, most: int) -> bool:
    """Is the edit distance of two texts at most so large: few edits by diagonals, more bit-parallel; what both begin and end with is left out."""
    if abs(len(a) - len(b)) > most:
        return False
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in (a, b))
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(x[::-1][: n - head] != y[::-1][: n - head])
    tail = int(differ[0]) if len(differ) else n - head
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or len(y) <= most:
        return len(y) <= most
    if few_edits(x.tobytes(), y.tobytes(), min(most, FEW_EDITS)):
        return True
    if most <= FEW_EDITS:
        return False
    masks = {int(c): int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") for c in np.unique(x)}
    full, top, distance, left = (1 << len(x)) - 1, 1 << (len(x) - 1), len(x), len(y)
    plus, minus = full, 0
    for c in y.tolist():
        equal = masks.get(c, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | (full & ~(across | plus)), plus & across
        distance += bool(up & top) - bool(down & top)
        left -= 1
        if distance - left > most:
            return False
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
    return distance <= most


def unpacked(packed: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass")


def near(a: str, b: str, percent: int) -> bool:
    """Is the edit distance at most so many percent of the longer text; counts of characters rule most others out."""
    most = max(len(a), len(b)) * percent // 100
    if abs(len(a) - len(b)) > most:
        return False
    (x, xx), (y, yy) = char_counts(a), char_counts(b)
    if np.maximum(x - y, 0).sum() > most or np.maximum(y - x, 0).sum() > most or np.abs(xx - yy).sum() > 4 * most:
        return False
    return within(a, b, most)


def char_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """How often each hash of one character and of two neighbouring ones occurs."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.bincount(x % CHAR_HASHES, minlength=CHAR_HASHES), np.bincount((x[:-1] * 31 + x[1:] * 1009) % PAIR_HASHES, minlength=PAIR_HASHES)


def judged(percent: int, least: float) -> Judge:
    """Pairs of a block whose fingerprints are alike are compared by their texts.

    An edit takes one character away and brings one at most, and changes two pairs of neighbouring
    ones of each text at most, so that counts which differ by more need no comparison.
    """

    def judge(rows: pd.DataFrame) -> Callable[[int, np.ndarray], np.ndarray]:
        prints = np.frombuffer("".join(rows["fingerprint"]).encode(), np.uint8).reshape(-1, SAMPLES)
        own = [unpacked(x) for x in rows["packed"]]
        size = np.array([len(t) for t in own])
        chars, pairs = (np.stack(x).astype(np.int32) for x in zip(*map(char_counts, own), strict=True))

        def linked(k: int, others: np.ndarray) -> np.ndarray:
            most = np.maximum(size[others], size[k]) * percent // 100
            out = (np.abs(size[others] - size[k]) <= most) & (((prints[others] == prints[k]).mean(axis=1) - 1 / 16) / (15 / 16) >= least)
            out[out] = np.maximum(chars[others[out]] - chars[k], 0).sum(axis=1) <= most[out]
            out[out] = np.maximum(chars[k] - chars[others[out]], 0).sum(axis=1) <= most[out]
            out[out] = np.abs(pairs[others[out]] - pairs[k]).sum(axis=1) <= 4 * most[out]
            out[out] = [near(own[k], own[m], percent) for m in others[out].tolist()]
            return out

        return linked

    return judge


def near_texts(df: DataFrame, percent: int = NEAR_PERCENT, least: float = LIKENESS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, near_id: the smallest doc_id that steps between near texts reach; empty texts are near nothing.

    The search of what the leaders leave apart compares the texts of all like fingerprints of a
    bucket, which is long for large groups of texts that are a little less than near.
    """
    prints = materialise(fingerprints(df, id_col, text_col), "edit-prints")
    reps, shared, links, with_texts = near_leaders(df, prints, percent, least, id_col, text_col)
    more = complete(shared, links, reps.select("node", (F.col("n_chars") + SAMPLES).alias("size")), with_texts, searched(judged(percent, least)), "edit-rest")
    linked = components(links.union(more), "edit-all")
    of_print = reps.join(linked, "node", "left").select("fingerprint", "n_chars", F.coalesce("component", "node").alias("near_id"))
    return prints.join(of_print, ["fingerprint", "n_chars"], "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("near_id", "doc_id")).alias("near_id"))


def near_leaders(df: DataFrame, prints: DataFrame, percent: int, least: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """One node for each fingerprint, buckets, verified links of members with the likeliest leader that is near, and packed texts by nodes.

    Equal fingerprints collapse first; their texts are equal but for a chance of 2^-64 and less for
    other texts with the same 4-grams at all places.
    """
    docs = texts(df, id_col, text_col).where("doc_id IS NOT NULL")
    known = prints.where("doc_id IS NOT NULL AND n_chars > 0")
    # A walk that waits at an anchor writes one digit again and again: such a group says too little to be a band.
    groups = [F.substring("fingerprint", k * DIGITS + 1, DIGITS) for k in range(BANDS)]
    varied = lambda g: F.size(F.array_distinct(F.split(g, ""))) > DIGITS // 2
    bands = [F.when(varied(g), F.xxhash64(F.lit(k), g)).otherwise(F.xxhash64(F.lit(-1 - k), "node")) for k, g in enumerate(groups)]
    reps = materialise(known.groupBy("fingerprint", "n_chars").agg(F.min("doc_id").alias("node")).withColumn("bands", F.array(*bands)), "edit-reps")
    shared = gathered(reps, "edit")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shrink = zstandard.ZstdCompressor(level=3)
        for frame in frames:
            yield pd.DataFrame({"node": frame.doc_id.array, "packed": [shrink.compress(t.encode("utf-8", "surrogatepass")) for t in frame.text]})

    def with_texts(ids: DataFrame) -> DataFrame:
        small = ids.count() <= BROADCAST_IDS
        found = docs.join(F.broadcast(ids) if small else ids, docs.doc_id == ids.node, "left_semi")
        few = map_frames(found, pack, "node long, packed binary").groupBy("node").agg(F.min("packed").alias("packed"))
        return few.join(reps.select("node", "fingerprint", "bands"), "node")

    # Each member meets its buckets' leaders, the likeliest first and, where that one is not near, all others; the search of the rest finds what that misses.
    # Texts whose lengths differ by more than the edits allowed are not near, so that they need not move.
    side = lambda c: reps.select(F.col("node").alias(c), F.col("fingerprint").alias(f"f{c}"), F.col("n_chars").alias(f"n{c}"))
    allowed = F.expr(f"abs(na - nb) <= greatest(na, nb) * {int(percent)} div 100")
    same = F.aggregate(F.zip_with(F.split("fa", ""), F.split("fb", ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    led = shared.where("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    alike = led.join(side("b"), "b").join(side("a"), "a").where(allowed).withColumn("like", (same / SAMPLES - 1 / 16) / (15 / 16)).where(F.col("like") >= least)
    ranked = F.reverse(F.array_sort(F.collect_list(F.struct("like", "b"))))  # BANDS leaders at most
    stars = materialise(alike.groupBy("a").agg(ranked.alias("leaders")), "edit-stars")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.loc[[near(unpacked(x), unpacked(y), percent) for x, y in zip(frame.pa, frame.pb, strict=True)], ["a", "b", "like"]]

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs a, b, like whose texts are near."""
        ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{name}-ids")
        own = materialise(with_texts(ids).select("node", "packed"), f"{name}-texts")
        held = pairs.join(own.select(F.col("node").alias("b"), F.col("packed").alias("pb")), "b").join(own.select(F.col("node").alias("a"), F.col("packed").alias("pa")), "a")
        return materialise(map_frames(held.select("a", "b", "like", "pa", "pb"), verify, "a long, b long, like double"), f"{name}-links")

    first = verified(stars.select("a", F.get("leaders", F.lit(0))["b"].alias("b"), F.get("leaders", F.lit(0))["like"].alias("like")), "edit-star")
    others = stars.where(F.size("leaders") > 1).join(first.select("a"), "a", "left_anti")
    others = materialise(others.select("a", F.explode(F.slice("leaders", 2, BANDS)).alias("leader")).select("a", "leader.b", "leader.like"), "edit-others")
    more = verified(others, "edit-other") if others.take(1) else first.limit(0)
    best = more.groupBy("a").agg(F.max(F.struct("like", "b"))["b"].alias("b"))
    links = materialise(first.select("a", "b").union(best), "edit-links")
    return reps, shared, links, with_texts


def fingerprinted(df: DataFrame, percent: int = NEAR_PERCENT, least: float = LIKENESS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """next_compared with near_leader: the document with an equal text or, verified, a near one that leads a bucket; null for none."""
    found = next_compared(df, id_col, text_col)
    reps, _, links, _ = near_leaders(df, found, percent, least, id_col, text_col)
    leader = reps.join(links, reps.node == links.a, "left").select("fingerprint", "n_chars", F.coalesce("b", "node").alias("near_leader"))
    rows = found.join(leader, ["fingerprint", "n_chars"], "left")
    names = [c.split()[0] for c in COMPARED.split(", ")]
    return rows.select(*names, F.when(F.col("near_leader") != F.col("doc_id"), F.col("near_leader")).alias("near_leader"))


def op10_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))


QUERIES = {"op10_edit_fingerprint": op10_edit_fingerprint}
ORACLES: dict[str, str] = {}
