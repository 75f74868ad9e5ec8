"""Toxicity: a convolutional text classifier trained in numpy.

A word's vector is the mean of hashed embeddings of the word and its prefixes, so that unseen words
of a known stem are recognised. Filters of one to three words run over the whole text, the maximum
of each is kept, and a linear layer gives the logit. As a filter's answer to a word depends on that
word alone, tasks compute answers once for each distinct word and add them along the texts.

The network is fitted on all labelled rows (an id that repeats counts once), in tasks: parts of the rows
train by themselves for an epoch, and their changes are averaged. Four fifths of the rows train; the
other fifth sets the thresholds: one for all texts, which the scores are shifted to put at 0.3, and one
for each language with examples of both classes, drawn towards the common one where they are few. Labels, lang, source and doc_id never enter a
score; lang only selects the threshold of the operator's own verdict. Scoring is one pass without a
shuffle.

Defined results: a null or empty text gets the score of no words; without labelled rows of both
classes all scores are 0; repeated rows give one row each; labels that are null are not used; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, map_frames, materialise, small_batches, table

PART_ROWS, TRAINERS = 6_000, 64  # labelled rows of a part, until there are so many parts
EPOCHS, FEW = 4, 200  # fewer labelled rows than that both train and set the thresholds
SLICE = 4_096  # rows of the network whose changes one task averages
DENSE = ("kernels", "bias", "out")
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 16, 8, (1, 2, 3)
PREFIXES = (3, 4, 5, 6, 7)
PLAIN = 0.3  # the score at the common threshold
POOLED = 20  # rows of a class at which a language's own threshold weighs as much as the common one
KEPT_WORDS = 100_000
_WORDS = re.compile(r"\w+").findall


def hashed(word: str) -> list[int]:
    """The embedding rows of a word: itself and its prefixes; a short word's prefixes are itself."""
    raw = [word, *(f"{n}<{word[:n]}" for n in PREFIXES)]
    return [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in raw]


class Words:
    """Distinct words numbered from 1 in order of appearance; 0 stands around texts."""

    def __init__(self) -> None:
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = lambda: len(self.index) + 1

    def number(self, text: str) -> np.ndarray:
        """The words of a text, and after them the padding that the widest filter needs."""
        words = _WORDS(text.lower())
        out = np.zeros(len(words) + WIDTHS[-1], np.int32)
        out[: len(words)] = np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))
        return out


@dataclass
class Network:
    emb: np.ndarray
    kernels: np.ndarray  # DIM x (1 + 2 + 3) x FILTERS
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    common: float = 0.0  # the logit of the common threshold
    thresholds: dict[str, float] = field(default_factory=dict)  # logits by language

    def answers(self, ids: np.ndarray) -> np.ndarray:
        """Words x (6 * FILTERS): each kernel part's answer to each word; ids: words x hashed rows."""
        vectors = np.zeros((len(ids), DIM), np.float32)
        for k in range(ids.shape[1]):
            vectors += self.emb[ids[:, k]]
        return vectors / ids.shape[1] @ self.kernels.reshape(DIM, -1)

    def pooled(self, answers: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Texts x (3 * FILTERS): the maximum of each filter; a window may begin on a text's first padding."""
        out, part = [], 0
        for width in WIDTHS:
            held = answers[:, part * FILTERS : (part + 1) * FILTERS][words]
            for k in range(1, width):
                held[:-k] += answers[:, (part + k) * FILTERS : (part + k + 1) * FILTERS][words[k:]]
            part += width
            # Windows that would reach the next text begin on a text's last paddings: they must not count.
            ends = np.concatenate([starts[1:], [len(words)]])
            for k in range(1, width):
                held[ends - k] = held[ends - WIDTHS[-1]]
            out.append(np.maximum.reduceat(held, starts, axis=0))
        return np.concatenate(out, axis=1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.shift

    def score(self, logits: np.ndarray) -> np.ndarray:
        """0 to 1, with the common threshold at PLAIN."""
        return 1 / (1 + np.exp(-np.clip(logits - self.common + np.log(PLAIN / (1 - PLAIN)), -500, 500)))


def starts_of(texts: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([0] + [len(t) for t in texts[:-1]])


def log_odds(ids: np.ndarray, texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The log-odds of each embedding row, from texts."""
    counts = np.zeros((2, BUCKETS))
    for text, label in zip(texts, labels.tolist(), strict=True):
        counts[label, np.unique(ids[np.unique(text)])] += 1
    return odds_of(counts, np.bincount(labels, minlength=2).astype(float))


def odds_of(counts: np.ndarray, size: np.ndarray, smooth: float = 2.0) -> np.ndarray:
    """For each embedding row how much likelier a toxic text is to have it than a clean one; counts and sizes by class."""
    size = size[:, None]
    rate = (counts + smooth) / (size + smooth)
    base = np.log(smooth / (size[1] + smooth)) - np.log(smooth / (size[0] + smooth))
    return (np.log(rate[1]) - np.log(rate[0]) - base).astype(np.float32)


class Trainer:
    """A network in training, with the sums of squares of Adagrad."""

    def __init__(self, net: Network):
        self.net, self.emb_seen, self.shift_seen = net, np.full(BUCKETS, 1e-2, np.float32), 1e-2
        self.seen = {k: np.full_like(getattr(net, k), 1e-2) for k in DENSE}

    def epoch(self, ids: np.ndarray, numbered: list[np.ndarray], labels: np.ndarray, order: np.ndarray, rate: float, batch: int = 32) -> None:
        """One pass over the texts in an order; ids: the hashed rows of each word."""
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            self.step(ids, [numbered[r] for r in rows], labels[rows], rate)

    def step(self, ids: np.ndarray, own: list[np.ndarray], labels: np.ndarray, rate: float) -> None:
        net = self.net
        flat, starts = np.concatenate(own), starts_of(own)
        used, flat = np.unique(flat, return_inverse=True)
        used_ids = ids[used]
        vectors = net.emb[used_ids].mean(axis=1)
        vectors[used == 0] = 0
        answers = vectors @ net.kernels.reshape(DIM, -1)
        ends = np.concatenate([starts[1:], [len(flat)]])
        best, tops, part = [], [], 0
        for width in WIDTHS:
            resp = answers[:, part * FILTERS : (part + 1) * FILTERS][flat]
            for k in range(1, width):
                resp[:-k] += answers[:, (part + k) * FILTERS : (part + k + 1) * FILTERS][flat[k:]]
            part += width
            spots = np.stack([a + resp[a : b - width + 1].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])
            best.append(spots)
            tops.append(np.take_along_axis(resp, spots, axis=0))
        pool = np.concatenate(tops, axis=1) + net.bias
        hidden = np.maximum(pool, 0)
        logit = hidden @ net.out + net.shift
        error = (1 / (1 + np.exp(-logit)) - labels).astype(np.float32) / len(labels)
        back = error[:, None] * net.out * (pool > 0)
        grads = {"out": hidden.T @ error, "bias": back.sum(0), "kernels": np.zeros_like(net.kernels)}
        to_words = np.zeros_like(vectors)
        part = 0
        for n, width in enumerate(WIDTHS):
            for f in range(FILTERS):
                g = back[:, n * FILTERS + f]
                for k in range(width):
                    w = flat[best[n][:, f] + k]
                    grads["kernels"][:, part + k, f] += g @ vectors[w]
                    np.add.at(to_words, w, g[:, None] * net.kernels[:, part + k, f])
            part += width
        to_words[used == 0] = 0
        hit = np.flatnonzero(np.abs(to_words).sum(1) > 0)
        rows_hit, inverse = np.unique(used_ids[hit].ravel(), return_inverse=True)
        emb_grad = np.zeros((len(rows_hit), DIM), np.float32)
        np.add.at(emb_grad, inverse.ravel(), np.repeat(to_words[hit] / ids.shape[1], ids.shape[1], axis=0))
        self.emb_seen[rows_hit] += (emb_grad**2).mean(1)
        net.emb[rows_hit] -= 2 * rate * emb_grad / np.sqrt(self.emb_seen[rows_hit])[:, None]
        for k, g in grads.items():
            self.seen[k] += g**2
            setattr(net, k, getattr(net, k) - rate * g / np.sqrt(self.seen[k]))
        self.shift_seen += float(error.sum()) ** 2
        net.shift -= rate * float(error.sum()) / self.shift_seen**0.5

    def packed(self) -> np.ndarray:
        """Embeddings and their sums as a table of BUCKETS rows, all the rest as rows after them."""
        rest = np.concatenate([*[getattr(self.net, k).ravel() for k in DENSE], *[self.seen[k].ravel() for k in DENSE], [self.net.shift, self.shift_seen]]).astype(np.float32)
        rest = np.pad(rest, (0, -len(rest) % (DIM + 1))).reshape(-1, DIM + 1)
        return np.concatenate([np.concatenate([self.net.emb, self.emb_seen[:, None]], axis=1), rest])

    def unpack(self, table: np.ndarray) -> None:
        self.net.emb, self.emb_seen = table[:BUCKETS, :DIM].copy(), table[:BUCKETS, DIM].copy()
        rest, at = table[BUCKETS:].ravel(), 0
        for place, k in enumerate([*DENSE, *DENSE]):
            like = getattr(self.net, k)
            values = rest[at : at + like.size].reshape(like.shape).copy()
            at += like.size
            if place < len(DENSE):
                setattr(self.net, k, values)
            else:
                self.seen[k] = values
        self.net.shift, self.shift_seen = float(rest[at]), float(rest[at + 1])


def fresh(odds: np.ndarray, rng: np.random.Generator) -> Network:
    """A network before training.

    The first dimension starts as each row's smoothed log-odds between the classes, which the first
    filter of each width reads; training goes on from there.
    """
    net = Network(rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, sum(WIDTHS), FILTERS)).astype(np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, 0.3, np.float32))
    net.emb[:, 0] = odds
    net.kernels[:, :, 0] *= 0.1
    for part in (0, 1, 3):
        net.kernels[0, part, 0] = 1.0
    net.bias[::FILTERS] = -1.5
    net.out[::FILTERS] = 1.0
    net.shift = -1.0
    return net


def rate_of(epoch: int, epochs: int) -> float:
    return 0.1 * (1 - epoch / epochs) + 0.01


def train(texts: list[str], labels: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 3) -> Network | None:
    """What `fit` does, for a list of texts: four fifths of them are fitted on, the rest sets the thresholds."""
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    words = Words()
    numbered = [words.number(t) for t in texts]
    ids = np.array([hashed("")] + [hashed(w) for w in words.index], np.int32)
    order = rng.permutation(len(texts))
    held = order[: len(order) // 5]
    fitted = order[len(order) // 5 :]
    if len(set(labels[fitted].tolist())) < 2 or len(texts) < FEW:
        fitted = held = order
    trainer = Trainer(fresh(log_odds(ids, [numbered[r] for r in fitted], labels[fitted]), rng))
    for epoch in range(epochs):
        rng.shuffle(fitted)
        trainer.epoch(ids, numbered, labels, fitted, rate_of(epoch, epochs))
    net = trainer.net
    if len(held) and len(set(labels[held].tolist())) == 2:
        counts = pd.DataFrame({"lang": [langs[r] for r in held], "logit": logits_of(net, ids, [numbered[r] for r in held]), "toxic": labels[held], "n": 1})
        net.common = best_cut(counts)
        net.thresholds = {lang: cut for lang, own in counts.groupby("lang") if (cut := drawn_cut(own, net.common)) is not None}
    return net


def best_cut(rows: pd.DataFrame) -> float:
    """The logit with the fewest errors of both kinds, each class weighed as a whole; mid-gap. rows: logit, toxic, n."""
    by = rows.groupby(["logit", "toxic"])["n"].sum().unstack("toxic", fill_value=0).reindex(columns=[0, 1], fill_value=0)
    values, low, high = by.index.to_numpy(float), by[0].to_numpy(float), by[1].to_numpy(float)
    if len(values) == 1:
        return float(values[0])
    cuts = (values[1:] + values[:-1]) / 2
    missed = np.cumsum(high)[:-1] / max(high.sum(), 1)
    wrong = 1 - np.cumsum(low)[:-1] / max(low.sum(), 1)
    loss = missed + 3 * wrong  # clean texts are many more: a false alarm weighs more
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    return float(cuts[best[len(best) // 2]])


def drawn_cut(rows: pd.DataFrame, common: float) -> float | None:
    """A language's own threshold, drawn towards the common one where a class has few rows; None where it has none."""
    few = int(min(rows.n[rows.toxic == 1].sum(), rows.n[rows.toxic == 0].sum()))
    share = few / (few + POOLED)
    return share * best_cut(rows) + (1 - share) * common if few else None


def logits_of(net: Network, ids: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    used, inverse = np.unique(np.concatenate(texts), return_inverse=True)
    answers = net.answers(ids[used])
    answers[used == 0] = 0
    return net.logits(net.pooled(answers, inverse, starts_of(texts)))


def in_fold(id_col: str = "doc_id") -> Column:
    """The remainder that holds a row out of all fitting."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """The rows with their part by doc_id, each part in a partition of its own."""
    return rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(parts)).cast("int")).repartitionById(parts, "part")


def examples(docs: DataFrame, labels: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, toxic, text, lang (and part, draw) of every labelled row that is not held out; an id that repeats counts once.

    With parts, texts move once: labels, in tables of any size, meet them where both have been dealt, and the
    sort that finds repeated ids is by draw, a hash, which is the order that a part is read in.
    """
    wanted = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~in_fold())
    rows = wanted.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), F.col("toxic").cast("int").alias("toxic"))
    own = docs.where("doc_id IS NOT NULL").where(~in_fold()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    if parts is None:
        met, place = own.join(rows.distinct(), "doc_id"), []
    else:
        met, place = dealt(own, parts).join(dealt(rows, parts).distinct().hint("shuffle_hash"), ["part", "doc_id"]).withColumn("draw", F.xxhash64("doc_id")), ["part", "draw"]
    nth = F.row_number().over(Window.partitionBy(*place, "doc_id", "toxic").orderBy("text", "lang"))
    return met.withColumn("__nth", nth).where("__nth = 1").select("doc_id", "toxic", "text", "lang", *place)


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int = 3_000) -> pd.DataFrame:
    """The first examples of each class, to look at; nothing is fitted on them."""
    found = examples(docs, labels)
    few = reduce(DataFrame.union, [found.where(F.col("toxic") == c).orderBy("doc_id").limit(max_rows) for c in (0, 1)])
    return few.toPandas().sort_values(["doc_id", "toxic", "text"], kind="stable")


CODED = "part int, ids binary, flat binary, lengths array<int>, labels array<int>, langs array<string>, held array<boolean>"


def coded(found: DataFrame, parts: int) -> DataFrame:
    """The examples as numbers, written once in blocks: a part's blocks follow one another, in an order by hash."""
    small_batches(found.sparkSession)  # blocks do not depend on the session's batches
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)).cast("int") == 0
    own = found if "part" in found.columns else dealt(found, parts).withColumn("draw", F.xxhash64("doc_id"))
    own = own.withColumn("held", held).sortWithinPartitions("part", "draw", "doc_id", "toxic")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, rows in frame.groupby("part", sort=False):
                for block in blocks([rows]):
                    words = Words()
                    numbered = [words.number(t) for t in block.text.tolist()]
                    ids = np.array([hashed("")] + [hashed(w) for w in words.index], np.uint16)  # BUCKETS is 2^16
                    yield pd.DataFrame({"part": [part], "ids": [ids.tobytes()], "flat": [np.concatenate(numbered).tobytes()], "lengths": [list(map(len, numbered))], "labels": [block.toxic.tolist()], "langs": [block.lang.tolist()], "held": [block.held.tolist()]})

    return materialise(map_frames(own.select("part", "held", "toxic", "text", "lang"), run, CODED), "toxicity-coded")


def block_of(row: object) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """The hashed rows of a block's words, its texts as numbers, its labels, and which of its rows set thresholds."""
    ids = np.frombuffer(row.ids, np.uint16).reshape(-1, 1 + len(PREFIXES)).astype(np.int32)
    texts = np.split(np.frombuffer(row.flat, np.int32), np.cumsum(row.lengths)[:-1])
    return ids, texts, np.array(row.labels, np.int64), np.array(row.held, bool)


def fit(docs: DataFrame, labels: DataFrame, epochs: int = EPOCHS) -> Network | None:
    """Fits on all labelled rows in tasks: four fifths of them train, the other fifth sets the thresholds; few rows do both.

    Every epoch each part of the rows trains from the common network by itself, and the changes are
    averaged, an embedding row's over the parts that have changed it. What comes to the driver is as
    large as the network: TRAINERS parts at most are added up by slices of its rows in other tasks.
    """
    spark = docs.sparkSession
    n = labels.where("toxic IN (0, 1)").where(~in_fold()).count()
    parts = min(max(1, n // PART_ROWS), TRAINERS)
    rows = coded(examples(docs, labels, parts), parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)  # a row is a block
    try:
        return fit_coded(rows, epochs)
    finally:
        small_batches(spark)


def fit_coded(rows: DataFrame, epochs: int) -> Network | None:
    spark = rows.sparkSession
    sizes = rows.select(F.inline(F.arrays_zip("labels", "held"))).groupBy("labels", "held").count().collect()
    size = lambda *held: [sum(r["count"] for r in sizes if r["labels"] == c and r["held"] in held) for c in (0, 1)]
    if not all(size(False, True)):
        return None
    apart = all(size(False)) and sum(size(False, True)) >= FEW
    chosen = lambda held, fits: np.flatnonzero((held != fits) if apart else np.ones(len(held), bool))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, BUCKETS), np.int64)
        for frame in frames:
            for row in frame.itertuples():
                ids, texts, labels, held = block_of(row)
                for r in chosen(held, True):
                    total[labels[r], np.unique(ids[np.unique(texts[r])])] += 1
        some = np.flatnonzero(total.any(axis=0))
        yield pd.DataFrame({"bucket": some, "clean": total[0, some], "toxic": total[1, some]})

    found = map_frames(rows, count, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    counts = np.zeros((2, BUCKETS))
    counts[0, found.bucket], counts[1, found.bucket] = found.clean, found.toxic
    trainer = Trainer(fresh(odds_of(counts, np.array(size(False) if apart else size(False, True), float)), np.random.default_rng(3)))
    for epoch in range(epochs):
        before = trainer.packed()
        sent = spark.sparkContext.broadcast(before)

        def learn(frames: Iterator[pd.DataFrame], sent=sent, epoch=epoch) -> Iterator[pd.DataFrame]:
            now, own = None, None
            for frame in frames:
                for row in frame.itertuples():
                    if row.part != now:
                        if own is not None:
                            yield changes(own, sent.value)
                        now, own = row.part, Trainer(fresh(np.zeros(BUCKETS, np.float32), np.random.default_rng(0)))
                        own.unpack(sent.value)
                        rng = np.random.default_rng([epoch, now])
                    ids, texts, labels, held = block_of(row)
                    own.epoch(ids, texts, labels, rng.permutation(chosen(held, True)), rate_of(epoch, epochs))
            if own is not None:
                yield changes(own, sent.value)

        moved = map_frames(rows, learn, "slice int, rows binary, change binary").groupBy("slice").applyInPandas(averaged, "slice int, rows binary, change binary").collect()
        for r in moved:
            at = np.frombuffer(r["rows"], np.int32)
            before[at] += np.frombuffer(r["change"], np.float32).reshape(-1, DIM + 1)
        trainer.unpack(before)
        sent.unpersist()
    net = trainer.net
    fitted = spark.sparkContext.broadcast(net)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                ids, texts, labels, held = block_of(row)
                if len(own := chosen(held, False)):
                    logits = np.clip(logits_of(fitted.value, ids, [texts[r] for r in own]), -100, 100)
                    yield pd.DataFrame({"lang": [row.langs[r] for r in own], "logit": np.round(logits.astype(float) * 256) / 256, "toxic": labels[own]})

    of_lang = materialise(map_frames(rows, judge, "lang string, logit double, toxic int").groupBy("lang", "logit", "toxic").agg(F.count(F.lit(1)).alias("n")), "toxicity-logits")
    common = of_lang.groupBy("logit", "toxic").agg(F.sum("n").alias("n")).toPandas()
    if common.toxic.nunique() == 2:
        net.common = cut = best_cut(common)
        own = of_lang.groupBy("lang").applyInPandas(lambda x: pd.DataFrame({"lang": x.lang[:1], "cut": [drawn_cut(x, cut)]}), "lang string, cut double")
        net.thresholds = {r["lang"]: r["cut"] for r in own.where("cut IS NOT NULL").collect()}
    return net


def changes(own: Trainer, before: np.ndarray) -> pd.DataFrame:
    """The rows of the network that a part has changed and by how much, in slices."""
    change = own.packed() - before
    rows = np.flatnonzero(change.any(axis=1)).astype(np.int32)
    cuts = [x for x in np.split(rows, np.searchsorted(rows, np.arange(SLICE, len(change), SLICE))) if len(x)]
    return pd.DataFrame({"slice": [int(x[0]) // SLICE for x in cuts], "rows": [x.tobytes() for x in cuts], "change": [change[x].tobytes() for x in cuts]})


def averaged(frame: pd.DataFrame) -> pd.DataFrame:
    """One slice's changes: the mean over the parts that have changed a row."""
    frame = frame.sort_values(["rows", "change"])  # sums of floats in one order
    at = np.frombuffer(b"".join(frame["rows"]), np.int32)
    rows, place, parts = np.unique(at, return_inverse=True, return_counts=True)
    total = np.zeros((len(rows), DIM + 1))
    np.add.at(total, place, np.frombuffer(b"".join(frame["change"]), np.float32).reshape(-1, DIM + 1))
    return pd.DataFrame({"slice": frame["slice"].iloc[:1], "rows": [rows.tobytes()], "change": [(total / parts[:, None]).astype(np.float32).tobytes()]})


class Scorer:
    """The answers of a network to the distinct words of a task, and scores from them."""

    def __init__(self, net: Network | None):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.words, self.answers = Words(), np.zeros((1, sum(WIDTHS) * FILTERS), np.float32)

    def __call__(self, texts: list[str], langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and the verdicts by the thresholds of the languages."""
        net = self.net
        if net is None or not texts:
            return np.zeros(len(texts)), np.zeros(len(texts), bool)
        if len(self.words.index) > KEPT_WORDS:
            self.forget()
        numbered = [self.words.number(t) for t in texts]
        if new := list(islice(self.words.index, len(self.answers) - 1, None)):
            self.answers = np.concatenate([self.answers, net.answers(np.array([hashed(w) for w in new], np.int32))])
        logits = net.logits(net.pooled(self.answers, np.concatenate(numbered), starts_of(numbered)))
        cut = np.array([net.thresholds.get(x, net.common) for x in langs])
        return net.score(logits), logits >= cut


def scored(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, score, toxic (by the threshold of the row's language) for every whole text."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)  # BUCKETS x DIM floats: 4 MB

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = Scorer(sent.value)
        for frame in blocks(frames):
            scores, verdicts = score(frame.text.tolist(), frame.lang.tolist())
            yield pd.DataFrame({"doc_id": frame.doc_id, "score": scores, "toxic": verdicts})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    return map_frames(rows, run, "doc_id long, score double, toxic boolean")


def keep_clean(docs: DataFrame, net: Network | None) -> DataFrame:
    """The rows of docs that are not judged toxic, with all their columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts, langs = ([x or "" for x in part.column(names.index(c)).to_pylist()] for c in ("text", "lang"))
                yield part.filter(pa.array(~score(texts, langs)[1]))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.coalesce(in_fold(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= PLAIN).cast("int").alias("predicted"), "toxic")


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
