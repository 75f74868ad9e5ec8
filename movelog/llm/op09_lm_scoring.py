"""LM scoring by masked pseudo-likelihood.

A window network predicts every word from the words on both sides; a document's score is the sum of
the conditional log-probabilities of its words, P(class | classes around) * P(word | class). The most
frequent words of the corpus are classes of their own, all others share hashed classes by their
ending, and one class stands outside the text. Within a class a word has its share of the class's
counts. The cube of the number of classes grows in proportion to the counted vocabulary.

Everything the network can learn from a corpus is how often each (left, word, right) occurs. So
tasks count words and then windows over all documents, and Spark adds the counts, which stay a
table. In each round of training tasks compute gradients of their left classes' windows, weighted by
counts; only sums as large as the parameters reach the driver, which takes the step.

The counts of the COMMON most frequent words are sent to the tasks that score; every other word
of a document is joined with the table of all word counts.

Defined results: a null or empty text has 0 words, the score 0 and a null mean; repeated rows give
one row each, and count as often; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, map_frames, materialise, table, texts

#: The least numbers of classes; `class_sizes` has more for larger vocabularies.
TOP, ENDINGS = 95, 32
CLASSES = 1 + TOP + ENDINGS
HIDDEN, ROUNDS = 24, 100
#: Rounds and step of the training in tasks, where each round is a job.
TASK_ROUNDS, TASK_STEP = 40, 0.06
#: Words that a task remembers at one time; it starts anew beyond.
KEPT_WORDS = 80_000
#: Words whose counts are sent to the tasks that score; all others are joined.
COMMON = 100_000
#: Windows that a task adds up at one time.
KEPT_WINDOWS = 2_000_000
#: Characters of text that are scored at one time.
SCORED_CHARS = 200_000
#: Tasks of a round of training, at most.
TRAINERS = 24
_WORDS = re.compile(r"\w+|[^\w\s]").findall


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all texts; tasks add up their own words first, KEPT_WORDS at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for frame in blocks(frames):
            for text in frame.text:
                counts.update(_WORDS(text.lower()))
            if len(counts) > KEPT_WORDS:
                yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                counts.clear()
        if counts:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    return docs.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def class_sizes(vocabulary: int) -> tuple[int, int]:
    """Words with classes of their own and classes by ending: the cube of all classes is 8 x the vocabulary."""
    classes = max(CLASSES, round(2 * vocabulary ** (1 / 3)))
    return classes - 1 - classes // 4, classes // 4


class Classes(dict):
    """word -> class; new words are classed as they turn up."""

    def __init__(self, top: list[str], endings: int = ENDINGS):
        super().__init__()
        self.top = {w: k for k, w in enumerate(top, 1)}
        self.own, self.endings = len(top), endings
        self.size = 1 + len(top) + endings

    def __missing__(self, word: str) -> int:
        found = self.top.get(word) or 1 + self.own + zlib.crc32(word[-3:].encode("utf-8", "replace")) % self.endings
        if len(self) < KEPT_WORDS:
            self[word] = found
        return found

    def windows(self, batch: list[list[str]]) -> np.ndarray:
        """The code of every (left, word, right) of all texts' words in a row."""
        counts = np.array([len(words) for words in batch], np.int64)
        return window_codes(np.fromiter((k for words in batch for k in map(self.__getitem__, words)), np.int64, int(counts.sum())), counts, self.size)


def window_codes(classes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The same from the classes of all words in a row, and how many words each text has.

    A text's words stand between two zeros; the zeros themselves are not predicted.
    """
    at = np.arange(len(classes)) + np.repeat(np.arange(1, len(counts) + 1), counts)
    flat = np.zeros(len(classes) + len(counts) + 1, np.int64)
    flat[at] = classes
    return (flat[at - 1] * size + flat[at]) * size + flat[at + 1]


def words_of(batch: list[str]) -> list[list[str]]:
    return [_WORDS(text.lower()) for text in batch]


def window_counts(docs: DataFrame, top: list[str], endings: int = ENDINGS) -> DataFrame:
    """left, counts: for each left class how often each (word, right) follows it, as bytes of int64.

    A task adds up its own windows before the shuffle, KEPT_WINDOWS at a time; then the sums of one
    left class, the number of classes squared at most, become one row.
    """
    size = Classes(top, endings).size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, held, n = Classes(top, endings), [], 0

        def sums() -> Iterator[pd.DataFrame]:
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(codes), 200_000):
                yield pd.DataFrame({"code": codes[at : at + 200_000], "n": counts[at : at + 200_000]})

        for frame in blocks(frames):
            held.append(classes.windows(words_of(frame.text.tolist())))
            n += len(held[-1])
            if n > KEPT_WINDOWS:
                yield from sums()
                held, n = [], 0
        if n:
            yield from sums()
        held.clear()

    def dense(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(size**2, np.int64)
        counts[rows["code"].to_numpy() % size**2] = rows["n"].to_numpy()
        return pd.DataFrame({"left": [key[0]], "counts": [counts.tobytes()]})

    sums = docs.select("text").mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    by_left = sums.groupBy(F.floor(F.col("code") / F.lit(size**2)).cast("int").alias("left"))
    return by_left.applyInPandas(dense, "left int, counts binary")


def forward(p: dict[str, np.ndarray], left: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the contexts of one left class: hidden values, log-probabilities and the logarithms of their sums."""
    hidden = np.tanh(p["left"][left] + p["right"])
    logits = hidden @ p["out"] + p["bias"]
    most = logits.max(1, keepdims=True)
    norm = most + np.log(np.exp(logits - most).sum(1, keepdims=True))
    return hidden, logits - norm, norm[:, 0]


def gradient(p: dict[str, np.ndarray], left: int, seen: np.ndarray, total: float, grad: dict[str, np.ndarray]) -> None:
    """Adds the gradient over the windows of one left class; seen: word x right counts."""
    hidden, logp, _ = forward(p, left)
    own = seen.T
    error = (np.exp(logp) * own.sum(1, keepdims=True) - own) / np.float32(total)
    back = error @ p["out"].T * (1 - hidden**2)
    grad["out"] += hidden.T @ error
    grad["bias"] += error.sum(0)
    grad["left"][left] += back.sum(0)
    grad["right"] += back


def fitted(of_class: np.ndarray, gradients: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], rounds: int, step: float, seed: int = 11) -> dict[str, np.ndarray]:
    """The network's parameters after rounds of Adam; of_class: how often each class occurs."""
    size, rng = len(of_class), np.random.default_rng(seed)
    p = {"left": rng.normal(0, 0.1, (size, HIDDEN)), "right": rng.normal(0, 0.1, (size, HIDDEN)), "out": rng.normal(0, 0.1, (HIDDEN, size)), "bias": np.log((of_class + 1) / (of_class.sum() + size))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for t in range(1, rounds + 1):
        for k, g in gradients(p).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] -= step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-9)
    return p


def train(seen: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Log-probabilities by window code, of the network fitted to counts that are held in memory.

    seen: left x word x right counts.
    """
    def gradients(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        for left in range(len(seen)):
            gradient(p, left, seen[left], max(seen.sum(), 1), grad)
        return grad

    p = fitted(seen.sum((0, 2)), gradients, rounds, 0.03, seed)
    return np.stack([forward(p, left)[1].T for left in range(len(seen))]).ravel()


def train_in_tasks(windows: DataFrame, size: int, rounds: int = TASK_ROUNDS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The parameters of the network fitted to a table of window counts, and how often each class occurs."""
    def classes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(size, np.int64)
        for frame in frames:
            for counts in frame["counts"]:
                found += np.frombuffer(counts, np.int64).reshape(size, size).sum(1)
        yield pd.DataFrame({"sums": [found.tobytes()]})

    of_class = np.sum([np.frombuffer(r[0], np.int64) for r in windows.mapInPandas(classes, "sums binary").collect()], axis=0, initial=0) + np.zeros(size, np.int64)
    total = max(int(of_class.sum()), 1)

    def gradients(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        sent = windows.sparkSession.sparkContext.broadcast(p)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p = sent.value
            grad, any_rows = {k: np.zeros_like(v) for k, v in p.items()}, False
            for frame in frames:
                for left, counts in zip(frame["left"], frame["counts"], strict=True):
                    gradient(p, left, np.frombuffer(counts, np.int64).reshape(size, size).astype(np.float32), total, grad)
                    any_rows = True
            if any_rows:
                yield pd.DataFrame({k: [v.tobytes()] for k, v in grad.items()})

        grad = {k: np.zeros_like(v) for k, v in p.items()}
        for row in windows.mapInPandas(run, ", ".join(f"{k} binary" for k in p)).collect():
            for k in p:
                grad[k] += np.frombuffer(row[k], np.float32).reshape(p[k].shape)
        sent.destroy()
        return grad

    return fitted(of_class, gradients, rounds if of_class.any() else 0, TASK_STEP), of_class


class ScoredWords:
    """A task's distinct words numbered in order of appearance, with the class and the share of each."""

    def __init__(self, classes: Classes, known: dict[str, int], of_class: np.ndarray):
        self.classes, self.known, self.log_class = classes, known, of_class
        self.forget()

    def forget(self) -> None:
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.names: list[str] = []
        self.of_class, self.share, self.is_rare = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)

    def number(self, batch: list[list[str]], n: int) -> np.ndarray:
        if len(self.index) > KEPT_WORDS:
            self.forget()
        ids = np.fromiter((k for words in batch for k in map(self.index.__getitem__, words)), np.int64, n)
        new = list(islice(self.index, len(self.names), None))
        if new:
            classes = np.fromiter(map(self.classes.__getitem__, new), np.int64, len(new))
            counts = np.fromiter((self.known.get(w, 0) for w in new), np.float64, len(new))
            self.names += new
            self.of_class = np.concatenate([self.of_class, classes])
            self.share = np.concatenate([self.share, np.log(np.maximum(counts, 1)) - self.log_class[classes]])
            self.is_rare = np.concatenate([self.is_rare, counts == 0])
        return ids

    def rare(self, ids: np.ndarray, counts: np.ndarray) -> list[list[dict]]:
        """For each text its words that are not common, and how often each occurs in it."""
        out: list[list[dict]] = [[] for _ in range(len(counts))]
        at = np.flatnonzero(self.is_rare[ids])
        text = np.repeat(np.arange(len(counts)), counts)[at]
        pairs, times = np.unique(text * len(self.names) + ids[at], return_counts=True)
        for pair, k in zip(pairs.tolist(), times.tolist(), strict=True):
            out[pair // len(self.names)].append({"word": self.names[pair % len(self.names)], "k": k})
        return out


def pseudo_likelihood(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """doc_id, n_words, log_likelihood, mean_log_likelihood for every whole text."""
    docs = texts(df, id_col, text_col)
    spark = df.sparkSession
    words = materialise(word_counts(docs), "lm-words")
    own, endings = class_sizes(words.count())
    most = words.orderBy(F.desc("n"), "word").limit(max(own, common)).toPandas()
    top = most["word"].tolist()[:own]
    size = Classes(top, endings).size
    # The left classes are dealt out evenly, as every round of training reads them.
    windows = materialise(window_counts(docs, top, endings).repartition(min(size, TRAINERS), "left"), "lm-windows")
    p, of_class = train_in_tasks(windows, size)
    norms = np.stack([forward(p, left)[2] for left in range(size)])
    known = dict(zip(most["word"], most["n"], strict=True))
    sent = spark.sparkContext.broadcast((p, norms, np.log(np.maximum(of_class, 1)), known))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, norms, of_class, known = sent.value
        out = np.ascontiguousarray(p["out"].T)
        hidden = np.tanh(p["left"][:, None] + p["right"][None]).reshape(size**2, HIDDEN)  # of all contexts, classes squared
        row = TaskContext.get().partitionId() << 40
        words = ScoredWords(Classes(top, endings), known, of_class)
        for frame in blocks(frames, limit=SCORED_CHARS):
            batch = words_of(frame.text.tolist())
            counts = np.array([len(x) for x in batch], np.int64)
            ids = words.number(batch, int(counts.sum()))
            codes = window_codes(words.of_class[ids], counts, size)
            left, word, right = codes // size**2, codes // size % size, codes % size
            logp = np.einsum("ij,ij->i", hidden[left * size + right], out[word]) + p["bias"][word] - norms[left, right]
            # A word that is not common has its class's part here; the join adds its count's logarithm.
            sums, ends = np.concatenate([[0.0], np.cumsum(logp + words.share[ids])]), np.cumsum(counts)
            yield pd.DataFrame({"row": row + np.arange(len(frame)), "doc_id": frame.doc_id.array, "n_words": counts, "sum": sums[ends] - sums[ends - counts], "rest": words.rare(ids, counts)})
            row += len(frame)
        words.forget()  # an idle worker keeps no words

    scored = materialise(map_frames(docs, run, "row long, doc_id long, n_words long, sum double, rest array<struct<word: string, k: long>>"), "lm-scored")
    rare = scored.select("row", F.inline("rest")).join(words, "word").groupBy("row").agg(F.sum(F.col("k") * F.log("n")).alias("more"))
    total = F.round(F.col("sum") + F.coalesce("more", F.lit(0.0)), 6).alias("log_likelihood")
    out = scored.select("row", "doc_id", "n_words", "sum").join(rare, "row", "left").select("doc_id", "n_words", total)
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


QUERIES = {"op9_lm_scoring": op9_lm_scoring}
ORACLES: dict[str, str] = {}
