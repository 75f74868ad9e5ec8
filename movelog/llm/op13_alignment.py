"""Cross-tokenizer alignment with an identity-map fast path.

Every text is encoded by two tokenizers, A and B. Byte offsets where tokens of both end cut the
tokens into groups; an A token and a B token whose byte ranges overlap are a link.

1. Before any text is read, an array leads from each A id to the B id of the same bytes. Groups of
   one token on both sides that this array foretells are regular: only their A id is kept.
2. One pass encodes, aligns and digests the texts. It writes the regular groups' A ids and the links
   of all other groups, as packed integers.
3. Regular links are counted in vectors as long as A's vocabulary, one for each task; only irregular
   links are counted by pair, in the task and then by a shuffle.
4. The counts of all regular pairs and of the COMMON most frequent irregular ones go to the tasks that
   add up a document's links; a document's other pairs are joined with the table of all counts.

What reaches the driver is bounded: one count for each A id, one for each B id, and COMMON pairs.

Defined results: a null or empty text, and one whose tokens of A or B do not spell a space and the
text, has no tokens (zeros, an empty digest); repeated rows give one row each and count as often; a
null doc_id gives its row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import blocks, map_frames, materialise, most_frequent, table, texts
from .merges import per_row, spread
from .op06_token_counts import byte_characters

#: Irregular pairs whose counts are sent to the tasks; all others are joined.
COMMON = 500_000
#: Links that a task adds up at one time.
KEPT_LINKS = 4_000_000
#: Characters that are encoded and aligned together.
BLOCK = 250_000


class Ids(NamedTuple):
    """Tokens of texts in a row, and how many each text has."""

    flat: np.ndarray
    counts: np.ndarray


class Groups(NamedTuple):
    """Of texts in a row: the digest's parts, groups and links of each text, regular A ids and irregular links."""

    digests: list[str]
    n_groups: np.ndarray
    n_links: np.ndarray
    regular: Ids
    irregular: Ids


class Spelling:
    """The bytes of each id."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        return spread(self.pool, self.at[ids], self.length[ids])[0].tobytes()

    def spell(self, ids: Ids, raw: list[bytes]) -> bool:
        """Do the tokens of all texts spell them; one comparison of all bytes, and of each text's length."""
        return per_row(self.length[ids.flat], ids.counts).tolist() == [len(r) for r in raw] and self.joined(ids.flat) == b"".join(raw)


class Aligner:
    """Both tokenizers, the identity map and the words of the digest, for one Python worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are then ordinary text
        names = {c: bytes([k]) for k, c in enumerate(byte_characters())}
        self.of_a = Spelling([b"".join(names.get(c, c.encode()) for c in self.a.id_to_token(k) or "") for k in range(self.a.get_vocab_size())])
        self.of_b = Spelling([piece_bytes(self.b, k) for k in range(self.b.get_piece_size())])
        self.same = identity_map(self.of_a.tokens, self.of_b.tokens)
        n_a, n_b = len(self.same), len(self.of_b.tokens)
        self.n_a, self.n_b = n_a, n_b
        # Parts of the digest by code: a regular group; an A id within a group and at its end; a B id so.
        self.parts = [f"{a}|{b};".encode() for a, b in enumerate(self.same.tolist())]
        self.parts += [f"{a}{end}".encode() for end in ",|" for a in range(n_a)] + [f"{b}{end}".encode() for end in ",;" for b in range(n_b)]

    def encode(self, batch: list[str]) -> tuple[np.ndarray, Ids, Ids]:
        """Which of the texts have tokens, and the tokens of those by A and by B."""
        some = [k for k, text in enumerate(batch) if text]
        raw = [b" " + batch[k].encode("utf-8", "replace") for k in some]
        a = [x.ids for x in self.a.encode_batch_fast([" " + batch[k] for k in some], add_special_tokens=False)]
        b = self.b.encode([batch[k] for k in some], num_threads=1)
        flat_a, flat_b = flat(a), flat(b)
        if not (self.of_a.spell(flat_a, raw) and self.of_b.spell(flat_b, raw)):
            kept = [k for k, (i, j, r) in enumerate(zip(a, b, raw, strict=True)) if self.of_a.joined(np.array(i, np.int64)) == r == self.of_b.joined(np.array(j, np.int64))]
            some, flat_a, flat_b = [some[k] for k in kept], flat([a[k] for k in kept]), flat([b[k] for k in kept])
        whole = np.zeros(len(batch), bool)
        whole[some] = True
        return whole, flat_a, flat_b

    def align(self, a: Ids, b: Ids) -> Groups:
        """Groups and links of texts whose tokens of both sides spell the same bytes."""
        end_a, end_b = np.cumsum(self.of_a.length[a.flat]), np.cumsum(self.of_b.length[b.flat])
        last = np.searchsorted(end_b, end_a)  # the B token that holds the last byte of each A token
        cut_a = end_b[last] == end_a
        cut_b = np.zeros(len(end_b), bool)
        cut_b[last[cut_a]] = True
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        n = int(cut_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        regular = (in_a == 1) & (in_b == 1)
        regular[regular] = self.same[a.flat[first_a[regular]]] == b.flat[first_b[regular]]
        odd_a, odd_b = ~regular[group_a], ~regular[group_b]
        # An A token overlaps all B tokens from the one that holds its first byte to the one that holds its last.
        first = np.concatenate([[0], last[:-1] + cut_a[:-1]])
        many = np.where(odd_a, last - first + 1, 0)
        links, _ = spread(b.flat, first[odd_a], many[odd_a])
        codes = np.repeat(a.flat[odd_a], many[odd_a]) * self.n_b + links
        text_a = np.repeat(np.arange(len(a.counts)), a.counts)
        by_text = lambda weights: np.bincount(text_a, weights, len(a.counts)).astype(np.int64)
        n_regular, n_irregular = by_text(~odd_a), by_text(many)
        return Groups(
            self.digests(a, b, (group_a, cut_a, odd_a), (group_b, cut_b, odd_b), in_a, in_b, regular), by_text(cut_a), n_regular + n_irregular, Ids(a.flat[~odd_a], n_regular), Ids(codes, n_irregular)
        )

    def digests(self, a: Ids, b: Ids, of_a: tuple, of_b: tuple, in_a: np.ndarray, in_b: np.ndarray, regular: np.ndarray) -> list[str]:
        """The SHA-256 of each text's groups; a regular group is one part, another one a part for each token, A's first."""
        (group_a, cut_a, odd_a), (group_b, cut_b, odd_b) = of_a, of_b
        b_before, a_until = np.cumsum(np.where(regular, 0, in_b)), np.cumsum(in_a)
        at_a = np.arange(len(a.flat)) + np.concatenate([[0], b_before])[group_a]
        at_b = np.arange(int(odd_b.sum())) + a_until[group_b[odd_b]]
        codes = np.empty(len(at_a) + len(at_b), np.int64)
        codes[at_a] = a.flat + self.n_a * np.where(odd_a, 1 + cut_a, 0)
        codes[at_b] = b.flat[odd_b] + 3 * self.n_a + self.n_b * cut_b[odd_b]
        text_b = np.repeat(np.arange(len(b.counts)), b.counts)[odd_b]
        ends = np.cumsum(a.counts + np.bincount(text_b, minlength=len(b.counts)))
        part = self.parts.__getitem__
        return [hashlib.sha256(b"".join(map(part, codes[x:y].tolist()))[:-1]).hexdigest() for x, y in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


def flat(ids: list[list[int]]) -> Ids:
    counts = np.array([len(x) for x in ids], np.int64)
    return Ids(np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum())), counts)


def piece_bytes(model: sentencepiece.SentencePieceProcessor, k: int) -> bytes:
    """A piece in UTF-8 with U+2581 as a space; a byte piece as its byte."""
    piece = model.id_to_piece(k)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode()


def identity_map(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each A id the B id of the same bytes, the last of several, or -1."""
    of_b = {token: k for k, token in enumerate(b)}
    return np.array([of_b.get(token, -1) for token in a], np.int64)


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker, which keeps it from task to task."""
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and as packed unsigned 32-bit integers the A ids of regular groups and the irregular links."""

    def packed(ids: Ids) -> list[bytes]:
        cuts, data = np.concatenate([[0], np.cumsum(ids.counts)]).tolist(), ids.flat.astype("<u4")
        return [data[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, both = TaskContext.get().partitionId() << 40, aligner(path_a, path_b)
        for frame in blocks(frames, limit=BLOCK):
            whole, a, b = both.encode(frame.text.tolist())
            n = len(frame)
            out = pd.DataFrame({"row": row + np.arange(n), "doc_id": frame.doc_id.array, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "regular": b"", "irregular": b""})
            row += n
            if whole.any():
                found = both.align(a, b)
                values = {"n_a": a.counts, "n_b": b.counts, "n_groups": found.n_groups, "n_links": found.n_links, "groups_sha256": found.digests, "regular": packed(found.regular), "irregular": packed(found.irregular)}
                for name, value in values.items():
                    out.loc[whole, name] = pd.Series(value, out.index[whole])
            yield out

    return map_frames(docs, run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, regular binary, irregular binary")


def unpacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").astype(np.int64)


def regular_counts(found: DataFrame, n_a: int) -> DataFrame:
    """a, n: how often each A id is a regular group; each task counts in a vector as long as the vocabulary."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(n_a, np.int64)
        for frame in frames:
            counts += np.bincount(unpacked(frame.regular), minlength=n_a)
        ids = np.flatnonzero(counts)
        yield pd.DataFrame({"a": ids, "n": counts[ids]})

    return found.select("regular").mapInPandas(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def irregular_counts(found: DataFrame) -> DataFrame:
    """code, n of all irregular pairs; each task adds up its own first, KEPT_LINKS at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            held.append(unpacked(frame.irregular))
            n += len(held[-1])
            if n > KEPT_LINKS:
                yield sums(held)
                held, n = [], 0
        if n:
            yield sums(held)

    def sums(held: list[np.ndarray]) -> pd.DataFrame:
        codes, counts = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"code": codes, "n": counts})

    return found.select("irregular").mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def align_tokenizers(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every whole text."""
    return Alignment(df, path_a, path_b, id_col, text_col, common).documents()


class Alignment:
    """The alignment of a corpus: its documents' links, and the counts of all pairs of ids."""

    def __init__(self, df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON):
        self.spark, self.common = df.sparkSession, common
        both = aligner(path_a, path_b)
        self.same, self.n_b = both.same, both.n_b
        self.found = materialise(aligned(texts(df, id_col, text_col), path_a, path_b), "align-found")
        regular = regular_counts(self.found, both.n_a).toPandas()  # as many rows as A has ids, at most
        codes = regular["a"].to_numpy(np.int64) * self.n_b + self.same[regular["a"].to_numpy(np.int64)]
        foretold = self.spark.createDataFrame(pd.DataFrame({"code": codes, "n": regular["n"].to_numpy(np.int64)}), "code long, n long")
        counted = materialise(irregular_counts(self.found).union(foretold).groupBy("code").agg(F.sum("n").alias("n")), "align-counts")
        b = F.col("code") % self.n_b
        self.best = counted.groupBy(b.alias("b")).agg(F.max("n").alias("best"))
        # One row for each B id, so that the table is small whatever the corpus is.
        self.pairs = counted.withColumn("b", b).join(F.broadcast(self.best), "b").select("code", "n", (F.col("n") == F.col("best")).alias("is_best"))

    def pair_counts(self) -> DataFrame:
        """a, b, n, is_best: how many links of the corpus hold each pair, and whether no other pair of its B id has more."""
        return self.pairs.select(F.floor(F.col("code") / F.lit(self.n_b)).alias("a"), (F.col("code") % self.n_b).alias("b"), "n", "is_best")

    def known(self) -> pd.DataFrame:
        """code, n, is_best of the most frequent pairs and of all regular ones, sorted by code."""
        foretold = np.flatnonzero(self.same >= 0) * self.n_b + self.same[self.same >= 0]
        wanted = self.spark.createDataFrame(pd.DataFrame({"code": foretold}), "code long")  # at most one for each A id
        sent = most_frequent(self.pairs, self.common).union(self.pairs.join(F.broadcast(wanted), "code", "left_semi")).distinct()
        return sent.toPandas().sort_values("code")

    def documents(self) -> DataFrame:
        known = self.known()
        sent = self.spark.sparkContext.broadcast((known["code"].to_numpy(np.int64), known["n"].to_numpy(np.int64), known["is_best"].to_numpy(bool)))
        same, n_b = self.same, self.n_b

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            codes, counts, is_best = sent.value
            of_regular, best_regular = np.zeros(len(same), np.int64), np.zeros(len(same), bool)
            ids = np.flatnonzero(same >= 0)
            at = np.minimum(np.searchsorted(codes, ids * n_b + same[ids]), max(len(codes) - 1, 0))
            if len(codes):
                here = codes[at] == ids * n_b + same[ids]
                of_regular[ids[here]], best_regular[ids[here]] = counts[at[here]], is_best[at[here]]
            for frame in frames:
                per_regular, per_irregular = (frame[c].map(len).to_numpy(np.int64) // 4 for c in ("regular", "irregular"))
                regular, links = unpacked(frame.regular), unpacked(frame.irregular)
                at = np.minimum(np.searchsorted(codes, links), max(len(codes) - 1, 0))
                here = codes[at] == links if len(codes) else np.zeros(len(links), bool)
                n, best = np.zeros(len(links), np.int64), np.zeros(len(links), np.int64)
                n[here], best[here] = counts[at[here]], is_best[at[here]]
                out = frame.drop(columns=["regular", "irregular"])
                yield out.assign(
                    n_best=per_row(best_regular[regular].astype(np.int64), per_regular) + per_row(best, per_irregular),
                    count_sum=per_row(of_regular[regular], per_regular) + per_row(n, per_irregular),
                    rest=rest(links, here, per_irregular),
                )

        def rest(links: np.ndarray, here: np.ndarray, counts: np.ndarray) -> list[list[dict]]:
            """For each text its pairs that were not sent, and how often each occurs in it."""
            out: list[list[dict]] = [[] for _ in range(len(counts))]
            text = np.repeat(np.arange(len(counts)), counts)[~here]
            pairs, times = np.unique(np.stack([text, links[~here]]), axis=1, return_counts=True)
            for t, code, k in zip(*pairs.tolist(), times.tolist(), strict=True):
                out[t].append({"code": code, "k": k})
            return out

        schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<struct<code: long, k: long>>"
        scored = materialise(map_frames(self.found, run, schema), "align-scored")
        rare = scored.select("row", F.inline("rest")).join(self.pairs, "code")
        more = rare.groupBy("row").agg(F.sum(F.col("k") * F.col("is_best").cast("long")).alias("best"), F.sum(F.col("k") * F.col("n")).alias("sum"))
        both = lambda own, other: (F.col(own) + F.coalesce(other, F.lit(0))).alias(own)
        out = scored.drop("rest").join(more, "row", "left")
        return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", both("n_best", "best"), both("count_sum", "sum"), "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op13_alignment": op13_alignment}
#: Two tokenizers' ids cannot be said in SQL; tests/llm holds them against a token by token alignment.
ORACLES: dict[str, str] = {}
