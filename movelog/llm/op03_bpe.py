"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each task takes a block of documents as its corpus: it splits the texts into pre-tokens, keeps
the distinct ones, and builds an inverted index from token pair to the positions where the pair
stands. Merges are then replayed in rank order over all words at once; applying one touches only
the neighbours of its positions. Documents are rebuilt from the finished words, so that no row is
shuffled and memory depends on the block alone.

Defined results: a null or empty text has no tokens (0, the SHA-256 of no bytes); repeated ids
and texts give one row each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .common import blocks, map_frames, table, texts
from .merges import MergeReplay, WordTable, spread

#: Characters whose words are replayed together; a worker starts anew above one distinct word for each 50.
BLOCK = 12_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: base64 of the token, a blank, its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_replay(ranks: dict[bytes, int]) -> MergeReplay:
    """The replay of a rank file: a token's id is its rank, and a pair merges into what it spells."""
    halves = ((ranks[token[:i]], ranks[token[i:]], rank) for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks)
    return MergeReplay([ranks[bytes([b])] for b in range(256)], halves, np.arange(max(ranks.values()) + 1))


class Codec:
    """Texts to ids and back, for one rank file and one split pattern; holds a worker's known words."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.replay = merge_replay(self.ranks)
        self.split = regex.compile(pattern).findall
        by_id = {rank: token for token, rank in self.ranks.items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.table = WordTable()

    def ids(self, words: np.ndarray, per_text: np.ndarray) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        table = self.table
        flat, counts = spread(table.pool, table.word_at[words], table.word_len[words])
        cuts = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(per_text)])].tolist()
        flat = flat.astype("<u4")
        return [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self) -> None:
        self.table.learn(self.replay, self.ranks)  # the library looks a whole word up before it merges

    def encode(self, texts: list[str]) -> list[bytes]:
        numbered = self.table.number(map(self.split, texts))
        self.learn()
        return self.ids(*numbered)

    def decode(self, ids: bytes) -> bytes:
        which = np.frombuffer(ids, "<u4")
        return spread(self.token_bytes, self.token_at[which], self.token_len[which])[0].tobytes()

    def encoded(self, frames: Iterator[pd.DataFrame], block: int = BLOCK) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
        """Rows without their texts, and ids, block by block; a block's words are replayed together."""
        held: list[tuple[pd.DataFrame, tuple[np.ndarray, np.ndarray]]] = []
        chars = 0

        def flush() -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
            self.learn()
            for rows, numbered in held:
                yield rows, self.ids(*numbered)
            held.clear()
            if len(self.table.index) > block // 50:
                self.table.forget()

        for frame in blocks(frames):
            texts = frame.text.tolist()
            held.append((frame.drop(columns="text"), self.table.number(map(self.split, texts))))
            chars += sum(map(len, texts))
            if chars > block or len(self.table.index) > block // 25:
                yield from flush()
                chars = 0
        yield from flush()
        self.table.forget()  # an idle worker keeps nothing but the ranks


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker, which keeps it from task to task."""
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids binary: the ids of each whole text as little-endian unsigned 32-bit integers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, ids in codec(path, pattern).encoded(frames):
            yield rows.assign(ids=ids)

    return map_frames(texts(df, id_col, text_col), run, "doc_id long, ids binary")


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded binary: the bytes that the ids stand for."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 500):
                part = frame.iloc[at : at + 500]
                yield part.assign(decoded=[codec(path, pattern).decode(x) for x in part.ids])

    return map_frames(df.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the columns to keep: encodes, then decodes the ids, in one pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(path, pattern)
        for rows, ids in bpe.encoded(frames, block):
            yield rows.assign(
                n_tokens=[len(x) // 4 for x in ids],
                ids_sha256=[hashlib.sha256(x).hexdigest() for x in ids],
                decoded_sha256=[hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
            )

    found = StructType([*StructType.fromDDL("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").fields, *df.select(*keep).schema.fields])
    return map_frames(texts(df, id_col, text_col, keep), run, found)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLES: dict[str, str] = {
    # The decoded bytes are the text's own; the ids themselves are held against the library in tests/llm.
}
