"""Token counts with a whole-token shortcut.

Before any text is read, every vocabulary string that ends a word is encoded by itself; those that
come out as exactly one token are proven whole. In texts, a pre-token that is proven whole counts
one without any merging, and only the distinct remaining pre-tokens of a block go through the
merges, all together. Nothing is shuffled; memory depends on the block.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated ids and texts give one
row each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, map_frames, table, texts
from .merges import MergeReplay, WordTable, per_row

#: Characters whose words are merged together, and the distinct words above which a worker starts anew.
BLOCK = 30_000_000
KEPT_WORDS = 500_000


def byte_characters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte.

    Printable Latin-1 bytes stand for themselves, the others for the characters from U+0100 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordCounter:
    """Counts tokens as a `tokenizers` file of a lower-casing BPE with word ends would make them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = byte_characters()
        names = {c: b for b, c in enumerate(chars)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        result = np.array([vocab[a + b] for a, b in pairs])
        self.replay = MergeReplay([vocab[c] for c in chars], ((vocab[a], vocab[b], rank) for rank, (a, b) in enumerate(pairs)), result, [vocab[c + end] for c in chars])
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.whole = self.proven({bytes(names[c] for c in token.removesuffix(end)): n for token, n in vocab.items() if token.endswith(end) and token != end})
        self.table = WordTable()

    def proven(self, candidates: dict[bytes, int]) -> dict[bytes, int]:
        """Of these byte strings, those that the merges make into their one token."""
        words = list(candidates)
        tokens, counts = self.replay.encode(words)
        first = tokens[np.cumsum(counts) - counts]
        return {w: candidates[w] for w, n, t in zip(words, counts.tolist(), first.tolist(), strict=True) if n == 1 and t == candidates[w]}

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings, normalised as the file says."""
        if not text.isascii():
            text = normalize("NFC", text).replace("Σ", "σ")  # lower-casing looks at one character alone
        return self.split(text.lower())

    def split_special(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens around special strings, and how many special strings there are."""
        if "<|" not in text:
            return self.words(text), 0
        parts = self.special.split(text)
        return [w for part in parts for w in self.words(part)], len(parts) - 1

    def counted(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        """The ids and byte lengths of each block of texts, with the token counts."""
        held: list[tuple[pd.DataFrame, tuple[np.ndarray, np.ndarray], np.ndarray]] = []
        chars = 0

        def flush() -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
            self.table.learn(self.replay, self.whole)
            for ids, (words, per_text), special in held:
                yield ids, per_row(self.table.word_len[words], per_text) + special
            held.clear()
            if len(self.table.index) > KEPT_WORDS:
                self.table.forget()

        for frame in blocks(frames):
            special: list[int] = []

            def split(frame: pd.DataFrame = frame, special: list[int] = special) -> Iterator[list[str]]:
                for text in frame.text:
                    words, n = self.split_special(text)
                    special.append(n)
                    yield words

            numbered = self.table.number(split())
            held.append((frame.drop(columns="text"), numbered, np.array(special, np.int64)))
            chars += int(frame.text.str.len().sum())
            if chars > BLOCK or len(self.table.index) > 2 * KEPT_WORDS:
                yield from flush()
                chars = 0
        yield from flush()
        self.table.forget()  # an idle worker keeps nothing but the vocabulary


@lru_cache(maxsize=2)
def counter(path: str) -> WordCounter:
    """One for each Python worker, which keeps it from task to task."""
    return WordCounter(path)


def token_counts(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every whole text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, counts in counter(path).counted(frames):
            yield ids.assign(n_tokens=counts)

    rows = texts(df, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return map_frames(rows, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}
