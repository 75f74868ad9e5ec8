"""Merge replay: byte-pair merges applied to all words of a block at once.

The words of a block stand in one row of symbols. An inverted index leads from each merge to the
places where its pair stands; merges are applied in rank order, each at all its places, and only
the neighbours of those places get new pairs. The result is that of merging word by word.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable
from itertools import islice

import numpy as np

class MergeReplay:
    """Replays merges over all words of a block, rank by rank.

    byte: the id of each byte; last: its id at the end of a word, if another. merges: (left id,
    right id, rank); result: the id that a rank's merge makes. A rank may have several pairs.
    """

    def __init__(self, byte: list[int], merges: Iterable[tuple[int, int, int]], result: np.ndarray, last: list[int] | None = None):
        self.byte, self.last = np.array(byte, np.int32), np.array(last or byte, np.int32)
        self.result = result.astype(np.int32)
        pairs = np.fromiter((((left << 32) | right, rank) for left, right, rank in merges), [("code", "<i8"), ("rank", "<i4")])
        if not len(pairs):
            pairs = np.array([(-1, -1)], pairs.dtype)
        pairs.sort(order="code")
        self.codes, self.becomes = pairs["code"].copy(), pairs["rank"].copy()

    def greedy(self, word: bytes) -> list[int]:
        """One word alone: always the merge of lowest rank, leftmost first."""
        ids = self.byte[np.frombuffer(word, np.uint8)]
        ids[-1] = self.last[word[-1]]
        while len(ids) > 1:
            ranks = self.pair(ids[:-1], ids[1:])
            if (ranks < 0).all():
                break
            at = int(np.where(ranks < 0, np.iinfo(np.int32).max, ranks).argmin())
            ids = np.concatenate([ids[:at], self.result[ranks[at : at + 1]], ids[at + 2 :]])
        return ids.tolist()

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, or -1; ids below 0 merge with nothing."""
        code = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.codes[at] == code), self.becomes[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each word has. No word is empty."""
        length = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(length + 1) - length  # a separator stands before each word and at the end
        flat = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        ids = self.byte[flat]
        ids[starts + length - 1] = self.last[flat[starts + length - 1]]
        ids[0] = ids[-1] = -1
        ids[starts - 1] = -1
        n = len(ids)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        pair_at = np.full(n, -1, np.int32)  # the rank of the symbol at a place with its right neighbour
        for at in range(0, n - 1, 1 << 20):
            end = min(at + (1 << 20), n - 1)
            pair_at[at:end] = self.pair(ids[at:end], ids[at + 1 : end + 1])
        index: dict[int, list[np.ndarray]] = {}  # the inverted index: merge -> places
        heap: list[int] = []

        def add(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            edges = [0, *cuts.tolist(), len(ranks)]
            for rank, a, b in zip(ranks[edges[:-1]].tolist(), edges, edges[1:], strict=False):
                if rank in index:
                    index[rank].append(places[a:b])
                else:
                    index[rank] = [places[a:b]]
                    heapq.heappush(heap, rank)

        first = np.flatnonzero(pair_at >= 0)
        if len(first):
            add(first, pair_at[first])
        late: list[np.ndarray] = []
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank)
            at = np.concatenate(found) if len(found) > 1 else found[0]
            at = at[pair_at[at] == rank]
            if not len(at):
                continue
            if len(found) > 1:
                at = np.unique(at)
            other = nxt[at]
            if len(at) > 1 and (at[1:] == other[:-1]).any():  # as in "aaa": the leftmost goes first
                keep, taken = [], -1
                for k, (place, right) in enumerate(zip(at.tolist(), other.tolist(), strict=True)):
                    if place != taken:
                        keep.append(k)
                        taken = right
                at, other = at[keep], other[keep]
            after = nxt[other]
            ids[at] = self.result[rank]
            ids[other] = -2
            pair_at[other] = -1
            nxt[at] = after
            prv[after] = at
            touched = np.concatenate([prv[at], at])
            if len(at) > 1:
                touched = np.unique(touched)
            new = self.pair(ids[touched], ids[nxt[touched]])
            pair_at[touched] = new
            touched, new = touched[new >= 0], new[new >= 0]
            if len(new):
                if (early := new < rank).any():
                    late.append(touched[early])
                add(touched, new)
        alive = ids >= 0
        counts = np.add.reduceat(alive, starts - 1, dtype=np.int64) if len(words) else length
        tokens = ids[alive]
        if late:  # a merge of an earlier rank turned up late: these words are done one by one
            ends = np.cumsum(counts)
            parts, done = [], 0
            for k in np.unique(np.searchsorted(starts, np.concatenate(late), side="right") - 1).tolist():
                own = np.array(self.greedy(words[k]), np.int32)
                parts += [tokens[done : ends[k] - counts[k]], own]
                done = ends[k]
                counts[k] = len(own)
            tokens = np.concatenate([*parts, tokens[done:]])
        return tokens, counts


class WordTable:
    """Words numbered in order of appearance, with the ids of each one; learns new words together."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.word_at, self.word_len, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def number(self, split: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of all texts in a row, and how many each text has."""
        number = self.index.__getitem__
        out = [np.fromiter(map(number, words), np.int32, len(words)) for words in split]
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.array([len(x) for x in out], np.int64)

    def learn(self, replay: MergeReplay, whole: dict[bytes, int]) -> None:
        """Encodes the words that are new since the last call. whole: words known to be one token."""
        words = [w.encode("utf-8", "replace") for w in islice(self.index, len(self.word_len), None)]
        if not words:
            return
        one = np.array([whole.get(w, -1) for w in words], np.int32)
        tokens, counts = replay.encode([w for w, x in zip(words, one.tolist(), strict=True) if x < 0])
        length = np.ones(len(words), np.int64)
        length[one < 0] = counts
        at = np.cumsum(length) - length
        flat = np.empty(int(length.sum()), np.int32)
        flat[at[one >= 0]] = one[one >= 0]
        flat[np.repeat(one < 0, length)] = tokens
        self.word_at = np.concatenate([self.word_at, at + len(self.pool)])
        self.word_len = np.concatenate([self.word_len, length])
        self.pool = np.concatenate([self.pool, flat])


def spread(pool: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pool[a : a + n] for each a and n, in a row; and the lengths."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(at - (ends - length), length) + np.arange(total)], length


def per_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the next `count` values for each count."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
