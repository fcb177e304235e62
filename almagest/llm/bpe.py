"""Byte-pair encoding of many words side by side.

Reads the vocabulary and merges of a byte-level tokenizer file with word ends
and applies them to whole arrays of words: in each step every word merges its
pair of least rank (the leftmost of equals), as the library does one word at a
time. Only for plain words, runs of letters that normalisation and
pre-tokenisation leave in one piece; the caller sends others to the library.
"""

from __future__ import annotations

import json

import numpy as np

#: Longer words go to the library.
LONGEST = 48
_NONE = np.int32(2**31 - 1)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    printable, else the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Merges:
    """The merges of a tokenizer file, by pairs of token ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        names = byte_characters()
        self.inner = np.array([vocab[c] for c in names], np.int32)
        self.last = np.array([vocab[c + end] for c in names], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._table(left << 20 | right)

    def _table(self, keys: np.ndarray) -> None:
        """Open addressing: rank of each key."""
        self.bits = (4 * len(keys)).bit_length()
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            slot = self._slot(keys[todo], step)
            free = self.keys[slot] == -1
            first = np.unique(slot[free], return_index=True)[1]
            put = todo[free][first]
            self.keys[slot[free][first]], self.ranks[slot[free][first]] = keys[put], put
            todo, step = np.setdiff1d(todo, put), step + 1
        self.probes = step

    def _slot(self, key: np.ndarray, step: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (h.astype(np.int64) + step) & ((1 << self.bits) - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; _NONE where it has no merge or an end (-1)."""
        key = left.astype(np.int64) << 20 | right
        out = np.full(key.shape, _NONE, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        k = key[open_]
        for step in range(self.probes):
            slot = self._slot(k, step)
            found = self.keys[slot]
            hit = found == k
            out[open_[hit]] = self.ranks[slot[hit]]
            more = ~hit & (found != -1)
            open_, k = open_[more], k[more]
            if not len(k):
                break
        return out

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word (1 to LONGEST bytes)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        for i in range(0, len(words), 4096):
            part = order[i:i + 4096]
            for r, ids in zip(part.tolist(), self._side_by_side([words[r] for r in part], size[part]), strict=True):
                out[r] = ids
        return out

    def _side_by_side(self, words: list[bytes], size: np.ndarray) -> list[np.ndarray]:
        n, width = len(words), int(size.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        at = np.arange(width)
        ids = np.where(at < size[:, None], self.inner[raw], -1).astype(np.int32)
        ids[np.arange(n), size - 1] = self.last[raw[np.arange(n), size - 1]]
        ids = np.concatenate([ids, np.full((n, 1), -1, np.int32)], axis=1)
        ranks = np.concatenate([self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width),
                                np.full((n, 1), _NONE, np.int32)], axis=1)
        rows, at = np.arange(n), np.arange(width + 1)
        while True:
            best = ranks[rows].argmin(axis=1)
            rank = ranks[rows, best]
            live = rank < _NONE
            rows, best, rank = rows[live], best[live], rank[live]
            if not len(rows):
                break
            # close the gap that the right part of the pair leaves
            source = np.minimum(at + (at > best[:, None]), width)
            ids[rows] = np.take_along_axis(ids[rows], source, axis=1)
            ranks[rows] = np.take_along_axis(ranks[rows], source, axis=1)
            ids[rows, best] = self.made[rank]
            ranks[rows, best] = self.rank(ids[rows, best], ids[rows, np.minimum(best + 1, width)])
            inner = best > 0
            r, b = rows[inner], best[inner]
            ranks[r, b - 1] = self.rank(ids[r, b - 1], ids[r, b])
        length = (ids >= 0).sum(axis=1)
        return [row[:m] for row, m in zip(ids, length.tolist(), strict=True)]
