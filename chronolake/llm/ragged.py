"""Pieces of unequal length: a table of byte or integer runs, gathered and hashed by index."""

from __future__ import annotations

import zlib
from itertools import chain, islice

import numpy as np


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[s : s + n]``, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return flat[:0]
    return flat[np.arange(int(ends[-1])) + np.repeat(starts - (ends - lengths), lengths)]


class Runs:
    """A growing table of integer runs."""

    def __init__(self, dtype) -> None:
        self.flat, self.starts, self.lengths = np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + starts])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])

    def add_each(self, runs: list) -> None:
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        self.add(np.fromiter(chain.from_iterable(runs), self.flat.dtype, int(lengths.sum())), np.cumsum(lengths) - lengths, lengths)

    def keep(self, n: int) -> None:
        """Only the first ``n`` runs stay."""
        flat = self.take(np.arange(n))
        self.lengths = self.lengths[:n]
        self.starts, self.flat = np.cumsum(self.lengths) - self.lengths, flat

    def take(self, index: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts[index], self.lengths[index])


class ChunkCache(dict):
    """Numbers the distinct chunks of texts, and encodes each once.

    ``encode`` adds the runs of new chunks to a table.  A cache that has grown large keeps its oldest chunks: the
    common ones, which turned up first.
    """

    MOST, MOST_CHARS, KEPT = 250_000, 8_000_000, 100_000

    def __init__(self, encode) -> None:
        self.encode, self.new, self.chars, self.runs = encode, [], 0, Runs(np.int32)

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        self.chars += len(chunk)
        return number

    def shrink(self) -> None:
        n = min(self.KEPT, len(self))
        first = [c for c in islice(self, n)]
        if sum(map(len, first)) > self.MOST_CHARS // 2:
            first = []
        self.clear()
        self.update(zip(first, range(len(first)), strict=True))
        self.chars = sum(map(len, first))
        self.runs.keep(len(first))

    def index(self, documents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The number of every chunk, and the chunks of each document. New chunks are encoded."""
        if len(self) > self.MOST or self.chars > self.MOST_CHARS:
            self.shrink()
        sizes = np.fromiter(map(len, documents), np.int64, len(documents))
        index = np.fromiter(map(self.__getitem__, chain.from_iterable(documents)), np.int64, int(sizes.sum()))
        if self.new:
            self.encode(self.new, self.runs)
            self.new = []
        return index, sizes

    def ids(self, index: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents, and the number of ids of each."""
        ends = np.concatenate([[0], np.cumsum(self.runs.lengths[index])])
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        return self.runs.take(index), ends[cuts[1:]] - ends[cuts[:-1]]


def crc32_runs(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each run of 32-bit integers, little-endian."""
    flat = np.ascontiguousarray(flat, "<u4")
    ends = np.cumsum(lengths)
    return np.fromiter((zlib.crc32(flat[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)), np.int64, len(ends))
