"""Vectorised word and shingle hashing over the buffers of Arrow string arrays.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z folded to a-z.  UTF-8 never uses these
bytes inside a longer character, so bytes and code points cut the text at the same places.  A word's hash is a
polynomial in its bytes modulo 2**64, finished by a mixing function; equality of hashes stands for equality of
words (the chance that any two of n distinct words collide is about n*n / 2**65).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes hashed at a time; bounds the temporary arrays.
BLOCK = 1 << 16

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EXACT = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= BLOCK:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the number of words before each document (len+1 values)."""
    hashes, starts, at, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, len(data)
    while at < n:
        end = min(n, at + BLOCK)
        if end < n:
            cut = np.flatnonzero(SPACE[data[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # one very long word: up to its end
                while end < n and not SPACE[data[end]]:
                    end += 1
        b = data[at:end]
        space = SPACE[b]
        edge = np.zeros(len(b) + 1, bool)
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, "right")] - at
        edge[inside] = True
        edge[0] = edge[-1] = True
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= space[:-1]
        after[:-1] |= space[1:]
        first = np.flatnonzero(~space & before)
        last = np.flatnonzero(~space & after)
        total = _BYTE[b]
        total *= _power(_P, len(b))
        np.cumsum(total, out=total)
        # what stands before a word also enters the running sum: take it off
        h = total[last] - np.where(first > 0, total[np.maximum(first - 1, 0)], np.uint64(0))
        h *= _power(_P_INV, len(b))[first]
        h ^= (last - first + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        hashes.append(mix(h))
        starts.append(first + at)
        at = end
    where = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(where, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of bytes, cases kept apart.  Spans are in order, do not overlap, and are not long."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        b = data[lo : ends[to - 1]]
        total = _EXACT[b]
        total *= _power(_P, len(b))
        np.cumsum(total, out=total)
        total = np.concatenate([np.zeros(1, np.uint64), total])
        first, last = starts[at:to] - lo, ends[at:to] - lo
        h = (total[last] - total[first]) * _power(_P_INV, len(b) + 1)[first]
        out[at:to] = mix(h ^ (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out


def shingle_hashes(words: np.ndarray, cuts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and their number before each document.

    A document of fewer words gives its whole sequence as one; a document without words gives none.
    """
    count = np.diff(cuts)
    runs = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    before = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(int(before[-1]), np.uint64)
    doc = np.repeat(np.arange(len(count)), runs)
    first = cuts[:-1][doc] + (np.arange(len(doc)) - before[:-1][doc])
    size = np.minimum(count[doc], width)
    for j in range(width):
        live = size > j
        if live.all():
            out = mix(out * np.uint64(0x2545F4914F6CDD1D) + words[first + j])
        elif live.any():
            out[live] = mix(out[live] * np.uint64(0x2545F4914F6CDD1D) + words[first[live] + j])
    out += size.astype(np.uint64)  # sequences of different lengths differ
    return mix(out), before


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        col = batch.column(column)
        if not len(col):
            continue
        _, offsets = buffers(col)
        at = 0
        while at < len(col):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
