"""64-bit hashes of all words of a column of texts, in array operations and without an object for each word.

Each byte has a random 64-bit number; a word's hash is the sum of its bytes' numbers times powers of an odd constant, modulo 2^64,
mixed. Sums of stretches come from running sums, so the cost follows the bytes. Texts are worked in pieces that end where a
word ends; a piece is longer than ``PIECE`` only if a word is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.llm.common import mix

PIECE = 1 << 20
SPACE = 32
_SPACES = frozenset(b" \t\n\x0b\x0c\r")
#: Lower-cases A-Z and makes every byte that ends a word a space.
PLAIN = np.array([SPACE if b in _SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_NUMBER = np.random.default_rng(97).integers(1, 1 << 63, 256, np.uint64)
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


class _Powers:
    """Powers of the factor and of its inverse, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            one = np.ones(n, np.uint64)
            self.up, self.down = one.copy(), one
            self.up[1:], self.down[1:] = np.uint64(_FACTOR), np.uint64(_INVERSE)
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up, self.down


_POWERS = _Powers()


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (one more than texts). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, starts, data = column.buffers()
    at = np.frombuffer(starts, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _ends(data: np.ndarray, at: np.ndarray) -> list[int]:
    """Where pieces end: after a space, or where a text does."""
    out, start = [], 0
    while len(data) - start > PIECE:
        stop, step = start + PIECE, 1 << 16
        while stop < len(data):
            low = max(start, stop - step)
            gaps = np.flatnonzero(data[low:stop] == SPACE)
            text = at[np.searchsorted(at, stop, "right") - 1]
            best = max(low + int(gaps[-1]) + 1 if len(gaps) else 0, int(text))
            if best > start:
                stop = best
                break
            stop, step = stop + PIECE, stop + PIECE - start
        out.append(min(stop, len(data)))
        start = out[-1]
    return [*out, len(data)] if start < len(data) else out


def hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in order, and each text's number of words. Words are runs of bytes other than space."""
    found, firsts, start = [], [], 0
    for stop in _ends(data, at):
        part = data[start:stop]
        word = part != SPACE
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = at[np.searchsorted(at, start) : np.searchsorted(at, stop)] - start
        begins[inner] = word[inner]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        inner = inner[inner > 0] - 1
        ends[inner] = word[inner]
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
        up, down = _POWERS.of(len(part))
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_NUMBER[part] * up[: len(part)], out=total[1:])
        h = (total[end + 1] - total[begin]) * down[begin]
        found.append(mix(h ^ mix((end - begin).astype(np.uint64))))
        firsts.append(begin + start)
        start = stop
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    first = np.concatenate(firsts)
    return np.concatenate(found), np.diff(np.searchsorted(first, at))


def column_hashes(column: pa.Array | pa.ChunkedArray, translation: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """As hashes, of a column whose bytes are first translated; word ends become spaces by the translation."""
    data, at = raw(column)
    return hashes(translation[data], at)
