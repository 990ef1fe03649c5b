"""Words of many texts as 64-bit hashes, computed over whole Arrow buffers.

Used inside Spark tasks only. A batch's texts lie one behind the other in one
byte buffer; words are found by a table of blanks and hashed by prefix sums, so
that the cost is a few array passes and not a Python step for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer text is hashed alone.
SLICE_BYTES = 1 << 20
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_STEP = int(_RNG.integers(1, 2**62)) * 2 + 1
_UNSTEP = pow(_STEP, -1, 2**64)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Blanks and all ASCII punctuation, for words without marks.
_MARKS = _BLANK.copy()
_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread every bit of the 64-bit values over all bits."""
    x = x + _PLACE[seed]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            n = max(n, SLICE_BYTES)
            a = np.full(n + 1, _STEP, dtype=np.uint64)
            b = np.full(n + 1, _UNSTEP, dtype=np.uint64)
            a[0] = b[0] = 1
            self.up, self.down = np.multiply.accumulate(a), np.multiply.accumulate(b)
        return self.up, self.down


_POWERS = _Powers()


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of a string column with about
    SLICE_BYTES of text each. A null counts as an empty text."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return
    offs = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and offs[-1] > offs[0] else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offs, offs[row] + SLICE_BYTES, side="right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, raw[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row]
        row = stop


class Words:
    """The words of a slice: ``hash``, byte ``start`` and ``end``, and ``first``, the
    index of each row's first word (with one more entry at the end). With ``marks``,
    punctuation separates words as blanks do."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool, marks: bool = False) -> None:
        n = len(raw)
        inside = ~(_MARKS if marks else _BLANK)[raw]
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[1:-1]
        before[cuts[cuts < n]] = False
        after[cuts[cuts > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        up, down = _POWERS.upto(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * up[:n], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * down[self.start]
        self.hash = mixed(h + (self.end - self.start).astype(np.uint64) * _PLACE[63])
        self.first = np.searchsorted(self.start, offsets)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each word on; those that run over the end of a
        row are the caller's to leave out."""
        w = self.hash
        if len(w) < n:
            return np.zeros(0, dtype=np.uint64)
        if n > 16:
            # prefix sums again: a window's hash is a difference times a power
            up, down = _POWERS.upto(len(w))
            sums = np.zeros(len(w) + 1, dtype=np.uint64)
            np.cumsum(w * up[: len(w)], out=sums[1:])
            return mixed((sums[n:] - sums[:-n]) * down[: len(w) - n + 1], 2)
        total = np.zeros(len(w) - n + 1, dtype=np.uint64)
        for k in range(n):
            total += w[k : len(w) - n + 1 + k] * _PLACE[k + 1]
        return mixed(total, 1)


def row_grams(words: Words, grams: np.ndarray, n: int, row: int) -> np.ndarray:
    """The hashes of the n-grams of one row; with fewer words, that of the whole
    sequence; with none, nothing."""
    a, b = int(words.first[row]), int(words.first[row + 1])
    if b - a >= n:
        return grams[a : b - n + 1]
    if b == a:
        return np.zeros(0, dtype=np.uint64)
    place = np.arange(b - a) + 1
    return mixed((words.hash[a:b] * _PLACE[place]).sum(dtype=np.uint64, keepdims=True), 20 + b - a)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span ``start`` to ``end`` of ``raw``."""
    up, down = _POWERS.upto(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _PLACE[63])
