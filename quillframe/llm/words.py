"""Words, word hashes and window hashes of whole texts as numpy arrays, for use inside Spark tasks.

A word is a maximal run of bytes other than space and \\x09-\\x0D, the same as ``[^\\x20\\x09-\\x0D]+`` on
the decoded text.  Null texts have no words.  Work is done in slices of about ``SLICE`` bytes, so memory
does not depend on the size of an Arrow batch; only a single text longer than that is handled in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Byte tables: A-Z lower-cased; and besides that, everything in ASCII but letters and digits as space.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLAIN = LOWER.copy()
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble (the finaliser of the public splitmix64 generator)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            both = []
            for base in (self.base, self.inverse):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                both.append(np.cumprod(steps, dtype=np.uint64))
            self.up, self.down = both
        return self.up[:n], self.down[:n]


_BYTES = seeds(256, 1)
_BYTE_POWERS = Powers(0x9E3779B97F4A7C15)
_WORD_POWERS = (Powers(0xD6E8FEB86659FD93), Powers(0xC2B2AE3D27D4EB4F))


class Words:
    """The words of consecutive rows.

    ``rows``: first and last row (exclusive) in the batch; ``bounds``: bytes at which rows
    begin, and the last ends; ``starts``, ``ends``: byte spans in ``data``; ``first``: index
    of each row's first word, with one entry more than rows; ``hashes``: a 64-bit hash of every word.
    """

    def __init__(self, rows: tuple[int, int], data: np.ndarray, bounds: np.ndarray, table: np.ndarray | None):
        self.rows, self.bounds = rows, bounds
        self.data = data = data if table is None else table[data]
        n = len(data)
        space = np.ones(n + 2, bool)
        space[1:-1] = _SPACE[data]
        begins = np.zeros(n + 1, bool)
        begins[bounds] = True
        inside = ~space
        self.starts = np.flatnonzero(inside[1:] & (space[:-1] | begins))
        self.ends = np.flatnonzero(inside[:-1] & (space[1:] | begins))
        self.first = np.searchsorted(self.starts, bounds)
        self._hashes = self._total = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = self.span_hashes(self.starts, self.ends)
        return self._hashes

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of any byte spans; equal bytes have equal hashes."""
        n = len(self.data)
        up, down = _BYTE_POWERS.upto(n + 1)
        if self._total is None:
            self._total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[self.data] * up[:n], out=self._total[1:])
        raw = (self._total[ends] - self._total[starts]) * down[starts]
        return mix(raw + (ends - starts).astype(np.uint64))

    def forget(self) -> None:
        """Give back the memory of hashes; they are computed again when asked for."""
        self._hashes = self._total = None

    def window_starts(self, size: int) -> np.ndarray:
        """Start word of every window of ``size`` words inside one row."""
        n = len(self.starts)
        return np.flatnonzero(np.repeat(self.first[1:], self.counts) - np.arange(n) >= size)

    def windows(self, size: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Start word of every window of ``size`` words inside one row, and the window's hash."""
        values = self.hashes
        n = len(values)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = _WORD_POWERS[family].upto(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=total[1:])
        at = self.window_starts(size)
        return at, mix((total[at + size] - total[at]) * down[at] + np.uint64(size))

    def row_of(self, words: np.ndarray) -> np.ndarray:
        """Row (counted from the slice's first) of each word index."""
        return np.searchsorted(self.first, words, side="right") - 1


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def bytes_list(column: pa.LargeBinaryArray) -> list[bytes]:
    """``to_pylist`` of a column without nulls, without a scalar object for each value."""
    if not len(column):
        return []
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at[:-1], at[1:])]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of a single row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words_of(column: pa.Array | pa.ChunkedArray, table: np.ndarray | None = None) -> Iterator[Words]:
    """The words of a text column, slice by slice, after mapping every byte through ``table``."""
    data, offsets = text_bytes(column)
    for lo, hi in slices(offsets):
        yield Words((lo, hi), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], table)
