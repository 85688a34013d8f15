"""Words, lines and their hashes over many texts at once, on the bytes of Arrow columns.

Everything is vectorised over a slice of a batch: the texts' bytes side by side, with offsets. A substring's hash comes from two
prefix sums of a polynomial over 64-bit integers, and is then mixed; of a string of LONG bytes and more it is XXH64, as such a
polynomial is the same for some pairs of strings from about 2,000 bytes on, whatever its base. Equal hashes are taken for equal
strings, which fails with a probability of about 2^-64 for each pair compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on at once; a longer text makes a slice of its own.
SLICE = 2 << 20
#: An odd base and its inverse modulo 2^64.
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes from which on a string is hashed by itself.
LONG = 512

#: Characters that part words, as in `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE + 1), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= SLICE + 1:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def columns(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls, as they lie in memory."""
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = array.buffers()
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(array: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most so many bytes."""
    data, offsets = columns(array)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Texts:
    """The words of a run of texts: where they start and end, and in which text each lies."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        self.data = data = LOWER[data] if lower else data
        self.offsets, self.n = offsets, len(offsets) - 1
        self.space = space = SPACE[data]
        if len(data):
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            before = np.concatenate(([True], space[:-1])) | edge[:-1]
            after = np.concatenate((space[1:], [True])) | edge[1:]
            self.start, self.end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1 if self.n else np.zeros(0, np.int64)
        self.counts = np.bincount(self.doc, minlength=self.n)
        self._sums: np.ndarray | None = None

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            out = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(self.data)), out=out[1:])
            self._sums = out
        return self._sums

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the substrings data[start:end]."""
        inverse, size = powers(INVERSE, len(self.data) + 1), end - start
        out = mix((self.sums[end] - self.sums[start]) * inverse[start] + size.astype(np.uint64))
        for k in np.flatnonzero(size >= LONG).tolist():
            out[k] = xxhash.xxh64_intdigest(self.data[start[k] : end[k]].tobytes())
        return out

    def words(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]
