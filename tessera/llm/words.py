"""Words and lines of a whole batch at once: offsets, codes and per-document sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .bpe import utf8_buffers

#: Text bytes handled at once.
BLOCK_BYTES = 1 << 20


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of stretches of a column; a text is never cut."""
    data, off = utf8_buffers(column)
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_runs(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of bytes other than ASCII white space."""
    return runs(~((b == 32) | ((b >= 9) & (b <= 13))), off)


def runs(word: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of marked bytes; a run ends with its document."""
    n = len(word)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = word[:-1]
    first = off[:-1][off[:-1] < n]
    prev[first] = False
    start = np.flatnonzero(word & ~prev)
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = word[1:]
    last = off[1:][off[1:] > 0] - 1
    nxt[last] = False
    end = np.flatnonzero(word & ~nxt) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def slices(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte strings b[start:end] as one Arrow array."""
    size = end - start
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    flat = b[np.repeat(start - off[:-1], size) + np.arange(off[-1])] if len(size) and off[-1] else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(flat)])


def codes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each distinct byte string."""
    if not len(start):
        return np.zeros(0, np.int64)
    return slices(b, start, end).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def per_doc(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many marked bytes each document has."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
