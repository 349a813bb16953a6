"""Vectorised text kernels over Arrow string columns: word hashes and shingle sets, in slabs of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text goes through in several slabs, cut at white space.
SLAB = 1 << 19
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A byte's class: 1 for the white space of the word rule.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: A byte's value after A-Z is lower-cased, and as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def release() -> None:
    """Gives the memory that Arrow keeps for later batches back: a worker stays for a while between its tasks."""
    pa.default_memory_pool().release_unused()


_powers: dict[str, np.ndarray] = {}


def powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        table = np.full(max(n, 1), base, U)
        table[0] = U(1)
        _powers[name] = np.cumprod(table, dtype=U)
    return _powers[name][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and offsets; a null has length 0."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def hash_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data, and for each cut the number of words that start before it. No word crosses a cut."""
    if not len(data):
        return np.zeros(0, U), np.zeros(len(cuts), np.int64)
    solid = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    total = np.cumsum((data.astype(U) + U(1)) * powers("up", BASE, len(data)), dtype=U)
    own = total[end] - np.where(begin > 0, total[begin - 1], U(0))
    return mix(own * powers("down", INVERSE, len(data))[begin]), np.searchsorted(begin, cuts)


def long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, slab by slab."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLAB)
        while end < len(data) and not BLANK[data[end]]:
            end += 1
        out.append(hash_words(data[at:end], np.array([0]))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, U)


def text_words(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, word hashes, word offsets of its rows) for slabs of whole rows."""
    data, offsets = buffers(column)
    row, n = 0, len(column)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLAB, "right")) - 1)
        part = data[offsets[row] : offsets[stop]]
        if lower:
            part = LOWER[part]
        if len(part) > SLAB:
            hashes = long_words(part)
            starts = np.array([0, len(hashes)])
        else:
            hashes, starts = hash_words(part, offsets[row : stop + 1] - offsets[row])
            starts[-1] = len(hashes)
        yield row, hashes, starts
        row = stop


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of the runs of k words; the whole sequence as one if there are fewer; none without words."""
    if not len(hashes):
        return hashes
    k, n = min(k, len(hashes)), len(hashes)
    run = hashes[: n - k + 1] + U(k)
    for j in range(1, k):
        run = mix(run * BASE + hashes[j : n - k + 1 + j])
    run = mix(run)
    run.sort()
    return run[np.concatenate(([True], run[1:] != run[:-1]))]
