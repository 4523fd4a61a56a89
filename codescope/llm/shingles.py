"""Word shingles as 64-bit hashes, computed on whole Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Tables:
    """Byte values, white space and powers of the base; grown to the longest stretch met."""

    def __init__(self) -> None:
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        values[65:91] = values[97:123]  # A-Z count as a-z
        self.values = values
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.power = self.inverse = np.ones(1, np.uint64)

    def powers(self, size: int) -> None:
        if len(self.power) < size:
            size = max(size, _STEP)
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                factors = np.full(size, base & _MASK, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))


_tables: list[_Tables] = []


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and each text's bounds; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hash of each word, row bounds) for stretches of about a megabyte of text.

    Words are the stretches without white space of ASCII; A-Z count as a-z.
    """
    if not _tables:
        _tables.append(_Tables())
    t = _tables[0]
    data, bounds = _utf8(column)
    row = 0
    while row < len(column):
        to = int(np.searchsorted(bounds, bounds[row] + _STEP, "right")) - 1
        to = min(max(to, row + 1), len(column))
        text = data[bounds[row] : bounds[to]]
        edges = bounds[row : to + 1] - bounds[row]
        space = t.space[text]
        fresh = np.zeros(len(text) + 1, bool)
        fresh[edges] = True
        before = np.concatenate([[True], space[:-1]]) if len(text) else space
        after = np.concatenate([space[1:], [True]]) if len(text) else space
        starts = np.flatnonzero(~space & (before | fresh[:-1]))
        ends = np.flatnonzero(~space & (after | fresh[1:])) + 1
        t.powers(len(text) + 1)
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(t.values[text] * t.power[: len(text)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * t.inverse[starts])
        yield row, hashes, np.searchsorted(starts, edges)
        row = to


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``words``-word shingles.

    A text of fewer words has its whole sequence as the only one; without words it has none.
    """
    for _, hashes, bounds in word_hashes(column):
        runs = hashes[: max(0, len(hashes) - words + 1)]
        for k in range(1, words):
            runs = mix(runs * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(runs)])
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= words:
                yield np.unique(runs[a : b - words + 1])
            elif b == a:
                yield runs[:0]
            else:
                short = np.uint64(b - a)
                for h in hashes[a:b]:
                    short = mix(np.array([short]) * np.uint64(0xA0761D6478BD642F) + h)[0]
                yield np.array([short], np.uint64)


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set, as two signed 64-bit values."""
    s = shingles.view(np.int64)
    one = mix(shingles + np.uint64(0x632BE59BD9B4E019)).view(np.int64)
    two = mix(shingles ^ np.uint64(0xE7037ED1A0B428DB)).view(np.int64)
    with np.errstate(over="ignore"):
        return int(one.sum(dtype=np.int64)), int((two * (s | 1)).sum(dtype=np.int64))
