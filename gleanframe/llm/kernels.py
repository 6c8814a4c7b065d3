"""Words and their hashes out of Arrow text columns, without a Python loop per word.

Texts are worked on in slices of bounded size, so that memory follows the
longest text and the slice, not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
# The window whitespace of the contracts: space and the control characters 9 to 13.
_SPACES = [0x20, *range(0x09, 0x0E)]
_FACTOR = 0x9E3779B97F4A7C15


def spaced_words() -> np.ndarray:
    """Per byte: part of a word that ends at whitespace."""
    table = np.ones(256, dtype=bool)
    table[_SPACES] = False
    return table


def letter_words(digits: bool) -> np.ndarray:
    """Per byte: ASCII letters, all of UTF-8 beyond ASCII, and digits if wanted."""
    table = np.zeros(256, dtype=bool)
    table[0x80:] = True
    for first, last in ((0x41, 0x5A), (0x61, 0x7A), *([(0x30, 0x39)] if digits else [])):
        table[first : last + 1] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, last row (exclusive), bytes and row offsets into them; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    with np.errstate(over="ignore"):
        values = values ^ (values >> np.uint64(33))
        values = values * np.uint64(0xFF51AFD7ED558CCD)
        values = values ^ (values >> np.uint64(29))
        values = values * np.uint64(0xC4CEB9FE1A85EC53)
        return values ^ (values >> np.uint64(32))


class Hasher:
    """Hashes of words and of runs of words by differences of prefix sums.

    A run's hash is sum(value[i] * base ** (i - start)), read off one cumulative
    sum, whatever the run's length. Made once per task.
    """

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bytes = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64(0xD6E8FEB86659FD93)
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + (1 << 16))
            with np.errstate(over="ignore"):
                up = np.full(size, self.base, dtype=np.uint64)
                down = np.full(size, self.inverse, dtype=np.uint64)
                up[0] = down[0] = 1
                up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
            if n > 4 * SLICE_BYTES:  # a giant text: not kept
                return up, down
            self.up, self.down = up, down
        return self.up, self.down

    def sums(self, values: np.ndarray) -> np.ndarray:
        up, _ = self.powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * up[: len(values)], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = self.powers(len(sums))
        with np.errstate(over="ignore"):
            raw = (sums[ends] - sums[starts]) * down[starts]
            return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(_FACTOR))

    def runs(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.spans(self.sums(values), starts, ends)

    def words(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: np.ndarray | None = None):
        """Word hashes, word starts and ends (bytes), and each row's first word, with the end as last entry."""
        starts, ends, firsts = word_bounds(data, offsets, table)
        if fold is not None:
            data = fold[data]
        return self.runs(self.bytes[data], starts, ends), starts, ends, firsts


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Byte starts and ends of the words, and each row's first word (one entry more than rows)."""
    inside = table[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    closing = offsets[1:][offsets[1:] > 0] - 1
    after[closing] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def window_starts(firsts: np.ndarray, width: int) -> np.ndarray:
    """Word numbers at which a whole window of one row starts."""
    total = int(firsts[-1])
    room = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(total)
    return np.flatnonzero(room >= width)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups out of batches that are sorted by ``keys``; memory follows the largest group."""
    held: list[pa.RecordBatch] = []

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for key in keys:
            values = table.column(key).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        last = [batch.column(batch.schema.get_field_index(k))[batch.num_rows - 1].as_py() for k in keys]
        first = [held[0].column(held[0].schema.get_field_index(k))[0].as_py() for k in keys]
        if first == last:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = bounds(table)
        for a, b in zip(cut[:-2], cut[1:-1]):
            yield table.slice(a, b - a)
        rest = table.slice(cut[-2]).combine_chunks()
        held = rest.to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        cut = bounds(table)
        for a, b in zip(cut[:-1], cut[1:]):
            yield table.slice(a, b - a)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def local_roots(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member number of each member's connected part, by label spreading with shortcuts."""
    roots = np.arange(size)
    while True:
        low = np.minimum(roots[left], roots[right])
        fresh = roots.copy()
        np.minimum.at(fresh, left, low)
        np.minimum.at(fresh, right, low)
        np.minimum.at(fresh, roots[left], low)
        np.minimum.at(fresh, roots[right], low)
        fresh = fresh[fresh]
        if np.array_equal(fresh, roots):
            return roots
        roots = fresh


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
