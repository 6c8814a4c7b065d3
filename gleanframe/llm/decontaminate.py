"""Benchmark passages found in training text by suffix arrays.

Each task sorts the suffixes of its texts' words (a suffix array a slice of
text) and looks every benchmark window up by binary search. The benchmark goes
to the tasks in blocks of bounded size, one on the driver at a time. A benchmark of one
block is one pass over the texts. One of more blocks first marks the texts in which
a window may occur, by a bitmap of all windows' hashes of fixed size, and then passes its blocks over those alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialised
from . import kernels as K

WINDOW = 10
BLOCK_BYTES = 8 << 20
SLICE_BYTES = 1 << 19
FILTER_BITS = 1 << 22
# Bits of one row of Spark's bitmap aggregate.
_BITMAP = 32768

_MATCHES = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("item_pos", T.LongType()),
    T.StructField("doc_pos", T.LongType()), T.StructField("words", T.LongType())]))
_ARROW_MATCH = pa.struct([("item_id", pa.int64()), ("item_pos", pa.int64()), ("doc_pos", pa.int64()), ("words", pa.int64())])


class Windows:
    """Every window of a block's items: its words (hashes), item and place."""

    def __init__(self, items: list[tuple[int | None, str]], width: int, hasher: K.Hasher):
        self.width, self.ids = width, [i for i, _ in items]
        words, item, place, length = [], [], [], []
        column = pa.array([t for _, t in items], pa.string())
        for first, _, data, offsets in K.text_slices(column):
            hashes, _, _, firsts = hasher.words(data, offsets, K.letter_words(True), K.lower_table())
            for row in range(len(offsets) - 1):
                own = hashes[firsts[row] : firsts[row + 1]]
                size = min(width, len(own))
                for at in range(len(own) - size + 1 if size else 0):
                    words.append(np.pad(own[at : at + size], (0, width - size)))
                    item.append(first + row)
                    place.append(at)
                    length.append(size)
        self.words = np.array(words, dtype=np.uint64).reshape(-1, width)
        self.item, self.place = np.array(item, dtype=np.int64), np.array(place, dtype=np.int64)
        self.length = np.array(length, dtype=np.int64)


class SuffixArray:
    """Suffixes of the rows' words in the order of their first ``depth`` words or more."""

    def __init__(self, hashes: np.ndarray, firsts: np.ndarray, depth: int):
        self.known, ids = np.unique(hashes, return_inverse=True)
        n = len(hashes)
        self.end = np.repeat(firsts[1:], np.diff(firsts))
        self.ids = np.append(ids + 1, 0)  # 0: past a row's end, before every word
        rank, sorted_to = self.ids[:n].astype(np.int64), 1
        bits = int(len(self.known)).bit_length()
        if 3 * bits <= 62:
            key = rank << (2 * bits) | self._after(rank, 1) << bits | self._after(rank, 2)
            sorted_to = 3
        else:
            key = rank
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        new = np.append(True, key[1:] != key[:-1])
        while True:
            # A group of equal suffixes has the place of its first as rank, counted from 1.
            starts = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
            if sorted_to >= depth:
                break
            rank = np.empty(n, dtype=np.int64)
            rank[self.order] = starts
            tied = ~new
            tied[:-1] |= ~new[1:]
            at = np.flatnonzero(tied)
            if len(at) == 0:
                break
            some = self.order[at]
            key = starts[at] << 32 | self._after(rank, sorted_to, some)
            by = np.argsort(key, kind="stable")
            self.order[at] = some[by]
            key = key[by]
            new[at] = np.append(True, key[1:] != key[:-1])
            sorted_to *= 2

    def _after(self, rank: np.ndarray, step: int, at: np.ndarray | None = None) -> np.ndarray:
        at = np.arange(len(rank)) if at is None else at
        to = at + step
        inside = to < self.end[at]
        return np.where(inside, rank[np.where(inside, to, 0)], 0)

    def find(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Windows that occur, and the word at which they do, one entry an occurrence."""
        nothing = np.zeros(0, dtype=np.int64)
        if len(self.order) == 0 or len(windows.words) == 0:
            return nothing, nothing
        place = np.minimum(np.searchsorted(self.known, windows.words), len(self.known) - 1)
        used = np.arange(windows.width) < windows.length[:, None]
        asked = np.flatnonzero(((self.known[place] == windows.words) | ~used).all(axis=1))
        if len(asked) == 0:
            return nothing, nothing
        words, used = place[asked] + 1, used[asked]
        low, high = self._bound(words, used, False), self._bound(words, used, True)
        count = high - low
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(asked, count), self.order[np.repeat(low, count) + within]

    def _bound(self, words: np.ndarray, used: np.ndarray, upper: bool) -> np.ndarray:
        """First suffix whose front is not below (``upper``: above) the window, by binary search."""
        low, high = np.zeros(len(words), dtype=np.int64), np.full(len(words), len(self.order), dtype=np.int64)
        steps = np.arange(words.shape[1])
        while (low < high).any():
            middle = (low + high) // 2
            start = self.order[np.minimum(middle, len(self.order) - 1)]
            to = start[:, None] + steps
            front = self.ids[np.where(to < self.end[start][:, None], to, len(self.ids) - 1)]
            differs = (front != words) & used
            first = differs.argmax(axis=1)
            rows = np.arange(len(words))
            below = differs.any(axis=1) & (front[rows, first] < words[rows, first])
            if upper:
                below |= ~differs.any(axis=1)
            moving = low < high
            low = np.where(moving & below, middle + 1, low)
            high = np.where(moving & ~below, middle, high)
        return low


def longest(windows: Windows, asked: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring occurrences joined to the longest verbatim matches: row, item, item place, text place, words."""
    item, place = windows.item[asked], windows.place[asked]
    order = np.lexsort((place, at - place, item, row))
    row, item, place, at = row[order], item[order], place[order], at[order]
    length = windows.length[asked][order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = ((row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1)
               | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order))[: len(first)] - 1
    return row[first], item[first], place[first], at[first], place[last] - place[first] + length[last]


def _covered(starts: np.ndarray, lengths: np.ndarray, size: int) -> int:
    marks = np.zeros(size + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + lengths, -1)
    return int((np.cumsum(marks)[:size] > 0).sum())


def _search(items: list[tuple[int | None, str]], width: int, text: str) -> K.Kernel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = K.Hasher()
        windows, table, fold = Windows(items, width, hasher), K.letter_words(True), K.lower_table()
        for batch in batches:
            row = batch.column(0)
            earlier = batch.column(1).to_pylist()
            for first, last, data, offsets in K.text_slices(row.field(text), SLICE_BYTES):
                n_words, n_hit, matches = [], [], []
                hashes, _, _, firsts = hasher.words(data, offsets, table, fold)
                sizes = np.diff(firsts)
                own: dict[int, list] = {}
                if len(hashes):
                    asked, at = SuffixArray(hashes, firsts, width).find(windows)
                    owner = np.searchsorted(firsts, at, side="right") - 1
                    for r, i, p, a, w in zip(*longest(windows, asked, at - firsts[owner], owner)):
                        own.setdefault(int(r), []).append(
                            {"item_id": windows.ids[i], "item_pos": int(p), "doc_pos": int(a), "words": int(w)})
                for r in range(last - first):
                    found = earlier[first + r] + own.get(r, [])
                    n_words.append(int(sizes[r]))
                    n_hit.append(_covered(np.array([m["doc_pos"] for m in found]), np.array([m["words"] for m in found]),
                                          int(sizes[r])) if found else 0)
                    matches.append(found)
                yield pa.RecordBatch.from_arrays(
                    [row.slice(first, last - first), pa.array(matches, pa.list_(_ARROW_MATCH)),
                     pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64())],
                    ["row", "matches", "n_words", "n_hit"])

    return run


def _spans(hasher: K.Hasher, sums: np.ndarray, starts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    return hasher.spans(sums, starts, starts + size)


def _window_hashes(width: int) -> K.Kernel:
    """Length and hash of every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table, fold = K.Hasher(), K.letter_words(True), K.lower_table()
        for batch in batches:
            for _, _, data, offsets in K.text_slices(batch.column(0), SLICE_BYTES):
                hashes, _, _, firsts = hasher.words(data, offsets, table, fold)
                lengths = np.diff(firsts)
                short = np.flatnonzero((lengths > 0) & (lengths < width))
                starts = np.append(K.window_starts(firsts, width), firsts[short])
                size = np.append(np.full(len(starts) - len(short), width), lengths[short])
                found = _spans(hasher, hasher.sums(hashes), starts, size) if len(starts) else np.zeros(0, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(size.astype(np.int64)), pa.array(found.view(np.int64))], ["size", "window"])

    return run


def _marked(wanted: np.ndarray, sizes: list[int], text: str) -> K.Kernel:
    """``row, matches, n_words`` and ``marked``: whether a window may occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table, fold = K.Hasher(), K.letter_words(True), K.lower_table()
        for batch in batches:
            row, matches = batch.column(0), batch.column(1)
            for first, last, data, offsets in K.text_slices(row.field(text), SLICE_BYTES):
                hashes, _, _, firsts = hasher.words(data, offsets, table, fold)
                sums, marked = hasher.sums(hashes), np.zeros(last - first, dtype=bool)
                for size in sizes:
                    starts = K.window_starts(firsts, size)
                    at = (_spans(hasher, sums, starts, size) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                    hit = starts[(wanted[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
                    marked[np.searchsorted(firsts, hit, side="right") - 1] = True
                yield pa.RecordBatch.from_arrays(
                    [row.slice(first, last - first), matches.slice(first, last - first), pa.array(np.diff(firsts).astype(np.int64)),
                     pa.array(marked)], ["row", "matches", "n_words", "marked"])

    return run


def _filter(benchmark: DataFrame, width: int) -> tuple[np.ndarray, list[int]]:
    """The bitmap of all windows' hashes, and the lengths that windows have."""
    windows = materialised(benchmark.select("text").mapInArrow(_window_hashes(width), "size long, window long"), "windows")
    place = F.pmod("window", F.lit(FILTER_BITS))
    wanted = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for part in windows.groupBy(F.floor(place / _BITMAP).cast("int").alias("bucket")).agg(
            F.bitmap_construct_agg(place % _BITMAP).alias("bits")).collect():
        wanted[part["bucket"] * _BITMAP // 8 :][: _BITMAP // 8] = np.frombuffer(part["bits"], dtype=np.uint8)
    return wanted, sorted(r["size"] for r in windows.select("size").distinct().collect())


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's items in blocks of at most ``limit`` bytes (or one item), one block on the driver at a time."""
    block, size = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        own = len(text.encode())
        if block and size + own > limit:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += own
    if block:
        yield block


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WINDOW,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (all columns of ``docs``), ``matches``, ``n_words`` and ``n_hit``, one row a document.

    Words are runs of ASCII letters and digits and of everything beyond ASCII,
    A-Z lower-cased. An item's windows are its runs of ``width`` words; an item
    of fewer words is one window; one without words has none. ``matches`` holds
    each longest run of windows found (item, first word in the item, first word
    in the document, words); ``n_hit`` counts the words inside any of them.
    Null texts have no words. Items with a null id count like others; repeated
    items are found once each; without items every document is clean. No rows give none; repeated
    rows are found alike. Column
    names of ``docs`` cannot clash, as they stay inside ``row``.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      F.lit([]).cast(_MATCHES).alias("matches"))
    schema = T.StructType([T.StructField("row", row.schema["row"].dataType), T.StructField("matches", _MATCHES),
                           T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType())])
    blocks = item_blocks(benchmark, block_bytes)
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        return row.mapInArrow(_search(block, width, text), schema)
    wanted, sizes = _filter(benchmark, width)
    marked = row.mapInArrow(_marked(wanted, sizes, text), T.StructType([*schema.fields[:3], T.StructField("marked", T.BooleanType())]))
    found = materialised(marked.where("marked").select("row", "matches"), "marked")
    while block is not None:
        found = materialised(found.select("row", "matches").mapInArrow(_search(block, width, text), schema), "searched")
        block, following = following, next(blocks, None)
    return marked.where("NOT marked").select("row", "matches", "n_words", F.lit(0).cast("long").alias("n_hit")).unionByName(found)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WINDOW) -> DataFrame:
    """The documents without a word inside a benchmark window, with the columns of ``docs``."""
    return benchmark_matches(docs, benchmark, text, width).where("n_hit = 0").select("row.*")
