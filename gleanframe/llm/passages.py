"""Repeated passages by a compacted De Bruijn graph over word runs.

The nodes are anchors: of every window of ``width`` words, the run of ``ANCHOR``
words with the smallest hash. Equal windows have equal anchors at equal places,
so only anchors that occur more than once can lie in a repeated window. The
edges are the words from one such anchor to the next one of a text. Where all
occurrences of a node leave (or enter) by one edge, the path does not branch and
is compacted: its words repeat as a whole wherever the node occurs, and windows
inside need no comparison of their own. Windows that reach over a branch or the
end of a path are compared one by one, by anchor and hash of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from . import kernels as K

WIDTH = 35
ANCHOR = 8


def sliding_lowest(values: np.ndarray, span: int) -> np.ndarray:
    """Index of the leftmost smallest of each ``span`` neighbours."""
    at, reach = np.arange(len(values)), 1
    while reach * 2 <= span:
        at = _lower(values, at[:-reach], at[reach:])
        reach *= 2
    rest = span - reach
    return _lower(values, at[:-rest], at[rest:]) if rest else at


def _lower(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.where(values[left] <= values[right], left, right)


class Texts:
    """A slice's words, window starts and anchors; word numbers run over the slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hasher: K.Hasher, table: np.ndarray, width: int):
        self.hasher, self.width = hasher, width
        self.words, self.starts, self.ends, self.firsts = hasher.words(data, offsets, table)
        self.windows = K.window_starts(self.firsts, width)
        self.row_windows = np.searchsorted(self.windows, self.firsts)
        if len(self.windows):
            places = np.arange(len(self.words) - ANCHOR + 1)
            grams = hasher.runs(self.words, places, places + ANCHOR)
            self.owner = sliding_lowest(grams, width - ANCHOR + 1)[self.windows]
            self.anchors = np.unique(self.owner)
            self.nodes = grams[self.anchors].view(np.int64)
        else:
            self.owner = self.anchors = np.zeros(0, dtype=np.int64)
            self.nodes = np.zeros(0, dtype=np.int64)
        self.row_anchors = np.searchsorted(self.anchors, self.firsts)

    def run_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.hasher.runs(self.words, starts, ends).view(np.int64)


def _measure() -> K.Kernel:
    """Number of words and hash of all words, for texts that lose none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hashes = [], []
            for first, last, data, offsets in K.text_slices(batch.column(3)):
                raw = data.tobytes()
                for row in range(last - first):
                    words = raw[offsets[row] : offsets[row + 1]].split()
                    sizes.append(len(words))
                    hashes.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(hashes, pa.string())],
                ["doc_id", "k1", "k2", "n_words", "kept_sha256"])

    return run


def _anchors(width: int) -> K.Kernel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = K.Hasher(), K.spaced_words()
        for batch in batches:
            for first, last, data, offsets in K.text_slices(batch.column(2)):
                texts = Texts(data, offsets, hasher, table, width)
                counts = np.diff(texts.row_anchors)
                inside = texts.anchors - np.repeat(texts.firsts[:-1], counts)
                rest = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [rest.column(0), rest.column(1), K.list_array(texts.nodes, counts, pa.int64()),
                     K.list_array(inside.astype(np.int32), counts, pa.int32())], ["k1", "k2", "nodes", "at"])

    return run


def _edges(width: int) -> K.Kernel:
    """A text's repeated anchors with the edges by which each is entered and left; 0 where no repeated one is next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = K.Hasher(), K.spaced_words()
        for batch in batches:
            wanted = batch.column(4)
            for first, last, data, offsets in K.text_slices(batch.column(3)):
                texts = Texts(data, offsets, hasher, table, width)
                node, at, enter, leave, counts = [], [], [], [], []
                for row in range(last - first):
                    a, b = texts.row_anchors[row], texts.row_anchors[row + 1]
                    anchors = texts.anchors[a:b]
                    marked = np.isin(anchors - texts.firsts[row], wanted[first + row].values.to_numpy())
                    linked = marked[:-1] & marked[1:]
                    edge = np.where(linked, texts.run_hashes(anchors[:-1], anchors[1:] + ANCHOR), 0)
                    node.append(texts.nodes[a:b][marked])
                    at.append((anchors - texts.firsts[row])[marked])
                    enter.append(np.append(0, edge)[marked] if len(anchors) else edge)
                    leave.append(np.append(edge, 0)[marked] if len(anchors) else edge)
                    counts.append(int(marked.sum()))
                rest = batch.slice(first, last - first)
                size = np.array(counts)
                lists = [K.list_array(np.concatenate(x), size, pa.int64()) for x in (node, enter, leave)]
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns[:4], lists[0], K.list_array(np.concatenate(at).astype(np.int32), size, pa.int32()),
                     *lists[1:]], ["k1", "k2", "copies", "text", "nodes", "at", "enter", "leave"])

    return run


def _open_windows(width: int) -> K.Kernel:
    """Windows inside compacted paths as spans of starts, and those still to be compared with anchor and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = K.Hasher(), K.spaced_words()
        for batch in batches:
            marks = batch.column(4)
            for first, last, data, offsets in K.text_slices(batch.column(3)):
                texts = Texts(data, offsets, hasher, table, width)
                sure, node, start, value = [], [], [], []
                for row in range(last - first):
                    mark = marks[first + row].values
                    # In the order of places; the shuffle does not keep it.
                    order = np.argsort(mark.field("at").to_numpy())
                    at = mark.field("at").to_numpy()[order].astype(np.int64)
                    one_in = mark.field("one_in").to_numpy(zero_copy_only=False)[order]
                    one_out = mark.field("one_out").to_numpy(zero_copy_only=False)[order]
                    n = len(at)
                    left = at[np.maximum.accumulate(np.where(one_in, 0, np.arange(n)))]
                    right = (at + ANCHOR)[np.minimum.accumulate(np.where(one_out, n - 1, np.arange(n))[::-1])[::-1]]
                    a, b = texts.row_windows[row], texts.row_windows[row + 1]
                    begin = texts.windows[a:b] - texts.firsts[row]
                    owner = texts.owner[a:b] - texts.firsts[row]
                    which = np.minimum(np.searchsorted(at, owner), n - 1)
                    known = at[which] == owner
                    inside = known & (begin >= left[which]) & (begin + width <= right[which])
                    sure.append(begin[inside])
                    rest = np.flatnonzero(known & ~inside)
                    node.append(texts.nodes[np.searchsorted(texts.anchors, texts.owner[a:b][rest])])
                    start.append(begin[rest])
                    value.append(texts.run_hashes(texts.windows[a:b][rest], texts.windows[a:b][rest] + width))
                out = batch.slice(first, last - first)
                spans = [_spans(s) for s in sure]
                opened = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate(node), pa.int64()), pa.array(np.concatenate(value), pa.int64()),
                     pa.array(np.concatenate(start).astype(np.int32), pa.int32())], ["node", "value", "start"])
                cuts = np.append(0, np.cumsum([len(s) for s in start])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*out.columns[:3], pa.array([s[0] for s in spans], pa.list_(pa.int32())),
                     pa.array([s[1] for s in spans], pa.list_(pa.int32())),
                     pa.ListArray.from_arrays(pa.array(cuts), opened)],
                    ["k1", "k2", "copies", "first", "last", "opened"])

    return run


def _spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of neighbouring numbers."""
    if len(starts) == 0:
        return starts.astype(np.int32), starts.astype(np.int32)
    breaks = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.append(0, breaks + 1)].astype(np.int32), starts[np.append(breaks, len(starts) - 1)].astype(np.int32)


def _kept(width: int) -> K.Kernel:
    """Number of words removed and hash of those kept, and the spans removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = K.spaced_words()
        for batch in batches:
            removed, hashes, spans = [], [], []
            for first, last, data, offsets in K.text_slices(batch.column(2)):
                starts, ends, firsts = K.word_bounds(data, offsets, table)
                raw = data.tobytes()
                for row in range(last - first):
                    size = int(firsts[row + 1] - firsts[row])
                    marks = np.zeros(size + 1, dtype=np.int64)
                    for a, b in ((batch.column(3)[first + row].values, batch.column(4)[first + row].values),
                                 (batch.column(5)[first + row].values,) * 2):
                        if a is not None and len(a):
                            np.add.at(marks, a.to_numpy(), 1)
                            np.add.at(marks, b.to_numpy() + width, -1)
                    gone = np.cumsum(marks)[:size] > 0
                    keep = np.flatnonzero(~gone) + firsts[row]
                    words = [raw[starts[i] : ends[i]] for i in keep]
                    removed.append(int(gone.sum()))
                    hashes.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    a, b = _spans(np.flatnonzero(gone))
                    spans.append([{"first": int(x), "last": int(y)} for x, y in zip(a, b)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(hashes, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))],
                ["k1", "k2", "n_removed", "kept", "spans"])

    return run


def repeated_passages(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans``, one row a row of ``docs(doc_id, text)``.

    Words are runs between whitespace, unchanged. A window of ``width`` words
    whose words also start anywhere else, in another row or the same, is
    repeated, and the words it covers are removed; ``spans`` are the removed
    words' first and last numbers, ``kept_sha256`` hashes the others, joined by
    a space. Windows are judged on the input. Null and empty texts and those of
    fewer words lose nothing; repeated rows and copies of ``width`` words or
    more lose all. Ids may be null or repeat: texts are known by two hashes of
    64 bits, windows by their anchor's and their own. Other columns are not
    looked at. No rows: none.

    Copies of a text are one text with a weight, so their windows meet once.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    measured = materialised(texts.mapInArrow(
        _measure(), "doc_id long, k1 long, k2 long, n_words long, kept_sha256 string"), "measured")
    found = texts.select("k1", "k2", "text").mapInArrow(_anchors(width), "k1 long, k2 long, nodes array<long>, at array<int>")
    anchors = materialised(found.where(F.size("nodes") > 0).groupBy("k1", "k2").agg(
        F.count("*").alias("copies"), F.first("nodes").alias("nodes"), F.first("at").alias("at")), "anchors")

    placed = anchors.select("k1", "copies", F.explode(F.arrays_zip("nodes", "at")).alias("n")).select(
        "k1", "copies", F.col("n.nodes").alias("node"), F.col("n.at").alias("at"))
    # What is joined with the rows it was counted on is written first: only then does Spark split a node that very many texts share.
    repeated = materialised(placed.groupBy("node").agg(F.sum("copies").alias("n")).where("n > 1").select("node"), "repeated")
    # A clash of k1 alone only makes more windows be compared.
    candidates = placed.select("k1", "node", "at").join(repeated, "node").groupBy("k1").agg(F.collect_set("at").alias("wanted"))
    holders = measured.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("_doc"))
    holders = holders.join(candidates, "k1").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "copies", "_doc", "wanted")
    sources = texts.join(holders, texts["doc_id"].eqNullSafe(holders["_doc"]) & (texts["k1"] == holders["_k1"])
                         & (texts["k2"] == holders["_k2"]))
    edged = sources.select("k1", "k2", "copies", "text", "wanted").mapInArrow(
        _edges(width), "k1 long, k2 long, copies long, text string, nodes array<long>, at array<int>, "
                       "enter array<long>, leave array<long>")
    graph = materialised(edged.where(F.size("nodes") > 0).groupBy("k1", "k2").agg(
        *[F.first(c).alias(c) for c in ("copies", "text", "nodes", "at", "enter", "leave")]), "graph")

    steps = graph.select("k1", "k2", F.explode(F.arrays_zip("nodes", "at", "enter", "leave")).alias("s")).select(
        "k1", "k2", F.col("s.nodes").alias("node"), F.col("s.at").alias("at"), F.col("s.enter").alias("enter"),
        F.col("s.leave").alias("leave"))
    branches = materialised(steps.groupBy("node").agg(
        ((F.min("enter") == F.max("enter")) & (F.min("enter") != 0)).alias("one_in"),
        ((F.min("leave") == F.max("leave")) & (F.min("leave") != 0)).alias("one_out")), "branches")
    marks = steps.select("node", "k1", "k2", "at").join(branches, "node").groupBy("k1", "k2").agg(
        F.collect_list(F.struct("at", "one_in", "one_out")).alias("marks"))
    compared = graph.select("k1", "k2", "copies", "text").join(marks, ["k1", "k2"]).select(
        "k1", "k2", "copies", "text", "marks").mapInArrow(
        _open_windows(width), "k1 long, k2 long, copies long, first array<int>, last array<int>, "
                              "opened array<struct<node:long,value:long,start:int>>")
    compared = materialised(compared, "windows")

    opened = compared.select("k1", "k2", "copies", F.explode("opened").alias("w")).select(
        "k1", "k2", "copies", F.col("w.node").alias("node"), F.col("w.value").alias("value"), F.col("w.start").alias("start"))
    again = materialised(opened.groupBy("node", "value").agg(F.sum("copies").alias("n")).where("n > 1").select("node", "value"), "again")
    starts = opened.where("copies = 1").join(again, ["node", "value"]).groupBy("k1", "k2").agg(
        F.collect_list("start").alias("starts"))
    # Copied texts lose all words; only the others are cut.
    single = graph.where("copies = 1").select("k1", "k2", "text").join(
        compared.select("k1", "k2", "first", "last"), ["k1", "k2"]).join(starts, ["k1", "k2"], "left").where(
        "starts is not null or size(first) > 0")
    cut = single.select("k1", "k2", "text", "first", "last", "starts").mapInArrow(
        _kept(width), "k1 long, k2 long, n_removed long, kept string, spans array<struct<first:long,last:long>>")
    weights = measured.groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    known = weights.where("copies > 1").join(cut, ["k1", "k2"], "full_outer")
    whole = (F.coalesce("copies", F.lit(1)) > 1) & (F.col("n_words") >= width)
    return measured.join(known, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "kept_sha256")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("n_words") - 1).alias("last"))))
        .otherwise(F.coalesce("spans", F.lit([]).cast("array<struct<first:bigint,last:bigint>>"))).alias("spans"))
