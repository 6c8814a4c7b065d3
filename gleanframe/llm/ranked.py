"""Ranked lexical search by pipelined term partitioning.

Documents are indexed in blocks: per block and query term, the documents that hold it.
Terms belong to owners, the rarest terms to the first. A bundle of items starts at
each block with empty accumulators and passes the owners in turn; at each one it meets
that owner's postings of the block (a cogroup), which add their integer
contributions. After the last owner a block gives its best documents.

An accumulator is let go only when it cannot reach its block's best any more: when its
sum and the most that later owners can add stay below a sum already reached by as
many documents as are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialised
from . import kernels as K
from .prefix import prefix_sums

TOP = 10
OWNERS = 4
BLOCK_DOCS = 8192
BLOCK_POSTINGS = 1 << 20
BUNDLE_ITEMS = 256
# A filter of fixed size tells the tasks which words may be query terms; what passes is joined with the terms.
FILTER_BITS = 1 << 22
_BITMAP = 32768
_STATE = "bundle long, block long, item_no int, rest long, slots binary, sums binary, ids array<{id}>"


def _term_lists(text_at: int) -> K.Kernel:
    """The first column and the distinct words (hashes) of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table, fold = K.Hasher(), K.letter_words(True), K.lower_table()
        for batch in batches:
            for first, last, data, offsets in K.text_slices(batch.column(text_at)):
                hashes, _, _, firsts = hasher.words(data, offsets, table, fold)
                lists = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(firsts[:-1], firsts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(lists, pa.list_(pa.int64()))], ["item_id", "terms"])

    return run


class _Block:
    """Postings of the documents gathered so far."""

    def __init__(self):
        self.terms, self.slots, self.counts, self.sizes, self.ids = [], [], [], [], []
        self.docs = self.postings = 0

    def add(self, ids: pa.Array, sizes: np.ndarray, terms: np.ndarray, slots: np.ndarray) -> None:
        order = np.lexsort((slots, terms))
        terms, slots = terms[order], slots[order]
        new = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (slots[1:] != slots[:-1]))[: len(terms)])
        self.terms.append(terms[new])
        self.slots.append(slots[new] + self.docs)
        self.counts.append(np.diff(np.append(new, len(terms))))
        self.sizes.append(sizes)
        self.ids.append(ids)
        self.docs += len(sizes)
        self.postings += len(new)

    def batch(self, block: int, schema: pa.Schema) -> pa.RecordBatch:
        """A row for the block (``ids`` and, as ``counts``, the documents' words) and one for each term."""
        sizes = np.concatenate(self.sizes)
        terms, slots, counts = (np.concatenate(x) for x in (self.terms, self.slots, self.counts))
        order = np.argsort(terms, kind="stable")
        terms, slots, counts = terms[order], slots[order].astype(np.int32), counts[order].astype(np.int32)
        first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])[: len(terms)])
        n, ends = len(first), np.append(first, len(terms))

        def packed(values: np.ndarray) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(values)])

        def column(of_block, of_terms, kind: pa.DataType) -> pa.Array:
            return pa.concat_arrays([pa.array([of_block], kind), of_terms if isinstance(of_terms, pa.Array) else pa.array(of_terms, kind)])

        ids = pa.concat_arrays(self.ids)
        own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        at = first[:n]
        most = np.maximum.reduceat(counts, at) if n else counts
        least = np.minimum.reduceat(sizes[slots], at) if n else sizes[:0]
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n + 1, block, dtype=np.int64)), column(None, terms[at].view(np.int64), pa.int64()),
            column(len(sizes), np.diff(ends), pa.int64()), column(int(sizes.sum()), np.zeros(n, dtype=np.int64), pa.int64()),
            column(0, most, pa.int64()), column(0, least, pa.int64()), column(b"", packed(slots), pa.binary()),
            column(sizes.tobytes(), packed(counts), pa.binary()),
            pa.concat_arrays([own.cast(schema.field("ids").type), pa.nulls(n, schema.field("ids").type)]),
        ], schema=schema)


def _index(wanted: np.ndarray, block_docs: int) -> K.Kernel:
    """Blocks of postings of the words that pass the filter."""
    columns = [("block", pa.int64()), ("term", pa.int64()), ("docs", pa.int64()), ("words", pa.int64()), ("most", pa.int64()),
               ("least", pa.int64()), ("slots", pa.binary()), ("counts", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table, fold = K.Hasher(), K.letter_words(True), K.lower_table()
        number, held = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            schema = pa.schema([*columns, ("ids", pa.list_(batch.column(0).type))])
            for first, last, data, offsets in K.text_slices(batch.column(1)):
                hashes, _, _, firsts = hasher.words(data, offsets, table, fold)
                sizes = np.diff(firsts)
                real = np.flatnonzero(sizes)
                if not len(real):
                    continue
                low = (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                hit = np.flatnonzero(wanted[low >> 3] >> (low & 7).astype(np.uint8) & 1)
                slot = np.cumsum(sizes > 0)[np.searchsorted(firsts, hit, side="right") - 1] - 1
                held.add(batch.column(0).slice(first, last - first).take(pa.array(real)), sizes[real].astype(np.int64), hashes[hit], slot)
                if held.docs >= block_docs or held.postings >= BLOCK_POSTINGS:
                    yield held.batch(number, schema)
                    number, held = number + 1, _Block()
        if held.docs:
            yield held.batch(number, schema)

    return run


def _norms(sizes: np.ndarray, docs: int, words: int) -> np.ndarray:
    """100 - 90 + 90 times a document's words over the mean, rounded down."""
    wide = int(sizes.max(initial=0)) * 90 * docs >= 2**63
    return (10 + sizes.astype(object if wide else np.int64) * (90 * docs) // words).astype(np.int64)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks)


def _owner(top: int, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One owner's postings added to the accumulators of one bundle in one block."""

    def best(sums: np.ndarray, slots: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return np.lexsort((rank[slots], -sums))[:top]

    def run(state: pa.Table, postings: pa.Table) -> pa.Table:
        rows = state.to_pydict()
        at = rows["item_no"].index(-1)
        norms = np.frombuffer(rows["sums"][at], dtype=np.int64)
        ids = _flat(state.column("ids"))[at].values
        held = {i: (r, np.frombuffer(s, dtype=np.int32), np.frombuffer(v, dtype=np.int64)) for i, r, s, v in zip(
            rows["item_no"], rows["rest"], rows["slots"], rows["sums"]) if i >= 0}
        adds: dict[int, list] = {}
        rests: dict[int, int] = {}
        for items, rest, weight, slots, counts in zip(*(postings.column(c).to_pylist() for c in ("items", "rests", "weight", "slots", "counts"))):
            slots, tf = np.frombuffer(slots, dtype=np.int32), np.frombuffer(counts, dtype=np.int32).astype(np.int64)
            share = weight * (1_000_000_000 * tf // (1000 * tf + 8 * norms[slots]))
            for item, left in zip(items, rest):
                adds.setdefault(item, []).append((slots, share))
                rests[item] = left
        out: list[tuple] = []
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy() if last else None
        rank = np.argsort(order) if last else None
        for item in sorted(held.keys() | adds.keys()):
            left, slots, sums = held.get(item, (0, None, None))
            left = rests.get(item, left)
            if item in adds:
                dense = np.zeros(len(norms), dtype=np.int64)
                if slots is not None:
                    dense[slots] = sums
                for places, share in adds[item]:
                    dense[places] += share
                slots = np.flatnonzero(dense).astype(np.int32)
                sums = dense[slots]
            if len(sums) > top:
                reached = np.partition(sums, -top)[-top]
                kept = sums + (0 if last else left) >= reached
                slots, sums = slots[kept], sums[kept]
            if last:
                for i in best(sums, slots, rank):
                    out.append((item, ids[int(slots[i])], int(sums[i])))
            else:
                out.append((item, left, slots.tobytes(), sums.tobytes()))
        bundle = rows["bundle"][0]
        if last:
            return pa.table({"bundle": pa.array([bundle] * len(out), pa.int64()), "item_no": pa.array([x[0] for x in out], pa.int32()),
                             "doc_id": pa.array([x[1].as_py() for x in out], ids.type), "score": pa.array([x[2] for x in out], pa.int64())})
        out.append((-1, 0, b"", norms.tobytes()))
        ids_of = pa.concat_arrays([pa.nulls(len(out) - 1, state.schema.field("ids").type), _flat(state.column("ids")).slice(at, 1)])
        return pa.table({
            "bundle": pa.array([bundle] * len(out), pa.int64()), "block": pa.array([rows["block"][0]] * len(out), pa.int64()),
            "item_no": pa.array([x[0] for x in out], pa.int32()), "rest": pa.array([x[1] for x in out], pa.int64()),
            "slots": pa.array([x[2] for x in out], pa.binary()), "sums": pa.array([x[3] for x in out], pa.binary()), "ids": ids_of})

    return run


def _start(docs: int, words: int) -> K.Kernel:
    """A block's state before the first owner, for each bundle: only the norms and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [_norms(np.frombuffer(c.as_py(), dtype=np.int64), docs, words).tobytes() for c in batch.column(2)]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([-1] * n, pa.int32()), pa.array([0] * n, pa.int64()),
                 pa.array([b""] * n, pa.binary()), pa.array(sums, pa.binary()), batch.column(3)],
                ["bundle", "block", "item_no", "rest", "slots", "sums", "ids"])

    return run


def _wanted(terms: DataFrame) -> np.ndarray:
    """The filter: one bit for each hash value that a query term has, in a bitmap of fixed size."""
    place = F.pmod("term", F.lit(FILTER_BITS))
    rows = terms.groupBy(F.floor(place / _BITMAP).cast("int").alias("bucket")).agg(
        F.bitmap_construct_agg(place % _BITMAP).alias("bits")).collect()
    wanted = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in rows:
        wanted[row["bucket"] * _BITMAP // 8 :][: _BITMAP // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return wanted


def top_documents(docs: DataFrame, items: DataFrame, top: int = TOP, owners: int = OWNERS, block_docs: int = BLOCK_DOCS,
                  bundle_items: int = BUNDLE_ITEMS, text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` highest-scoring documents with a score above 0.

    Terms are runs of ASCII letters and digits and of everything beyond ASCII,
    A-Z lower-cased (compared by 64-bit hashes). With N documents that hold a
    term, L terms in all, n in a document, df documents with the term and tf its
    occurrences there: the weight is floor(1000 ln((2N+2)/(2df+1))) and adds
    weight * (10^9 tf div (1000 tf + 8 m)), m = 10 + 90 n N div L. Equal scores go by
    ``doc_id``, null last. Null and empty texts have no terms: such documents are
    not counted, such items give no rows. Items of one id (null is an id) are one
    item with the terms of all; repeated documents are documents of their own. Without documents or
    items there are no rows. Other columns are not read, so no name can clash. A long text is
    indexed whole by one task.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType
    item_type = items.schema["item_id"].dataType
    lists = items.select("item_id", text).mapInArrow(_term_lists(1), T.StructType([
        T.StructField("item_id", item_type), T.StructField("terms", T.ArrayType(T.LongType()))]))
    pairs = materialised(lists.select("item_id", F.explode("terms").alias("term")).distinct(), "terms")
    ids = pairs.select("item_id").distinct()
    bundles = max(1, math.ceil(ids.count() / bundle_items))
    numbered = ids.withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles))).withColumn(
        "item_no", F.row_number().over(Window.partitionBy("bundle").orderBy("item_id")) - 1)
    numbered = materialised(numbered, "items")

    index_schema = T.StructType([
        *[T.StructField(n, T.LongType()) for n in ("block", "term", "docs", "words", "most", "least")],
        T.StructField("slots", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type))])
    index = materialised(docs.select("doc_id", text).mapInArrow(_index(_wanted(pairs), block_docs), index_schema), "index")
    blocks, postings = index.where("term IS NULL"), index.where("term IS NOT NULL")
    n_docs, n_words = blocks.agg(F.sum("docs"), F.sum("words")).first()
    if not n_words:
        return numbered.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(id_type).alias("doc_id"),
                                              F.lit(0).cast("long").alias("score"))

    def most(tf: str, n: str) -> str:
        return f"(1000000000 * {tf}) div (1000 * {tf} + 8 * (10 + (90 * cast({n} AS decimal(20,0)) * {n_docs}) div {n_words}))"

    terms = (postings.groupBy("term").agg(F.sum("docs").alias("df"), F.max("most").alias("most"), F.min("least").alias("least"))
             .join(pairs.select("term").distinct(), "term")
             .withColumn("weight", F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long"))
             .withColumn("bound", F.expr(f"weight * ({most('most', 'least')})").cast("long")))
    placed = materialised(prefix_sums(terms, [F.col("df"), F.col("term")], {"before": "df"}, "owners"), "owners")
    total = placed.agg(F.sum("df")).first()[0] or 1
    owner = F.least(F.lit(owners - 1), F.floor(F.col("before") * owners / total)).cast("int")
    wanted = materialised(pairs.join(numbered, pairs["item_id"].eqNullSafe(numbered["item_id"])).select("bundle", "item_no", "term")
                          .join(placed.select("term", "weight", "bound", owner.alias("owner")), "term"), "wanted")
    later = wanted.groupBy("bundle", "item_no").agg(*[
        F.coalesce(F.sum(F.when(F.col("owner") > s, F.col("bound"))), F.lit(0)).alias(f"rest{s}") for s in range(owners)])
    rest = F.element_at(F.array(*[f"rest{s}" for s in range(owners)]), F.col("owner") + 1)
    served = materialised(
        wanted.join(later, ["bundle", "item_no"]).groupBy("bundle", "term", "weight", "owner").agg(
            F.collect_list(F.struct("item_no", rest.alias("rest"))).alias("asked"))
        .select("bundle", "term", "weight", "owner", F.col("asked.item_no").alias("items"), F.col("asked.rest").alias("rests")), "served")

    state_schema = _STATE.format(id=id_type.simpleString())
    state = blocks.withColumn("bundle", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bundles - 1).cast("long")))).select(
        "bundle", "block", "counts", "ids").mapInArrow(_start(n_docs, n_words), state_schema)
    result_schema = f"bundle long, item_no int, doc_id {id_type.simpleString()}, score long"
    for stage in range(owners):
        last = stage == owners - 1
        own = postings.select("block", "term", "slots", "counts").join(served.where(F.col("owner") == stage), "term").select(
            "bundle", "block", "weight", "items", "rests", "slots", "counts")
        state = state.groupBy("bundle", "block").cogroup(own.groupBy("bundle", "block")).applyInArrow(
            _owner(top, last), result_schema if last else state_schema)
    place = Window.partitionBy("bundle", "item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = state.where("score > 0").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return ranked.join(numbered, ["bundle", "item_no"]).select("item_id", "rank", "doc_id", "score")
