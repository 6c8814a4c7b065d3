"""Documents joined on the Jaccard similarity of their word n-grams, by MinHash banding.

Texts with equal n-gram sets are one class member from the start, so exact
copies are never compared. The other texts meet in buckets of equal band
hashes; a pair is verified on its full n-gram sets in the bucket of the first
band it shares. Buckets are dealt in pairs of blocks, and a task gives counts
and a spanning forest for its block pair, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from . import kernels as K
from .linked import block_pairs, classes

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
HASHES = 128
BLOCK_ROWS = 256


def banding(threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows a band: the longest bands that find a pair at ``threshold`` with ``recall`` within ``hashes``."""
    for rows in range(hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("no banding reaches the recall; allow more hashes")


def ngram_sets(hashes: np.ndarray, firsts: np.ndarray, width: int, hasher: K.Hasher) -> list[np.ndarray]:
    """Each row's distinct n-grams, sorted; a row of fewer words is one gram; a row without words has none."""
    starts = K.window_starts(firsts, width)
    grams = hasher.runs(hashes, starts, starts + width)
    at = np.searchsorted(starts, firsts)
    sets = []
    for row in range(len(firsts) - 1):
        if at[row + 1] > at[row]:
            sets.append(np.unique(grams[at[row] : at[row + 1]]))
        elif firsts[row + 1] > firsts[row]:
            sets.append(hasher.runs(hashes, firsts[row : row + 1], firsts[row + 1 : row + 2]))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factors = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.terms = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def bands_of(self, sets: list[np.ndarray]) -> np.ndarray:
        """Band hashes, one row a set; all sets must have members."""
        values = np.concatenate(sets)
        starts = np.zeros(len(sets), dtype=np.int64)
        np.cumsum([len(s) for s in sets[:-1]], out=starts[1:])
        out = np.empty((len(sets), self.bands), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for band in range(self.bands):
                value = np.full(len(sets), band + 1, dtype=np.uint64)
                for row in range(self.rows):
                    j = band * self.rows + row
                    low = np.minimum.reduceat(values * self.factors[j] + self.terms[j], starts)
                    value = K.mixed(value ^ low)
                out[:, band] = value
        return out


def _prepare(width: int, bands: int, rows: int, keep_sets: bool) -> K.Kernel:
    """Signature of the n-gram set and band hashes of each text, and the set itself if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, minhash, table = K.Hasher(), MinHash(bands, rows), K.spaced_words()
        for batch in batches:
            for first, last, data, offsets in K.text_slices(batch.column(batch.schema.get_field_index("text"))):
                hashes, _, _, firsts = hasher.words(data, offsets, table)
                sets = ngram_sets(hashes, firsts, width, hasher)
                full = [i for i, s in enumerate(sets) if len(s)]
                signs: list[bytes | None] = [None] * len(sets)
                banded: list[np.ndarray | None] = [None] * len(sets)
                if full:
                    for i, own in zip(full, minhash.bands_of([sets[i] for i in full])):
                        signs[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        banded[i] = own.view(np.int64)
                rest = batch.slice(first, last - first)
                columns = [rest.column(i) for i, f in enumerate(rest.schema) if f.name != "text"]
                names = [f.name for f in rest.schema if f.name != "text"]
                columns += [pa.array(signs, pa.binary()), pa.array(banded, pa.list_(pa.int64()))]
                if keep_sets:
                    columns.append(pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, [*names, "sig", "bands", *(["grams"] if keep_sets else [])])

    return run


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, width)


def first_shared(bands: np.ndarray, sides: np.ndarray, bucket: int, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the block pair whose first shared band is this bucket."""
    left = np.flatnonzero(sides == 0) if cross else np.arange(len(bands))
    right = np.flatnonzero(sides == 1) if cross else left
    met = np.zeros((len(left), len(right)), dtype=bool)
    here = np.zeros((len(left), len(right)), dtype=bool)
    for band in range(bands.shape[1]):
        equal = bands[left, band][:, None] == bands[right, band]
        # Only pairs that shared no earlier band are met here for the first time.
        if (bands[left, band] == bucket).any():
            here |= equal & ~met & (bands[left, band] == bucket)[:, None]
        met |= equal
    if not cross:
        here = np.triu(here, 1)
    a, b = np.nonzero(here)
    return left[a], right[b]


def _needed(width: int) -> K.Kernel:
    """Members of a block pair that meet someone there for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.Table] = []
        for group in K.groups(batches, ["bucket", "lo", "hi"]):
            if group.num_rows < 2:
                continue
            lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
            sides = (group.column("block").to_numpy() != lo).astype(np.int8)
            a, b = first_shared(matrix(group.column("bands"), width), sides, group.column("bucket")[0].as_py(), lo != hi)
            if len(a):
                out.append(group.take(pa.array(np.union1d(a, b))).drop_columns(["bands"]))
            if sum(t.num_rows for t in out[-64:]) > 4096 or len(out) >= 512:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out = []
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return run


def shared_grams(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Size of the intersection of each pair (a[i], b[i])."""
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], dtype=np.int64)
    # Many pairs of few sets: counted by a matrix product over the grams that two sets have.
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[gram] > 1
    fresh = np.cumsum(count > 1) - 1
    owner, gram = owner[keep], fresh[gram[keep]]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for first in range(0, int(gram[-1]) + 1 if len(gram) else 0, columns):
        x, y = np.searchsorted(gram, [first, first + columns])
        dense = np.zeros((len(sets), columns), dtype=np.float32)
        dense[owner[x:y], gram[x:y] - first] = 1
        total += dense @ dense.T
    return total[a, b].astype(np.int64)


def _verify(width: int, threshold: float) -> K.Kernel:
    """Links of a block pair: per member its linked rows, and the smallest member of its connected part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, roots, links = [], [], []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(signs, pa.binary()), pa.array(roots, pa.binary()), pa.array(links, pa.int64())],
                ["sig", "root", "links"])
            signs.clear(), roots.clear(), links.clear()
            return batch

        for group in K.groups(batches, ["bucket", "lo", "hi"]):
            lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
            sides = (group.column("block").to_numpy() != lo).astype(np.int8)
            a, b = first_shared(matrix(group.column("bands"), width), sides, group.column("bucket")[0].as_py(), lo != hi)
            own = group.column("sig").to_pylist()
            copies = group.column("copies").to_numpy()
            lists = group.column("grams").combine_chunks()
            flat, cuts = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()
            cuts = cuts - cuts[0]
            sets = [flat[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
            sizes = np.diff(cuts)
            # Sizes alone rule many pairs out.
            possible = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9
            a, b = a[possible], b[possible]
            if len(a) == 0:
                continue
            common = shared_grams(sets, a, b)
            near = common >= threshold * (sizes[a] + sizes[b] - common) - 1e-9
            a, b = a[near], b[near]
            if len(a) == 0:
                continue
            count = np.zeros(len(own), dtype=np.int64)
            np.add.at(count, a, copies[b])
            np.add.at(count, b, copies[a])
            root = K.local_roots(len(own), a, b)
            for i in np.flatnonzero(count):
                signs.append(own[i])
                roots.append(own[root[i]])
                links.append(int(count[i]))
            if len(signs) > 4096:
                yield flush()
        if signs:
            yield flush()

    return run


def near_classes(docs: DataFrame, width: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL,
                 hashes: int = HASHES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, k1, k2, class_id, n_links``, one row a row of ``docs(doc_id, text)``.

    Words are runs between whitespace, unchanged; the n-grams are sets of
    ``width`` words, a shorter text being one gram. Two documents are linked if
    their sets' Jaccard similarity is ``threshold`` or more. ``n_links`` counts
    the other rows linked to a row, copies included; ``class_id`` is the
    smallest id a row reaches by links. ``k1, k2`` are hashes of the text. A
    text that is null or without words links with nothing. Null ids take part
    and count, and are no class id unless a class has none else. Repeated rows
    are copies of each other. Other columns are not looked at. No rows: none.

    Bands are as long as ``recall`` at the threshold allows within ``hashes``;
    what is found is verified, so no pair below the threshold is linked.
    """
    bands, rows = banding(threshold, recall, hashes)
    texts = docs.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    signed = materialised(texts.mapInArrow(
        _prepare(width, bands, rows, False), "doc_id long, k1 long, k2 long, sig binary, bands array<long>"), "signed")

    members = signed.where("sig is not null").groupBy("sig").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "k1")).alias("text_at"),
        F.first("bands").alias("bands"))
    members = materialised(members, "members")
    buckets = members.select("sig", F.explode("bands").alias("bucket"))
    shared = materialised(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    placed = block_pairs(buckets.join(shared, "bucket"), ["bucket"], F.col("n"), "sig", block_rows).select(
        "bucket", "lo", "hi", "block", "sig")
    keys = ["bucket", "lo", "hi"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = placed.join(members.select("sig", "bands"), "sig").repartition(parts, *keys).sortWithinPartitions(*keys)
    needed = materialised(met.select(*keys, "block", "sig", "bands").mapInArrow(
        _needed(bands), "bucket long, lo int, hi int, block int, sig binary"), "needed")

    wanted = needed.select("sig").distinct().join(members, "sig")
    found_at = wanted.select(F.col("text_at.doc_id").alias("_doc"), F.col("text_at.k1").alias("_k1"))
    sources = texts.join(found_at, texts["doc_id"].eqNullSafe(found_at["_doc"]) & (texts["k1"] == found_at["_k1"]))
    grams = sources.select("text").mapInArrow(
        _prepare(width, bands, rows, True), "sig binary, bands array<long>, grams array<long>")
    grams = grams.where("sig is not null").groupBy("sig").agg(F.first("bands").alias("bands"), F.first("grams").alias("grams"))
    grams = grams.join(wanted.select("sig", "copies"), "sig")
    verified = needed.join(grams, "sig").repartition(parts, *keys).sortWithinPartitions(*keys).select(
        *keys, "block", "sig", "copies", "bands", "grams").mapInArrow(
        _verify(bands, threshold), "sig binary, root binary, links long")
    verified = materialised(verified, "links")

    result = classes(members.select("sig", "copies", F.col("doc_id").alias("id")), verified).withColumnRenamed("lowest", "class_id")
    result = materialised(result, "result")
    ids = signed.select("doc_id", "k1", "k2", "sig")
    return ids.join(result, "sig", "left").select(
        "doc_id", "k1", "k2", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("sig").isNotNull().alias("_compared"),
        F.hex("root").alias("_class"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id.

    Of rows that repeat its id and text one stays. Documents without words all
    stay. A class without any id keeps one row. All columns of ``docs`` stay.
    """
    marked = near_classes(docs.select("doc_id", "text"), **options)
    # An id of two different texts of one class stays with one of them.
    one = marked.where("_compared and doc_id <=> class_id").groupBy("_class").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("k")).select(
        F.col("k.doc_id").alias("_doc"), F.col("k.k1").alias("_k1"), F.col("k.k2").alias("_k2"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id",
                        F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    wordless = docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    stays = keyed.join(one, keyed["doc_id"].eqNullSafe(one["_doc"]) & (keyed["k1"] == one["_k1"]) & (keyed["k2"] == one["_k2"]),
                       "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
    return stays.select("_row.*").unionByName(wordless)
