"""Close vectors by counted collisions of one-dimensional projections.

Vectors are projected on many random directions. Sorted into cells of a few
projections at a time, vectors of a cell meet; for a pair that meets, the
projections in which one lies in a window around the other are counted, and
pairs that reach the count which a close pair misses with small probability are
verified by their cosine.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from . import kernels as K
from .linked import block_pairs, classes
from .ngram_join import first_shared, matrix

THRESHOLD = 0.98
RECALL = 0.995
BLOCK_ROWS = 512
# In units of the distance of a pair at the threshold: a cell's width, half a window.
CELL = 4.0
WINDOW = 1.5
# Members of a group that may meet in a cell by chance.
MET = 64
# Projections that are counted at least, however few the cells need.
COUNTED = 32


def _normal(z: float) -> float:
    """Share of a normal variable within z of its mean."""
    return math.erf(z / math.sqrt(2))


@dataclass(frozen=True)
class Plan:
    """Projections a table, tables, window and the collisions asked for."""

    threshold: float
    depth: int
    tables: int
    distance: float
    counted: int
    collisions: int

    @staticmethod
    def of(threshold: float, recall: float, largest: int) -> Plan:
        """Depth from the largest group, so that chance meetings stay few; tables and count from the recall.

        On Gaussian directions, a pair at the threshold differs by a normal
        variable of its distance; unrelated unit vectors are normal themselves.
        """
        distance = math.sqrt(max(2 - 2 * threshold, 1e-12))
        by_chance = min(0.9, CELL * distance / (2 * math.sqrt(math.pi)))
        same_cell = 1 - math.sqrt(2 / math.pi) / CELL
        depth = max(1, min(16, round(math.log(max(largest, 1) / MET) / -math.log(by_chance)) if largest > MET else 1))
        tables = math.ceil(math.log(1 - recall) / math.log1p(-(same_cell**depth)))
        total, hit = max(COUNTED, depth * tables), _normal(WINDOW)
        chances = [math.comb(total, k) * hit**k * (1 - hit) ** (total - k) for k in range(total + 1)]
        missed, collisions = 0.0, 0
        while missed + chances[collisions] <= (1 - recall) / 50:
            missed += chances[collisions]
            collisions += 1
        return Plan(threshold, depth, tables, distance, total, collisions)

    def directions(self, size: int) -> np.ndarray:
        return np.random.default_rng([11, size]).standard_normal((size, self.counted))

    def cells(self, projected: np.ndarray, groups: np.ndarray) -> np.ndarray:
        width = CELL * self.distance
        shift = np.random.default_rng(13).random(projected.shape[1]) * width
        number = np.floor((projected + shift) / width).astype(np.int64).view(np.uint64)
        out = np.empty((len(projected), self.tables), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for table in range(self.tables):
                value = K.mixed(groups.view(np.uint64) + np.uint64(table + 1))
                for column in range(table * self.depth, (table + 1) * self.depth):
                    value = K.mixed(value ^ number[:, column]) + np.uint64(1)
                out[:, table] = value
        return out.view(np.int64)


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each row as doubles; null for a row that is null, empty, zero or holds a null or non-finite component."""
    rows: list[np.ndarray | None] = []
    for value in column:
        values = value.values if value.is_valid else None
        own = None if values is None or not len(values) or values.null_count else values.to_numpy(zero_copy_only=False).astype(np.float64)
        rows.append(own if own is not None and np.isfinite(own).all() and np.any(own) else None)
    return rows


def _place(plan: Plan) -> K.Kernel:
    """Signature and cells of each vector; both null for a vector that links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _vectors(batch.column(2))
            group = batch.column(1)
            grouped = group.fill_null(0).to_numpy()
            signs: list[bytes | None] = [None] * len(rows)
            cells: list[np.ndarray | None] = [None] * len(rows)
            usable = [i for i, r in enumerate(rows) if r is not None and group[i].is_valid]
            for size in {len(rows[i]) for i in usable}:
                own = [i for i in usable if len(rows[i]) == size]
                values = np.stack([rows[i] for i in own])
                unit = values / np.linalg.norm(values / np.abs(values).max(axis=1)[:, None], axis=1)[:, None]
                unit /= np.abs(values).max(axis=1)[:, None]
                for i, at in zip(own, plan.cells(unit @ plan.directions(size), grouped[own])):
                    signs[i] = hashlib.blake2b(rows[i].tobytes() + grouped[i].tobytes(), digest_size=16).digest()
                    cells[i] = at
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(signs, pa.binary()), pa.array(cells, pa.list_(pa.int64()))],
                ["vec_id", "embedding", "sig", "cells"])

    return run


def _link(plan: Plan) -> K.Kernel:
    """Links of a block pair: per member its linked rows, and the smallest member of its connected part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in K.groups(batches, ["bucket", "lo", "hi"]):
            if group.num_rows < 2:
                continue
            lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
            sides = (group.column("block").to_numpy() != lo).astype(np.int8)
            bucket = group.column("bucket")[0].as_py()
            a, b = first_shared(matrix(group.column("cells"), plan.tables), sides, bucket, lo != hi)
            if len(a) == 0:
                continue
            size = len(group.column("embedding")[0])
            values = matrix(group.column("embedding"), size).astype(np.float64)
            values /= np.abs(values).max(axis=1)[:, None]
            norms = np.linalg.norm(values, axis=1)
            projected = (values / norms[:, None]) @ plan.directions(size)
            met = np.zeros(len(a), dtype=np.int32)
            for column in projected.T:
                met += np.abs(column[a] - column[b]) <= WINDOW * plan.distance
            a, b = a[met >= plan.collisions], b[met >= plan.collisions]
            cosine = np.einsum("ij,ij->i", values[a], values[b]) / (norms[a] * norms[b])
            a, b = a[cosine >= plan.threshold], b[cosine >= plan.threshold]
            if len(a) == 0:
                continue
            copies, own = group.column("copies").to_numpy(), group.column("sig").to_pylist()
            count = np.zeros(len(own), dtype=np.int64)
            np.add.at(count, a, copies[b])
            np.add.at(count, b, copies[a])
            root, linked = K.local_roots(len(own), a, b), np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array([own[i] for i in linked], pa.binary()), pa.array([own[root[i]] for i in linked], pa.binary()),
                 pa.array(count[linked], pa.int64())], ["sig", "root", "links"])

    return run


def close_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``.

    Vectors of one label and length are compared; those with cosine
    ``threshold`` or more are linked. ``n_links`` counts the other rows linked
    to a row, ``component_id`` is the smallest id it reaches, itself included,
    and ``kept`` marks the row with that id. Vectors that are null, empty, zero,
    or hold a null or non-finite component, and those without a label, link
    with nothing. Equal vectors are linked to all that one of them is linked to,
    without being compared. Null ids take part, are no component's id unless it
    has none else, and are not kept. Other columns are not looked at. No rows:
    none.

    A pair at the threshold is found with probability ``recall`` (closer ones
    with more); every link returned has been verified. Depth and number of
    tables follow the largest group of a label.
    """
    rows = vectors.select("vec_id", F.when(F.col("label").isNotNull(), F.xxhash64("label", F.size("embedding"))).alias("grp"),
                          "embedding")
    largest = rows.where("grp is not null").groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    plan = Plan.of(threshold, recall, largest)
    kind = vectors.schema["embedding"].dataType.simpleString()
    placed = materialised(rows.mapInArrow(
        _place(plan), f"vec_id long, embedding {kind}, sig binary, cells array<long>"), "placed")
    members = placed.where("sig is not null").groupBy("sig").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("id"), F.first("cells").alias("cells"),
        F.first("embedding").alias("embedding"))
    members = materialised(members, "vectors")
    cells = members.select("sig", F.explode("cells").alias("bucket"))
    shared = materialised(cells.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    keys = ["bucket", "lo", "hi"]
    met = block_pairs(cells.join(shared, "bucket"), ["bucket"], F.col("n"), "sig", block_rows).select(*keys, "block", "sig")
    met = met.join(members.select("sig", "copies", "cells", "embedding"), "sig")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = met.select(*keys, "block", "sig", "copies", "cells", "embedding").repartition(
        parts, *keys).sortWithinPartitions(*keys).mapInArrow(_link(plan), "sig binary, root binary, links long")
    result = materialised(classes(members.select("sig", "copies", "id"), materialised(links, "links")), "result")
    own = F.when(F.col("sig").isNull(), F.col("vec_id")).otherwise(F.col("lowest"))
    return placed.select("vec_id", "sig").join(result, "sig", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
