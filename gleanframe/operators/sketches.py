"""Approximate statistics that merge: quantiles, distinct counts and frequent values.

Each part of a table (a day, a file, a task) gives a sketch of bounded size; sketches
of parts are merged without reading the rows again. Every result comes with the error
that its sketch allows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import present, quoted
from ..session import materialised

QUANTILE_K = 800
DISTINCT_LG_K = 14
# Standard deviations that a distinct count's bounds are away from its estimate.
DEVIATIONS = 5
COUNTERS = 10_000


def rank_error(k: int = QUANTILE_K) -> float:
    """Share of the rows by which a quantile's rank may be off (KLL sketches, 99 %)."""
    return 2.296 / k ** 0.9021


def quantile_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: int = QUANTILE_K) -> DataFrame:
    """``by..., column, n, sketch``: a KLL sketch of each column's values, one row a part and column.

    Null and NaN have no part in it; a column without values gives no row.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), present(df, c).cast("double").alias("value")) for c in columns])
    return (df.select(*[F.col(quoted(c)) for c in by], F.inline(pairs)).where(F.col("value").isNotNull())
            .groupBy(*by, "column").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value", k).alias("sketch")))


def merged_quantiles(sketches: DataFrame, probs: Sequence[float], k: int = QUANTILE_K) -> DataFrame:
    """``column, n, prob, value, error`` out of the sketches of any number of parts."""
    merged = sketches.groupBy("column").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    values = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value"))
                       for p in probs])
    return merged.select("column", "n", F.inline(values)).withColumn("error", F.lit(rank_error(k)))


def distinct_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), lg_k: int = DISTINCT_LG_K) -> DataFrame:
    """``by..., column, sketch``: an HLL sketch of each column's values as text, one row a part and column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value")) for c in columns])
    return (df.select(*[F.col(quoted(c)) for c in by], F.inline(pairs)).groupBy(*by, "column")
            .agg(F.hll_sketch_agg("value", lg_k).alias("sketch")))


def distinct_error(lg_k: int = DISTINCT_LG_K) -> float:
    """Relative error allowed for in bounds: ``DEVIATIONS`` standard deviations of a merged sketch."""
    return DEVIATIONS * 1.04 / 2 ** (lg_k / 2)


def distinct_bounds(sketches: DataFrame, lg_k: int = DISTINCT_LG_K) -> DataFrame:
    """``column, low, estimate, high`` of the distinct values over all parts."""
    merged = sketches.groupBy("column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    off = distinct_error(lg_k)
    return merged.select("column", F.floor(F.col("estimate") * (1 - off)).alias("low"), "estimate",
                         F.ceil(F.col("estimate") * (1 + off)).alias("high"))


def _counted(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, missed, kind = None, 0, None
        for batch in batches:
            kind = batch.column(0).type
            own = pa.table({"value": batch.column(0), "count": pa.array(np.ones(batch.num_rows, dtype=np.int64))})
            both = own if held is None else pa.concat_tables([held, own])
            held = both.group_by("value").aggregate([("count", "sum")]).rename_columns(["value", "count"])
            if held.num_rows > 2 * counters:
                counts = held.column("count").to_numpy()
                cut = int(np.partition(counts, -counters - 1)[-counters - 1])
                missed += cut
                left = counts - cut
                held = pa.table({"value": held.column("value"), "count": pa.array(left)}).filter(pa.array(left > 0))
        if held is not None:
            held = held.append_column("missed", pa.array(np.zeros(held.num_rows, dtype=np.int64)))
            end = pa.table({"value": pa.nulls(1, kind), "count": pa.array([0], pa.int64()), "missed": pa.array([missed], pa.int64())})
            for table in (held, end):
                yield from table.combine_chunks().to_batches()

    return run


def frequent_values(df: DataFrame, column: str, top_n: int = 15, counters: int = COUNTERS) -> DataFrame:
    """``column, count``: exactly the ``top_n`` most frequent values, ties by value, as ``value_counts`` gives them.

    Each task keeps a table of at most twice ``counters`` values (Misra-Gries): where it is full,
    all counts are lowered by one amount, which bounds what any value can have lost.
    The tables are added up, so the shuffle carries a bounded number of rows a task whatever the number of distinct
    values. Values that can still be among the top are counted exactly in a second pass.
    If the last of the top is no more frequent than a value outside all tables may be (few or no frequent values),
    no sketch can tell, and all values are counted.
    """
    name = F.col(quoted(column))
    kind = df.schema[column].dataType.simpleString()
    values = df.where(name.isNotNull()).select(name.alias("value"))
    tables = values.mapInArrow(_counted(counters), f"value {kind}, count long, missed long")
    found = materialised(tables.groupBy("value").agg(F.sum("count").alias("least"), F.sum("missed").alias("missed")), "frequent")
    missed = found.where("value IS NULL").agg(F.sum("missed")).first()[0] or 0
    listed = found.where("value IS NOT NULL")
    top = [r[0] for r in listed.orderBy(F.desc("least")).limit(top_n).select("least").collect()]
    if not missed:
        counts = listed.select("value", F.col("least").alias("count"))
    else:
        told = len(top) == top_n and top[-1] > missed
        wanted = values.join(listed.where(F.col("least") + missed >= top[-1]).select("value"), "value", "left_semi") if told else values
        counts = wanted.groupBy("value").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "value").limit(top_n).select(F.col("value").alias(column), "count")
