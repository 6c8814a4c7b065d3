"""Prefix sums over a global order, from totals of range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised


def prefix_sums(rows: DataFrame, order: list[Column], sums: dict[str, str], purpose: str) -> DataFrame:
    """``rows`` with, for each ``name: column`` of ``sums``, the sum over all rows before, and ``row_no`` from 0.

    Rows are range-partitioned by ``order`` and sorted there; only each
    partition's totals meet, one row a partition. The partitioned table is
    written once, so that a lost task finds the same partitions again. Equal
    rows are dealt by a running number, so many repeats of one row do not fill
    one task. Column names that start with ``_p_`` are taken.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = rows.withColumn("_p_tie", F.monotonically_increasing_id())
    keyed = numbered.select("*", *[c.alias(f"_p_o{i}") for i, c in enumerate(order)])
    keys = [f"_p_o{i}" for i in range(len(order))] + ["_p_tie"]
    placed = keyed.repartitionByRange(parts, *keys).withColumn("_p_part", F.spark_partition_id())
    placed = materialised(placed, purpose)
    totals = placed.groupBy("_p_part").agg(
        F.count("*").alias("_p_n"), *[F.sum(c).alias(f"_p_t_{n}") for n, c in sums.items()])
    # One row a partition.
    earlier = Window.orderBy("_p_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p_part", F.coalesce(F.sum("_p_n").over(earlier), F.lit(0)).alias("_p_n"), *[
        F.coalesce(F.sum(f"_p_t_{n}").over(earlier), F.lit(0)).alias(f"_p_t_{n}") for n in sums])
    within = Window.partitionBy("_p_part").orderBy(*keys)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("*", (F.row_number().over(within) - 1).alias("_p_i"), *[
        F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_p_b_{n}") for n, c in sums.items()
    ]).join(F.broadcast(offsets), "_p_part").select(
        *[F.col(c) for c in rows.columns], (F.col("_p_n") + F.col("_p_i")).cast("long").alias("row_no"),
        *[(F.col(f"_p_t_{n}") + F.col(f"_p_b_{n}")).cast("long").alias(n) for n in sums])
