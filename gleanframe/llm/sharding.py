"""Contiguous shards of equal bytes, cut by prefix sums of sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import prefix_sums


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 8 for its frame; null has no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shard(docs: DataFrame, shards: int, size: str = "size", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 within it).

    Rows are put in ``order`` (nulls first); a row goes to the shard in which
    the middle of its bytes falls when the total is cut at equal targets. So
    shards are contiguous and each differs from the target by at most one row's
    size. ``size`` must be a positive long. Ties in ``order`` are dealt in input
    order; rows that are equal may then land on either side of a cut. Repeated
    rows are rows of their own. A table without rows gives none. Columns of
    ``docs`` stay, under any name but ``shard``, ``slot`` and names that start
    with ``_p_``; a column ``shard`` or ``slot`` is replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    plain = docs.drop("shard", "slot")
    packed = plain.select(F.struct(*[F.col(f"`{c}`") for c in plain.columns]).alias("_row"),
                          F.col(size).alias("_size"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(order)])
    placed = prefix_sums(packed, [F.col(f"_k{i}") for i in range(len(order))], {"_before": "_size"}, "shards")
    total = placed.agg(F.sum("_size")).first()[0] or 1
    # Decimals: bytes times shards can pass 2^63.
    middle = F.col("_before").cast("decimal(38,0)") * 2 + F.col("_size")
    cut = F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * total)).cast("int"))
    dealt = placed.withColumn("shard", cut)
    # One row a shard.
    firsts = dealt.groupBy("shard").agg(F.min("row_no").alias("_first"))
    return dealt.join(F.broadcast(firsts), "shard").select(
        "_row.*", "shard", (F.col("row_no") - F.col("_first")).alias("slot"))
