"""Connected components of an edge table, and blocks that split hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: every node of ``edges(a, b)`` with the smallest node it reaches.

    Stars are grown and flattened in turn: each node points all larger
    neighbours to its smallest one, then all smaller ones. A round is written
    to the shared folder, so its lineage is short and survives lost executors;
    the driver sees a count and a checksum per round. A hub's rows are combined
    before the shuffle or split by the skew join, which needs both of its sides
    read from tables, not grouped in the same stage. No edges: no rows.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialised(edges, "edges")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialised(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        grown = materialised(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                             .where("a != b").distinct(), "grown")
        low = materialised(grown.groupBy("a").agg(F.min("b").alias("m")), "least")
        flat = (grown.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                .unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct())
        edges = materialised(flat, "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def block_pairs(members: DataFrame, key: list[str], size: Column, member: str, rows: int) -> DataFrame:
    """Each member once per pair of blocks it takes part in: ``lo, hi`` and its own ``block``.

    A group of ``size`` members is dealt into blocks of about ``rows``; any two
    members meet in exactly one pair of blocks, so a large group becomes many
    small tasks instead of one.
    """
    blocks = F.ceil(size / rows).cast("int")
    dealt = members.withColumn("_n", blocks).withColumn(
        "block", F.pmod(F.xxhash64(F.col(member), *key), F.col("_n")).cast("int"))
    return (dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
            .withColumn("lo", F.least("block", "_o")).withColumn("hi", F.greatest("block", "_o")).drop("_n", "_o"))


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """``sig, root, lowest, n_links`` of ``members(sig, copies, id)`` and ``links(sig, root, links)``.

    ``links`` may name a member several times; its counts add up. ``lowest`` is
    the smallest id of the connected part (null only if it has none), and
    ``n_links`` counts a member's other copies and what it is linked to.
    """
    counts = materialised(links.groupBy("sig").agg(F.sum("links").alias("links")), "counts")
    parts = components(links.select(F.col("sig").alias("a"), F.col("root").alias("b")))
    placed = members.join(parts.withColumnRenamed("node", "sig"), "sig", "left").join(counts, "sig", "left").select(
        "sig", "copies", "id", F.coalesce("root", "sig").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    # Written, so that a large part's rows are split in the joins.
    placed = materialised(placed, "parts")
    lowest = materialised(placed.groupBy("root").agg(F.min("id").alias("lowest")), "lowest")
    return placed.join(lowest, "root").select(
        "sig", "root", "lowest", (F.col("copies") - 1 + F.col("links")).alias("n_links"))
