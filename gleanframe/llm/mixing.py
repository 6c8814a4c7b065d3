"""Sources mixed to target weights by hash-random order and prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .prefix import prefix_sums

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2


def word_count(text: Column) -> Column:
    """Words between whitespace; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   most: int = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, offset, target`` out of ``source, source_size``, one row a source.

    Sources in code point order, null last, take the weights in turn. Targets
    share ``share`` of all words by weight and stop at ``most`` times their
    source; what is left over goes to the others by weight until none is above.
    That fixed point is found at once: with sources sorted by their limit per
    weight, those whose limit is below the level of the rest stop there.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = prefix_sums(sizes, [F.col("source").isNull(), F.col("source")], {"offset": "source_size"}, "sources")
    weighted = ranked.withColumn("w", F.element_at(cycle, (F.col("row_no") % len(weights)).cast("int") + 1)).withColumn(
        "c", F.col("source_size") * most).drop("row_no")
    level = prefix_sums(weighted.withColumn("per", F.col("c") / F.col("w")),
                        [F.col("per"), F.col("source").isNull(), F.col("source")],
                        {"c_before": "c", "w_before": "w"}, "levels")
    words, all_w = sizes.agg(F.sum("source_size")).first()[0] or 0, level.agg(F.sum("w")).first()[0] or 0
    total = share * words
    full = F.col("per") <= (F.lit(total) - F.col("c_before")) / (F.lit(all_w) - F.col("w_before"))
    stopped = level.where(full).agg(F.sum("c"), F.sum("w")).first()
    rest_c, rest_w = stopped[0] or 0, stopped[1] or 0
    rate = (total - rest_c) / (all_w - rest_w) if all_w > rest_w else 0.0
    return level.select("source", "source_size", "offset",
                        F.when(full, F.col("c").cast("double")).otherwise(F.col("w") * F.lit(rate)).alias("target"))


def mix(docs: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", tie: str | None = None,
        weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """``docs`` with ``source_size``, ``target``, ``taken`` and ``copies``.

    Within a source, rows stand in the order of a hash of ``key``; ``tie`` (any
    column) orders rows with equal keys. A source's budget takes whole epochs of
    it and then rows from the front. ``taken`` counts words, with the row at the
    cut taken in part, so a source's words meet its target to a word; ``copies``
    counts whole rows, the row at the cut being in if its middle is before the
    cut. Null sources are one source, null keys come first, rows without words
    take none but are copied like their neighbours. Equal rows may take each
    other's part. No rows give none. Columns of ``docs`` stay, except that the
    four names above replace any of their own.
    """
    plain = docs.drop("source_size", "target", "taken", "copies")
    rows = plain.select(
        F.struct(*[F.col(f"`{c}`") for c in plain.columns]).alias("_row"), F.col(size).cast("long").alias("_size"),
        F.col(source).alias("source"), F.coalesce(F.md5(F.col(key).cast("string").cast("binary")), F.lit("")).alias("_key"),
        (F.col(tie) if tie else F.lit(0)).alias("_tie"))
    placed = prefix_sums(rows, [F.col("source").isNull(), F.col("source"), F.col("_key"), F.col("_tie")],
                         {"_before": "_size"}, "mix")
    sizes = materialised(placed.groupBy("source").agg(F.sum("_size").alias("source_size")), "sizes")
    targets = materialised(source_targets(sizes, weights, share, most), "targets")
    named = targets.select(F.col("source").alias("_source"), "source_size", "offset", "target")
    joined = placed.join(named, placed["source"].eqNullSafe(named["_source"]))
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    left = F.floor(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("long")
    front = F.col("_before") - F.col("offset")
    part = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_left") - front)).cast("long")
    whole = (2 * front + F.col("_size") < 2 * F.col("_left")).cast("long")
    return joined.withColumn("_epochs", epochs).withColumn("_left", left).select(
        "_row.*", "source_size", "target", (F.col("_epochs") * F.col("_size") + part).alias("taken"),
        (F.col("_epochs") + whole).alias("copies"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as ``mix`` copies it, with the columns of ``docs``."""
    counted = mix(docs, **options)
    copies = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    return counted.where("copies > 0").withColumn("_copy", F.explode(copies)).select(*[f"`{c}`" for c in docs.columns])
