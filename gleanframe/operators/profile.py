"""Column profiles: shape, gaps, statistics, frequent values, correlations, quality.

Statistics of all columns come from one aggregate per pass instead of one job
per column, and every pass returns one row. Per-value counts run over all
columns together, one ``(column, value)`` pair per distinct value, combined on
the map side before the shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.numeric import (
    adjusted_skewness,
    bracketing,
    numeric_columns,
    present,
    quantiles,
    quoted,
    string_columns,
)
from ..functions.patterns import SEMANTIC_NAMES

# Columns of a block of products, and the share of a sum of squares below which its spread is rounding.
GRAM_BLOCK = 64
CONSTANT = 1e-13


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def one_row(df: DataFrame, aggregates: Sequence[Column]) -> list:
    """The values of one global aggregate, in order."""
    if not aggregates:
        return []
    return list(df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggregates)]).first())


def shape(df: DataFrame) -> DataFrame:
    """``rows, columns``."""
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


def dtypes(df: DataFrame) -> DataFrame:
    """``position, column, dtype`` of every column."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return small_table(df.sparkSession, rows, "position long, column string, dtype string")


def missing(df: DataFrame) -> DataFrame:
    """``column, count, percent`` of null or NaN values, in one pass."""
    aggregates = [F.struct(
        F.lit(c).alias("column"),
        (F.count("*") - F.count(present(df, c))).alias("count"),
    ) for c in df.columns]
    return df.agg(F.count("*").alias("rows"), F.array(*aggregates).alias("m")).select(
        F.col("rows"), F.inline("m")
    ).select(
        "column", "count", F.round(F.try_divide(F.col("count"), F.col("rows")) * 100, 2).alias("percent")
    )


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, median, deviation, range, quartiles, skewness and outliers per column.

    Rounded to four digits; columns without any value have no row. Quartiles
    interpolate, and an outlier lies strictly more than 1.5 interquartile
    ranges outside them.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    values = {c: present(df, c).cast("double") for c in names}
    probs = [0.25, 0.5, 0.75]
    stats = one_row(df, [x for c in names for x in (
        F.count(values[c]), F.avg(values[c]), F.stddev_samp(values[c]), F.min(values[c]), F.max(values[c]),
        adjusted_skewness(values[c]), bracketing(values[c], probs),
    )])
    by_name = {c: stats[7 * i: 7 * i + 6] for i, c in enumerate(names) if stats[7 * i]}
    quartiles = quantiles(df, list(by_name), probs, sizes={c: s[0] for c, s in by_name.items()},
                          brackets={c: stats[7 * i + 6] for i, c in enumerate(names)})
    outside = iqr_counts(df, quartiles)
    rows = [
        (c, mean, quartiles[c][1], std, low, high, quartiles[c][0], quartiles[c][2], skew, outside[c])
        for c, (_, mean, std, low, high, skew) in by_name.items()
    ]
    table = small_table(
        df.sparkSession, rows,
        "column string, mean double, median double, std double, min double, max double, q25 double, q75 double, "
        "skewness double, outliers_iqr long",
    )
    return table.select(
        "column", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std", "min", "max", "q25", "q75", "skewness")],
        "outliers_iqr",
    )


def fences(quartiles: Sequence[float]) -> tuple[float, float]:
    q1, q3 = quartiles[0], quartiles[-1]
    return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)


def iqr_counts(df: DataFrame, quartiles: dict[str, list[float]]) -> dict[str, int]:
    limits = {c: fences(q) for c, q in quartiles.items()}
    counts = one_row(df, [
        F.count_if((present(df, c) < low) | (present(df, c) > high)) for c, (low, high) in limits.items()
    ])
    return dict(zip(limits, counts))


def outliers_iqr(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, outliers_iqr`` of every numeric column that holds a value."""
    names = list(columns) if columns is not None else numeric_columns(df)
    values = {c: present(df, c).cast("double") for c in names}
    found = one_row(df, [x for c in names for x in (F.count(values[c]), bracketing(values[c], [0.25, 0.75]))])
    sizes, brackets = dict(zip(names, found[::2])), dict(zip(names, found[1::2]))
    quartiles = {c: q for c, q in quantiles(df, names, [0.25, 0.75], sizes=sizes, brackets=brackets).items() if q[0] is not None}
    counts = iqr_counts(df, quartiles)
    return small_table(df.sparkSession, list(counts.items()), "column string, outliers_iqr long")


def value_counts_by_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, count`` of the non-null values of several string columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).alias("value")) for c in columns])
    return (
        df.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("count"))
    )


def categorical_stats(df: DataFrame, top_n: int = 5, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, unique_count, rank, value, count`` of the most frequent values.

    Ties go to the smaller value; rank 1 is the most frequent one. The rank
    filter is applied before the shuffle too, so a column sends no more than
    ``top_n`` values per task to its window.
    """
    names = list(columns) if columns is not None else string_columns(df)
    if not names:
        return small_table(
            df.sparkSession, [], "column string, unique_count long, rank long, value string, count long")
    counts = value_counts_by_column(df, names)
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    unique = counts.groupBy("column").agg(F.count("*").alias("unique_count"))
    return top.join(unique, "column").select(
        "column", "unique_count", F.col("rank").cast("long").alias("rank"), "value", "count"
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Exact distinct non-null values of string columns, in one job."""
    if not columns:
        return {}
    counted = value_counts_by_column(df, columns).groupBy("column").agg(F.count("*").alias("n")).collect()
    found = {row["column"]: row["n"] for row in counted}
    return {c: found.get(c, 0) for c in columns}


def sample_rows(df: DataFrame, order_by: Sequence[str], n: int = 3) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def value_counts(df: DataFrame, column: str, top_n: int = 15) -> DataFrame:
    """``column, count`` of the most frequent values, ties by value."""
    return (
        df.where(F.col(quoted(column)).isNotNull())
        .groupBy(F.col(quoted(column)))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.col(quoted(column)))
        .limit(top_n)
    )


def semantic_types(df: DataFrame) -> DataFrame:
    """``column, semantic_type``: by name, else numeric or categorical by data type."""
    rows = []
    for field in df.schema.fields:
        kind = next((k for k, pattern in SEMANTIC_NAMES if re.search(pattern, field.name.lower())), None)
        if kind is None:
            kind = "numeric" if isinstance(field.dataType, T.NumericType) else "categorical"
        rows.append((field.name, kind))
    return small_table(df.sparkSession, rows, "column string, semantic_type string")


def _gram(centres: list[float]):
    """A task's sums over the rows that have both values of each pair of columns, by blocks of columns."""
    n = len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, ones, squares, products = (np.zeros((n, n)) for _ in range(4))
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - np.array(centres)
            there = ~np.isnan(values)
            values = np.where(there, values, 0.0)
            there = there.astype(float)
            for a in range(0, n, GRAM_BLOCK):
                left = slice(a, a + GRAM_BLOCK)
                count[left] += there[:, left].T @ there
                ones[left] += values[:, left].T @ there
                squares[left] += (values[:, left] ** 2).T @ there
                products[left] += values[:, left].T @ values
        i, j = np.triu_indices(n, 1)
        columns = [i, j, count[i, j], ones[i, j], ones[j, i], squares[i, j], squares[j, i], products[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    return run


def _pairs(df: DataFrame, names: Sequence[str], stats: dict[str, list]) -> DataFrame:
    """``i, j, r``: Pearson correlations of the columns, null on a constant; one scan whatever the number of pairs.

    Each task adds up the products of its rows, less the columns' means; pairs with gaps count the rows
    that have both values. What is summed is one row a task and pair.
    """
    values = df.select(*[present(df, c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    sums = values.mapInArrow(
        _gram([stats[c][1] or 0.0 for c in names]), "i long, j long, n double, x double, y double, xx double, yy double, xy double"
    ).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])

    def spread(square: str, one: str) -> Column:
        found = F.col(square) - F.col(one) * F.col(one) / F.col("n")
        return F.when(found > F.col(square) * CONSTANT, found)

    r = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(spread("xx", "x")) / F.sqrt(spread("yy", "y"))
    return sums.where("n > 0").select("i", "j", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("r"))


def _varied(df: DataFrame) -> tuple[list[str], dict[str, list]]:
    """Numeric columns with their count, mean, least and largest value."""
    names = numeric_columns(df)
    found = one_row(df, [x for c in names for v in [present(df, c).cast("double")] for x in (F.count(v), F.avg(v), F.min(v), F.max(v))])
    return names, {c: found[4 * i: 4 * i + 4] for i, c in enumerate(names)}


def _named_pairs(df: DataFrame, names: list[str], stats: dict[str, list]) -> DataFrame:
    """``col1, col2, r`` of every pair; null where a column is constant."""
    columns = F.array(*[F.lit(c) for c in names])
    moves = F.array(*[F.lit(bool(s[0]) and s[2] < s[3]) for s in stats.values()])
    at = lambda x, i: F.element_at(x, F.col(i).cast("int") + 1)
    return _pairs(df, names, stats).select(
        at(columns, "i").alias("col1"), at(columns, "j").alias("col2"), F.when(at(moves, "i") & at(moves, "j"), F.col("r")).alias("r"))


def correlation_pairs(df: DataFrame) -> DataFrame:
    """``col1, col2, correlation, strength, direction``, strongest first."""
    names, stats = _varied(df)
    if len(names) < 2:
        return small_table(df.sparkSession, [], "col1 string, col2 string, correlation double, strength string, direction string")
    r = F.col("r")
    return (
        _named_pairs(df, names, stats).where(r.isNotNull())
        .select(
            "col1", "col2", F.round(r, 4).alias("correlation"),
            F.when(F.abs(r) >= 0.7, "strong").when(F.abs(r) >= 0.4, "moderate").otherwise("weak").alias("strength"),
            F.when(r > 0, "positive").otherwise("negative").alias("direction"),
        )
        .orderBy(F.desc(F.abs("correlation")), "col1", "col2")
    )


def correlation_matrix(df: DataFrame) -> DataFrame:
    """``col1, col2, correlation`` of all ordered pairs, the diagonal included."""
    names, stats = _varied(df)
    if len(names) < 2:
        return small_table(df.sparkSession, [], "col1 string, col2 string, correlation double")
    same = small_table(df.sparkSession, [(c, c, 1.0 if s[0] and s[2] < s[3] else None) for c, s in stats.items()],
                       "col1 string, col2 string, correlation double")
    every = small_table(df.sparkSession, [(a, b) for i, a in enumerate(names) for b in names[i + 1:]], "col1 string, col2 string")
    found = every.join(_named_pairs(df, names, stats), ["col1", "col2"], "left")
    sides = F.array(F.struct("col1", "col2"), F.struct(F.col("col2").alias("col1"), F.col("col1").alias("col2")))
    return same.unionByName(found.select(F.col("r").alias("correlation"), F.inline(sides)))


def count_duplicates(df: DataFrame) -> DataFrame:
    """``rows, duplicates``: rows beyond the first of equal rows, nulls equal."""
    copies = df.groupBy(*[F.col(quoted(c)) for c in df.columns]).agg(F.count("*").alias("__copies"))
    return copies.agg(
        F.coalesce(F.sum("__copies"), F.lit(0)).cast("long").alias("rows"),
        F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).cast("long").alias("duplicates"),
    )


def quality_score(df: DataFrame) -> DataFrame:
    """``score``: 100 less up to 40 for gaps and up to 30 for duplicate rows, cut to an integer.

    Only the duplicate count needs a shuffle; the gaps come from one aggregate.
    """
    gaps = missing(df).agg(F.avg("percent").alias("gap"))
    duplicates = count_duplicates(df)
    parts = gaps.select(F.col("gap"), F.lit(None).cast("double").alias("dup")).unionByName(
        duplicates.select(
            F.lit(None).cast("double").alias("gap"),
            (F.col("duplicates") / F.greatest("rows", F.lit(1)) * 100).alias("dup"),
        )
    ).agg(F.max("gap").alias("gap"), F.max("dup").alias("dup"))
    score = 100 - F.least(F.lit(40.0), F.coalesce("gap", F.lit(0.0)) * 1.5) - F.least(F.lit(30.0), F.col("dup"))
    return parts.select(F.greatest(F.lit(0), F.floor(score)).cast("long").alias("score"))


def quick_stats(df: DataFrame) -> DataFrame:
    """One row of totals, and ``<column>_mean`` of the first three numeric columns."""
    numeric = numeric_columns(df)
    shown = numeric[:3]
    values = one_row(
        df,
        [F.count("*"), *[F.count(present(df, c)) for c in df.columns], *[F.avg(present(df, c).cast("double")) for c in shown]],
    )
    rows, filled, means = values[0], values[1: 1 + len(df.columns)], values[1 + len(df.columns):]
    cells = max(rows * len(df.columns), 1)
    return count_duplicates(df).select(
        "rows",
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.lit(len(numeric)).cast("long").alias("numeric_cols"),
        F.lit(len(string_columns(df))).cast("long").alias("text_cols"),
        F.round(F.lit((rows * len(df.columns) - sum(filled)) / cells * 100), 1).alias("missing_pct"),
        "duplicates",
        *[F.round(F.lit(mean).cast("double"), 2).alias(f"{c}_mean") for c, mean in zip(shown, means)],
    )


def group_sum_topk(
    df: DataFrame, category: str, measures: Sequence[str], k: int, by_total: bool = False
) -> DataFrame:
    """Sums of the measures per category, the ``k`` largest by the first measure or by their total.

    Missing categories are left out, missing values count as zero, ties go to
    the smaller category. Planned as a partial aggregate and a top-k.
    """
    sums = [F.coalesce(F.sum(present(df, m).cast("double")), F.lit(0.0)).alias(m) for m in measures]
    grouped = (
        df.where(F.col(quoted(category)).isNotNull()).groupBy(F.col(quoted(category))).agg(*sums)
    )
    first = F.col(quoted(measures[0]))
    weight = sum((F.col(quoted(m)) for m in measures[1:]), first) if by_total else first
    return grouped.orderBy(weight.desc(), F.col(quoted(category))).limit(k)
