"""Duplicate removal, duplicate reports and table fingerprints.

The surviving row of a key is chosen by an aggregate that is combined on the
map side, not by a window: a key that holds a third of all rows then sends one
candidate per task instead of all its rows to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import quoted
from ..functions.text import value_text


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return _holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_holds_map(f.dataType) for f in dtype.fields)
    return False


def comparable(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """The columns in a form that can be grouped and ordered; maps as sorted entries."""
    columns = []
    for name in names:
        col, dtype = F.col(quoted(name)), df.schema[name].dataType
        if isinstance(dtype, T.MapType) and not _holds_map(dtype.valueType):
            col = F.array_sort(F.map_entries(col))
        elif _holds_map(dtype):
            col = F.to_json(col)
        columns.append(col)
    return columns


def _first_rows(df: DataFrame, group: Sequence[Column], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    # All columns break ties, so that a task run again picks the same row.
    rank = F.struct(*order, *comparable(df, df.columns))
    row = F.struct(*[F.col(quoted(c)) for c in keep])
    grouped = df.groupBy(*[g.alias(f"__g{i}") for i, g in enumerate(group)])
    return grouped.agg(F.min_by(row, rank).alias("__row")).select("__row.*")


def deduplicate(
    df: DataFrame, key_fields: Sequence[str] | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """One row of each set of equal rows, or the first row per key in ``order_by`` order."""
    if key_fields:
        if not order_by:
            raise ValueError("order_by says which row of a key is the first")
        return _first_rows(df, comparable(df, key_fields), [F.col(quoted(c)) for c in order_by], df.columns)
    if any(_holds_map(f.dataType) for f in df.schema.fields):
        return _first_rows(df, comparable(df, df.columns), [], df.columns)
    return df.dropDuplicates()


def deduplicate_records(
    df: DataFrame, column: str, key_fields: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """First row per key where a record is a map with its own set of keys.

    An absent key differs from a null one, and records with none of the keys
    are all alike.
    """
    subset = F.array_sort(F.map_entries(F.map_filter(quoted(column), lambda k, _: k.isin(*key_fields))))
    return _first_rows(df, [subset], [F.col(quoted(c)) for c in order_by], df.columns)


def merge_and_deduplicate(
    *tables: DataFrame, key_fields: Sequence[str] | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """Concatenate and deduplicate; rows of earlier tables win, absent columns are null."""
    tagged = [t.withColumn("__table", F.lit(i)) for i, t in enumerate(tables)]
    merged = tagged[0]
    for table in tagged[1:]:
        merged = merged.unionByName(table, allowMissingColumns=True)
    if not key_fields:
        return deduplicate(merged.drop("__table"))
    return deduplicate(merged, key_fields, ["__table", *order_by]).drop("__table")


def find_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys..., copies`` of every key with more than one row."""
    columns = [F.col(quoted(k)) for k in keys]
    return df.groupBy(*columns).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of keys with more than one row, with ``copies``.

    Keys are compared null-safe. The rows stay apart: adaptive execution
    splits the partition of a key that many rows share.
    """
    counted = find_duplicates(df, keys)
    renamed = counted.select(*[F.col(quoted(k)).alias(f"__k{i}") for i, k in enumerate(keys)], "copies")
    same = [F.col(quoted(k)).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    condition = same[0]
    for other in same[1:]:
        condition = condition & other
    return df.join(renamed, condition).drop(*[f"__k{i}" for i in range(len(keys))])


def fingerprint(df: DataFrame) -> DataFrame:
    """``fingerprint, rows``: equal for tables with the same rows in any order.

    The leading 60 bits of the MD5 of every row's text are summed as decimals:
    equal rows do not cancel out and the sum cannot overflow.
    """
    texts = [value_text(F.col(quoted(f.name)), f.dataType) for f in df.schema.fields]
    digest = F.md5(F.concat_ws("\x1f", *texts))
    leading = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(
        F.coalesce(F.sum(leading), F.lit(0)).cast("string").alias("fingerprint"),
        F.count("*").alias("rows"),
    )
