"""Flattening, widening, renaming and conforming tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import quoted
from ..functions.text import value_text

# A table with more distinct keys than this is not meant to be widened.
MAX_COLUMNS = 5000


def _text_fields(*names: str) -> T.StructType:
    return T.StructType([
        T.StructField(name, T.ArrayType(T.StringType()) if name == "tags" else T.StringType()) for name in names
    ])


# Fixed value: columns of the record kinds.
RECORD_KINDS = {
    "article": _text_fields("title", "author", "published_date", "summary", "tags"),
    "product": _text_fields("name", "price", "currency", "description", "rating", "availability"),
    "job": _text_fields("title", "company", "location", "salary", "description"),
    "event": _text_fields("name", "date", "location", "description"),
    "contact": _text_fields("name", "email", "phone", "address"),
}


def flatten(df: DataFrame, sep: str = "_", map_keys: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Nested structs to ``outer_inner`` columns, lists to text joined by `` | ``.

    A map's keys are data: those named in ``map_keys`` for its flat name become
    ``outer_key`` columns, and a map without named keys becomes JSON text. When two columns end up with one name, the later value takes the place of
    the earlier one.
    """
    flat: dict[str, Column] = {}
    named = map_keys or {}

    def walk(col: Column, dtype: T.DataType, name: str) -> None:
        if isinstance(dtype, T.StructType):
            for field in dtype.fields:
                walk(col[field.name], field.dataType, f"{name}{sep}{field.name}")
        elif isinstance(dtype, T.ArrayType):
            items = F.transform(col, lambda x: value_text(x, dtype.elementType))
            flat[name] = F.array_join(items, " | ")
        elif isinstance(dtype, T.MapType) and name in named:
            for key in named[name]:
                walk(F.try_element_at(col, F.lit(key)), dtype.valueType, f"{name}{sep}{key}")
        elif isinstance(dtype, T.MapType):
            flat[name] = F.to_json(col)
        else:
            flat[name] = col

    for field in df.schema.fields:
        walk(F.col(quoted(field.name)), field.dataType, field.name)
    return df.select(*[col.alias(name) for name, col in flat.items()])


def records_to_df(df: DataFrame, flat: bool = True) -> DataFrame:
    """A table of records, flattened; a single column of plain values is named ``value``."""
    if len(df.columns) == 1 and not isinstance(df.schema.fields[0].dataType, (T.StructType, T.MapType)):
        return df.toDF("value")
    if len(df.columns) == 1 and isinstance(df.schema.fields[0].dataType, T.StructType):
        df = df.select(f"{quoted(df.columns[0])}.*")
    return flatten(df) if flat else df


def widen(df: DataFrame, column: str = "fields", keys: Sequence[str] | None = None,
          max_columns: int = MAX_COLUMNS) -> DataFrame:
    """The map column as one column per key; absent keys are null.

    ``keys`` names the columns. Without it they are the keys that occur, found
    by a distributed count, which raises beyond ``max_columns``: a table with
    more belongs in long form. A key named like one of the other columns gets
    the map's name in front.
    """
    names = list(keys) if keys is not None else None
    if names is None:
        found = df.select(F.explode(F.map_keys(quoted(column))).alias("key")).distinct()
        names = sorted(row["key"] for row in found.limit(max_columns + 1).collect())
        if len(names) > max_columns:
            raise ValueError(f"{column} holds more than {max_columns} distinct keys")
    others = [c for c in df.columns if c != column]
    values = [
        F.try_element_at(F.col(quoted(column)), F.lit(k)).alias(f"{column}_{k}" if k in others else k) for k in names
    ]
    return df.select(*[F.col(quoted(c)) for c in others], *values)


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep the first of columns that share a name."""
    first = [i for i, name in enumerate(df.columns) if name not in df.columns[:i]]
    renamed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"c{i}").alias(df.columns[i]) for i in first])


def normalize_column_names(df: DataFrame) -> DataFrame:
    """Lower case with ``_`` for other characters; of names that meet, the later column stays."""
    names = [re.sub(r"[^a-zA-Z0-9_]", "_", name.lower()).strip("_") for name in df.columns]
    last = {name: i for i, name in enumerate(names)}
    renamed = df.toDF(*[f"c{i}" for i in range(len(names))])
    return renamed.select(*[F.col(f"c{i}").alias(name) for name, i in last.items()])


def conform(df: DataFrame, kind: str) -> DataFrame:
    """The columns of a record kind; absent ones are null."""
    return df.select(*[
        (F.col(quoted(f.name)) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in RECORD_KINDS[kind].fields
    ])
