"""The parts of a bundle as one table in long form."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import quoted


def long_rows(parts: Iterable[tuple[str, DataFrame]], digits: int = 4) -> DataFrame:
    """``part, key, column, number, text``: a row for every value of every row of every part.

    ``key`` is the row's first column as text (numbers to two digits), ``number`` holds numeric values rounded to
    ``digits``, ``text`` all others.
    """
    def entry(field: T.StructField):
        value = F.col(quoted(field.name))
        numeric = isinstance(field.dataType, T.NumericType)
        return F.struct(
            F.lit(field.name).alias("column"),
            (F.round(value.cast("double"), digits) if numeric else F.lit(None).cast("double")).alias("number"),
            (F.lit(None) if numeric else value).cast("string").alias("text"))

    def listed(name: str, data: DataFrame) -> DataFrame:
        first = data.schema.fields[0]
        key = F.col(quoted(first.name))
        if isinstance(first.dataType, T.NumericType):
            key = key.cast("decimal(18,2)")
        return data.select(F.lit(name).alias("part"), key.cast("string").alias("key"), F.inline(F.array(*map(entry, data.schema.fields))))

    return reduce(DataFrame.unionByName, [listed(name, data) for name, data in parts])
