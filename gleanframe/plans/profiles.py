"""The full analysis of a table: profile, correlations, quality and charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import profile as P
from ..operators.charts import missing_chart
from .dashboards import Chart, auto_charts
from .rows import long_rows

EMPTY = "Empty DataFrame"


def _empty(df: DataFrame) -> dict[str, DataFrame]:
    return {"error": P.small_table(df.sparkSession, [(EMPTY,)], "error string")}


def profile(df: DataFrame, order_by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Shape, types, gaps, statistics, duplicates and sample rows, each a table.

    An empty table gives only ``error``. ``order_by`` says which rows the
    sample shows; without it the smallest by all columns.
    """
    if df.isEmpty():
        return _empty(df)
    return {
        "shape": P.shape(df),
        "dtypes": P.dtypes(df),
        "missing": P.missing(df),
        "numeric_stats": P.numeric_stats(df),
        "categorical_stats": P.categorical_stats(df),
        "duplicates": P.count_duplicates(df),
        "sample_rows": P.sample_rows(df, order_by or df.columns),
    }


def analyze(df: DataFrame, order_by: Sequence[str] = ()) -> tuple[dict[str, DataFrame], list[Chart]]:
    """The profile with semantic types, correlations and the quality score, and the charts."""
    parts = profile(df, order_by)
    if "error" in parts:
        return parts, []
    parts["semantic_types"] = P.semantic_types(df)
    parts["correlations"] = P.correlation_pairs(df)
    parts["quality_score"] = P.quality_score(df)
    parts["missing_chart"] = missing_chart(parts["missing"])
    return parts, auto_charts(df)


def analysis_rows(parts: dict[str, DataFrame], charts: Sequence[Chart]) -> DataFrame:
    """All that an analysis returned, in long form."""
    return long_rows([*parts.items(), *((f"chart {i}: {c.kind}", c.data) for i, c in enumerate(charts))])
