"""Chart bundles: which charts a table gets, and their rows.

The column choice takes one profiling pass; charts are then lazy plans that
read only their own columns. Nothing is held in memory, as a table may be larger
than the cluster's; a table whose texts had to be parsed is stored once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import quoted, string_columns
from ..operators import charts as C
from ..operators.clean import coerce_numeric
from ..operators.profile import value_counts
from ..operators.reshape import drop_duplicate_columns
from ..session import materialised
from .rows import long_rows

# Fixed value: distinct values up to which a text column counts as a category.
FEW_VALUES = 20


@dataclass(frozen=True)
class Chart:
    kind: str
    columns: list[str]
    data: DataFrame


def auto_charts(df: DataFrame) -> list[Chart]:
    """Three histograms, two value counts, a scatter, a heat map and a pie, as the columns allow."""
    choice = C.choose(df)
    # Columns the choice did not count exactly are well above the limit by estimate.
    few = [c for c in string_columns(df) if choice.distinct.get(c, FEW_VALUES + 1) <= FEW_VALUES]
    numeric = choice.numeric
    charts = [Chart("histogram", [c], C.histogram(df, c, C.COLUMN_BINS)) for c in numeric[:3]]
    charts += [Chart("bar", [c], value_counts(df, c)) for c in few[:2]]
    if len(numeric) >= 2:
        points = C.scatter(df, numeric[0], numeric[1])
        if not points.isEmpty():
            charts.append(Chart("scatter", numeric[:2], points))
    if len(numeric) >= 3:
        charts.append(Chart("heatmap", numeric, C.heatmap(df)))
    if few:
        charts.append(Chart("pie", few[:1], C.pie_with_other(df, few[0])))
    return charts


def chart_rows(charts: list[Chart]) -> DataFrame:
    """The rows of a list of charts in long form; a part's name tells its place, kind and columns."""
    return long_rows([(f"{i}: {c.kind} of {', '.join(c.columns)}", c.data) for i, c in enumerate(charts)])


def dashboard_data(df: DataFrame, style: C.Style = C.DASHBOARD, order_by: list[str] | None = None) -> dict[str, DataFrame]:
    """Rows of every panel of the dashboard a table can fill.

    Columns with one name are reduced to the first, texts that hold numbers
    become numeric, and panels whose columns are missing are left out.
    """
    source = drop_duplicate_columns(df)
    df = coerce_numeric(source)
    if df.schema != source.schema:
        # Parsing text into numbers costs more than reading numbers back for every panel.
        df = materialised(df, "dashboard")
    choice = C.choose(df, style)
    numeric, measure, category, axis = choice.numeric, choice.best_numeric, choice.best_category, choice.axis
    panels = {"kpis": C.kpis(df, style, choice)}
    if len(numeric) >= 2:
        panels["gauges"] = C.gauges(df, numeric[:4])
        panels["heatmap"] = C.heatmap(df)
        x, y = C.scatter_columns(choice, style)
        panels["scatter"] = C.scatter(df, x, y, category, choice.best_label)
    if measure:
        panels["histogram"] = C.histogram(df, measure)
        panels["histogram_marks"] = C.histogram_marks(df, measure)
        panels["density"] = C.density(df, measure)
    if axis and numeric:
        panels["area_line"] = C.area_line(df, axis, numeric[:3])
        panels["bar_grouped"] = C.bar_grouped(df, axis, numeric[:3])
        panels["treemap"] = C.treemap(df, axis, measure)
    if axis:
        shown = df if numeric else df.select(*[F.col(quoted(c)) for c in df.columns[:5]])
        panels["summary"] = C.summary_table(shown, axis, numeric[:4], order_by=order_by or ())
    if category:
        panels["donut"] = C.donut(df, category, measure, style)
        others = choice.categories
        panels["breakdown"] = C.donut(df, others[1], None, style) if len(others) >= 2 else C.donut(df, category, None, style)
    if category and measure:
        panels["box"], panels["box_outliers"] = C.box(df, category, measure)
    if category and len(numeric) >= 2:
        panels["stacked"] = C.stacked(df, category, numeric[:4], style)
    if choice.row_label and measure:
        panels["funnel"] = C.funnel(df, choice.row_label, measure)
        if len(numeric) >= 2:
            panels["waterfall"] = C.waterfall(df, choice.row_label, measure)
    return panels
