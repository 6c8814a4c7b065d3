"""Whole analyses and dashboards over orders, every part's rows compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import dashboards, profiles
from ..plans.rows import long_rows
from ..session import load
from . import charting, profiles as tables
from .profiles import ORDER_NUMBERS, ORDERS, orders

PRICE = "o_totalprice"


def _dashboard(spark, sf):
    source = load(spark, sf, "orders").drop("o_orderdate")
    text = F.concat(F.lit("$"), F.col(PRICE).cast("decimal(12,2)").cast("string"))
    return long_rows(dashboards.dashboard_data(source.withColumn(PRICE, text), order_by=["o_orderkey"]).items())


QUERIES = {
    "analyze": lambda spark, sf: profiles.analysis_rows(*profiles.analyze(orders(spark, sf), ["o_orderkey"])),
    "auto_charts": lambda spark, sf: dashboards.chart_rows(dashboards.auto_charts(orders(spark, sf))),
    "dashboard_data": _dashboard,
}


def _long(part: str, query: str, columns: str) -> str:
    """A part's rows in long form; ``columns`` names them, numbers with a ``#`` in front."""
    names = columns.split()
    first, bare = names[0], [f'"{n.lstrip("#")}"' for n in names]
    key = f"{bare[0]}::DECIMAL(18,2)::VARCHAR" if first[0] == "#" else f"{bare[0]}::VARCHAR"
    numbers = ", ".join(f"round({b}::DOUBLE, 4)" if n[0] == "#" else "NULL::DOUBLE" for n, b in zip(names, bare))
    texts = ", ".join("NULL::VARCHAR" if n[0] == "#" else f"{b}::VARCHAR" for n, b in zip(names, bare))
    listed = ", ".join(f"'{n.lstrip('#')}'" for n in names)
    return f"""SELECT '{part}' AS part, {key} AS key, unnest([{listed}]) AS column, unnest([{numbers}]) AS number, unnest([{texts}]) AS text
      FROM ({query})"""


def _histogram(table: str, column: str, bins: int) -> str:
    return f"""WITH e AS (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi, (max({column})::DOUBLE - min({column})) / {bins} AS w FROM {table}),
      c AS (SELECT least(floor(({column} - lo) / w), {bins - 1})::BIGINT AS bin, count(*) AS n FROM {table}, e WHERE {column} IS NOT NULL GROUP BY 1)
      SELECT b AS bin, lo + b * w AS low, lo + (b + 1) * w AS high, coalesce(n, 0) AS count FROM e, range({bins}) t(b) LEFT JOIN c ON bin = b"""


def _counts(table: str, column: str, top: int) -> str:
    return f"SELECT {column}, count(*) AS count FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {top}"


def _sums(measures, top: int, order: str) -> str:
    shown = ", ".join(f"sum({m}) AS {m}" for m in measures)
    return f"SELECT o_orderpriority, {shown} FROM orders GROUP BY 1 ORDER BY {order} DESC, 1 LIMIT {top}"


_BINS = "#bin #low #high #count"
_PIE = "SELECT o_orderstatus AS value, count(*) AS count FROM o WHERE o_orderstatus IS NOT NULL GROUP BY 1"
_CHARTS = [
    *[("histogram", [c], _histogram("o", c, 20), _BINS) for c in ("o_orderkey", "o_custkey", PRICE)],
    ("bar", ["o_orderstatus"], _counts("o", "o_orderstatus", 15), "o_orderstatus #count"),
    ("bar", ["o_orderpriority"], _counts("o", "o_orderpriority", 15), "o_orderpriority #count"),
    ("scatter", ["o_orderkey", "o_custkey"], "SELECT o_orderkey, o_custkey, abs(o_orderkey) AS size FROM o", "#o_orderkey #o_custkey #size"),
    ("heatmap", ORDER_NUMBERS, tables.ORACLES["correlation_matrix"], "col1 col2 #correlation"),
    ("pie", ["o_orderstatus"], _PIE, "value #count"),
]
_ANALYSIS = [
    ("shape", "SELECT count(*) AS rows, 5 AS columns FROM o", "#rows #columns"),
    ("dtypes", "SELECT * FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'string'), "
               "(3, 'o_totalprice', 'double'), (4, 'o_orderpriority', 'string')) t(position, \"column\", dtype)", "#position column dtype"),
    ("missing", tables.ORACLES["missing"], "column #count #percent"),
    ("numeric_stats", tables.ORACLES["numeric_stats"], "column #mean #median #std #min #max #q25 #q75 #skewness #outliers_iqr"),
    ("categorical_stats", tables.ORACLES["categorical_stats"], "column #unique_count #rank value #count"),
    ("duplicates", f"SELECT n AS rows, d AS duplicates FROM {tables._duplicates('o')}", "#rows #duplicates"),
    ("sample_rows", tables.ORACLES["sample_rows"], "#o_orderkey #o_custkey o_orderstatus #o_totalprice o_orderpriority"),
    ("semantic_types", "SELECT * FROM (VALUES ('o_orderkey', 'numeric'), ('o_custkey', 'numeric'), ('o_orderstatus', 'categorical'), "
                       "('o_totalprice', 'price'), ('o_orderpriority', 'categorical')) t(\"column\", semantic_type)", "column semantic_type"),
    ("correlations", f"""SELECT col1, col2, round(r, 4) AS correlation,
        CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
        CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM ({tables._pairs('o', ORDER_NUMBERS)}) WHERE r IS NOT NULL""",
     "col1 col2 #correlation strength direction"),
    ("quality_score", tables.ORACLES["quality_score"], "#score"),
    ("missing_chart", charting.ORACLES["missing_chart"], "column #percent"),
    *[(f"chart {i}: {kind}", query, columns) for i, (kind, _, query, columns) in enumerate(_CHARTS)],
]
_BOX = """WITH q AS (SELECT o_orderpriority AS category, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
        quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1),
      j AS (SELECT q.*, o_totalprice AS v, o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
            FROM orders JOIN q ON o_orderpriority = category)"""
_NUMBERS = ["o_orderkey", "o_custkey", PRICE]
_SHOWN = "o_orderpriority #o_orderkey #o_custkey #o_totalprice"
_PANELS = {
    "kpis": (charting._kpi_sql("orders", 5, _NUMBERS, [PRICE], "o_orderstatus").replace(", 2)", ", 4)"), "#position label #value #average #maximum money"),
    "gauges": (" UNION ALL ".join(f"SELECT '{c}' AS column, avg({c}) AS mean, max({c})::DOUBLE AS maximum FROM orders" for c in _NUMBERS),
               "column #mean #maximum"),
    "heatmap": (tables.ORACLES["correlation_matrix"].replace(ORDERS, "o AS (SELECT * FROM orders)"), "col1 col2 #correlation"),
    "scatter": ("SELECT o_totalprice, o_orderkey, o_orderpriority, abs(o_totalprice) AS size FROM orders",
                "#o_totalprice #o_orderkey o_orderpriority #size"),
    "histogram": (_histogram("orders", PRICE, 25), _BINS),
    "histogram_marks": ("SELECT avg(o_totalprice) AS mean, quantile_cont(o_totalprice, 0.5) AS median FROM orders", "#mean #median"),
    "density": (charting.ORACLES["density"].replace("c_acctbal", PRICE).replace("customer", "orders"), "#point #x #y"),
    "area_line": (_sums(_NUMBERS, 20, "sum(o_orderkey)"), _SHOWN),
    "bar_grouped": (_sums(_NUMBERS, 12, "sum(o_orderkey)"), _SHOWN),
    "treemap": ("SELECT o_orderpriority AS category, sum(o_totalprice) AS value FROM orders WHERE o_totalprice > 0 GROUP BY 1", "category #value"),
    "summary": (_sums(_NUMBERS, 10, "sum(o_orderkey)"), _SHOWN),
    "donut": (_sums([PRICE], 8, f"sum({PRICE})"), "o_orderpriority #o_totalprice"),
    "breakdown": (_counts("orders", "o_orderpriority", 8), "o_orderpriority #count"),
    "box": (_BOX + """ SELECT category, count(*) AS n, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
      min(v) FILTER (inside) AS whisker_low, max(v) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS outliers FROM j GROUP BY 1""",
            "category #n #q1 #median #q3 #whisker_low #whisker_high #outliers"),
    "box_outliers": (_BOX + " SELECT category, v AS value FROM j WHERE NOT inside", "category #value"),
    "stacked": (_sums(_NUMBERS, 10, "sum(o_orderkey) + sum(o_custkey) + sum(o_totalprice)"), _SHOWN),
    "funnel": ("""SELECT row_number() OVER (ORDER BY value DESC, label) AS position, label, value, value / sum(value) OVER () AS share FROM (
      SELECT o_orderpriority AS label, o_totalprice AS value FROM orders ORDER BY 2 DESC, 1 LIMIT 8)""", "#position label #value #share"),
    "waterfall": ("""SELECT row_number() OVER w AS position, label, value, sum(value) OVER w - value AS start, sum(value) OVER w AS "end" FROM (
      SELECT o_orderpriority AS label, o_totalprice AS value FROM orders ORDER BY 2 DESC, 1 LIMIT 10)
      WINDOW w AS (ORDER BY value DESC, label ROWS UNBOUNDED PRECEDING)""", "#position label #value #start #end"),
}

ORACLES = {
    "analyze": f"WITH {ORDERS} " + " UNION ALL ".join(_long(*part) for part in _ANALYSIS),
    "auto_charts": f"WITH {ORDERS} " + " UNION ALL ".join(
        _long(f"{i}: {kind} of {', '.join(names)}", query, columns) for i, (kind, names, query, columns) in enumerate(_CHARTS)),
    "dashboard_data": " UNION ALL ".join(_long(name, *part) for name, part in _PANELS.items()),
}
