"""Chart queries over orders, parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as C
from ..operators import profile, sentiment, topics, words
from ..session import load, load_spread
from .profiles import ORDERS, orders
from .sqltext import half_up
from .sqltext import words as words_sql
from .text import ORACLES as _TEXT
from .text import lexicon

CATEGORY, PRICE = "o_orderpriority", "o_totalprice"
MEASURES = ["o_totalprice", "o_orderkey", "o_custkey"]


def _rounded(df, *names, digits: int = 2):
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


def _choices(spark, sf):
    rows = []
    for table in ("orders", "part", "customer"):
        for name, style in (("dashboard", C.DASHBOARD), ("report", C.REPORT)):
            choice = C.choose(load(spark, sf, table).drop("c_custkey"), style)
            rows.append((table, name, choice.best_numeric, choice.best_category, choice.best_label, ", ".join(choice.categories)))
    return profile.small_table(
        spark, rows, "table string, style string, best_numeric string, best_category string, best_label string, categories string")


QUERIES = {
    "kpis": lambda spark, sf: _rounded(C.kpis(orders(spark, sf)), "value", "average", "maximum"),
    "kpis_report": lambda spark, sf: _rounded(
        C.kpis(load(spark, sf, "part"), C.REPORT), "value", "average", "maximum"),
    "chart_columns": _choices,
    "gauges": lambda spark, sf: _rounded(C.gauges(orders(spark, sf)), "mean", "maximum"),
    "area_line": lambda spark, sf: _rounded(C.area_line(orders(spark, sf), CATEGORY, MEASURES), *MEASURES),
    "bar_grouped": lambda spark, sf: _rounded(
        C.bar_grouped(load(spark, sf, "part"), "p_brand", ["p_retailprice", "p_size"]), "p_retailprice"),
    "top_bars": lambda spark, sf: _rounded(C.top_bars(load(spark, sf, "part"), "p_brand", "p_retailprice"), "p_retailprice"),
    "donut": lambda spark, sf: _rounded(C.donut(orders(spark, sf), CATEGORY, PRICE), PRICE),
    "donut_counts": lambda spark, sf: C.donut(load(spark, sf, "part"), "p_type", None, C.REPORT),
    "stacked": lambda spark, sf: _rounded(C.stacked(orders(spark, sf), CATEGORY, MEASURES), *MEASURES),
    "summary_table": lambda spark, sf: _rounded(
        C.summary_table(load(spark, sf, "lineitem"), "l_suppkey", ["l_extendedprice", "l_quantity"]), "l_extendedprice"),
    "pie_with_other": lambda spark, sf: C.pie_with_other(load(spark, sf, "part"), "p_brand"),
    "histogram": lambda spark, sf: _rounded(C.histogram(orders(spark, sf), PRICE), "low", "high", digits=4),
    "histogram_marks": lambda spark, sf: _rounded(C.histogram_marks(orders(spark, sf), PRICE), "mean", "median", digits=4),
    "kde": lambda spark, sf: _rounded(C.kde(load(spark, sf, "customer"), "c_acctbal"), "x", "y", digits=4),
    "density": lambda spark, sf: _rounded(C.density(load(spark, sf, "customer"), "c_acctbal"), "x", "y", digits=4),
    "box_many": lambda spark, sf: _rounded(C.box(_suppliers(spark, sf), "supplier", "l_extendedprice")[0], "q1", "median", "q3", digits=6),
    "waterfall": lambda spark, sf: _rounded(C.waterfall(load(spark, sf, "part"), "p_name", "p_retailprice"), "start", "end"),
    "funnel": lambda spark, sf: _rounded(C.funnel(orders(spark, sf), CATEGORY, PRICE), "share", digits=8),
    "treemap": lambda spark, sf: _rounded(C.treemap(load(spark, sf, "customer"), "c_mktsegment", "c_acctbal"), "value"),
    "box": lambda spark, sf: _rounded(_box(spark, sf)[0], "q1", "median", "q3", digits=6),
    "box_outliers": lambda spark, sf: _box(spark, sf)[1],
    "scatter": lambda spark, sf: C.scatter(orders(spark, sf), PRICE, "o_custkey", "o_orderstatus", CATEGORY),
    "missing_chart": lambda spark, sf: C.missing_chart(profile.missing(orders(spark, sf))),
    "keyword_chart": lambda spark, sf: C.keyword_chart(words.keywords(load_spread(spark, sf, "documents"), top_n=30)),
    "sentiment_gauge": lambda spark, sf: C.sentiment_gauge(
        sentiment.sentiment(load_spread(spark, sf, "documents"), lexicon(spark, sf))),
    "topic_chart": lambda spark, sf: C.topic_chart(topics.topics(load_spread(spark, sf, "documents"))),
}


def _box(spark, sf):
    events = load(spark, sf, "events").select("event_type", (F.col("value") * F.col("value")).alias("squared"))
    return C.box(events, "event_type", "squared")


def _suppliers(spark, sf):
    """Line items by part and supplier, a third of them under one name: thousands of categories, one of them hot."""
    name = F.when(F.col("l_orderkey") % 3 == 0, "house").otherwise(F.concat_ws("-", "l_suppkey", F.col("l_partkey") % 40))
    return load(spark, sf, "lineitem").select(name.alias("supplier"), "l_extendedprice")


def _sums(table: str, by: str, measures, k: int, order: str, digits=2) -> str:
    shown = ", ".join(f"round(coalesce(sum({m}), 0), {digits})::DOUBLE AS {m}" for m in measures)
    return f"SELECT {by}, {shown} FROM {table} GROUP BY {by} ORDER BY {order} DESC, {by} LIMIT {k}"


_BOX = """e AS (SELECT event_type AS category, value * value AS v FROM events),
  q AS (SELECT category, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM e GROUP BY 1),
  j AS (SELECT e.*, q1, median, q3, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM e JOIN q USING (category))"""


def _kpi_sql(table: str, columns: int, measures, money, category: str) -> str:
    rows = [f"SELECT 0::BIGINT AS position, 'Total Records' AS label, count(*)::DOUBLE AS value, NULL::DOUBLE AS average, NULL::DOUBLE AS maximum, false AS money FROM {table}",
            f"SELECT 1, 'Columns', {columns}, NULL, NULL, false"]
    for i, m in enumerate(measures):
        rows.append(f"SELECT {i + 2}, '{m}', round(sum({m}), 2), round(avg({m}), 2), round(max({m}), 2), {str(m in money).lower()} FROM {table}")
    rows.append(f"SELECT {len(measures) + 2}, 'Unique {category}', count(DISTINCT {category}), NULL, NULL, false FROM {table}")
    return " UNION ALL ".join(rows)


ORACLES = {
    "kpis": f"WITH {ORDERS} " + _kpi_sql("o", 5, ["o_orderkey", "o_custkey", "o_totalprice"], ["o_totalprice"], "o_orderstatus"),
    "kpis_report": _kpi_sql("part", 6, ["p_partkey", "p_size", "p_retailprice"], ["p_retailprice"], "p_brand"),
    "chart_columns": """SELECT 'orders' AS table, 'dashboard' AS style, 'o_totalprice' AS best_numeric, 'o_orderpriority' AS best_category,
        'o_orderpriority' AS best_label, 'o_orderstatus, o_orderpriority' AS categories
      UNION ALL SELECT 'orders', 'report', 'o_totalprice', 'o_orderstatus', 'o_orderpriority', 'o_orderstatus, o_orderpriority'
      UNION ALL SELECT 'part', s, 'p_retailprice', 'p_type', 'p_name',
        (SELECT string_agg(c, ', ' ORDER BY i) FROM (SELECT 1 AS i, 'p_name' AS c, count(DISTINCT p_name) AS n FROM part
          UNION ALL SELECT 2, 'p_brand', count(DISTINCT p_brand) FROM part UNION ALL SELECT 3, 'p_type', count(DISTINCT p_type) FROM part)
          WHERE n BETWEEN 2 AND most) FROM (SELECT 'dashboard' AS s, 25 AS most UNION ALL SELECT 'report', 30)
      UNION ALL SELECT 'customer', s, 'c_acctbal', 'c_mktsegment', 'c_name', 'c_mktsegment'
        FROM (SELECT unnest(['dashboard', 'report']) AS s)""",
    "gauges": f"WITH {ORDERS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column, round(avg({c}), 2) AS mean, round(max({c}), 2)::DOUBLE AS maximum FROM o"
        for c in ("o_orderkey", "o_custkey", "o_totalprice")),
    "area_line": f"WITH {ORDERS} " + _sums("o", CATEGORY, MEASURES, 20, f"sum({PRICE})"),
    "bar_grouped": _sums("part", "p_brand", ["p_retailprice", "p_size"], 12, "sum(p_retailprice)"),
    "top_bars": _sums("part", "p_brand", ["p_retailprice"], 15, "sum(p_retailprice)"),
    "donut": f"WITH {ORDERS} " + _sums("o", CATEGORY, [PRICE], 8, f"sum({PRICE})"),
    "donut_counts": "SELECT p_type, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "stacked": f"WITH {ORDERS} " + _sums("o", CATEGORY, MEASURES, 10, " + ".join(f"sum({m})" for m in MEASURES)),
    "summary_table": _sums("lineitem", "l_suppkey", ["l_extendedprice", "l_quantity"], 10, "sum(l_extendedprice)"),
    "pie_with_other": """WITH r AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rn FROM part GROUP BY 1)
      SELECT CASE WHEN rn <= 8 THEN p_brand ELSE 'Other' END AS value, sum(n)::BIGINT AS count FROM r GROUP BY 1""",
    "histogram": f"""WITH {ORDERS}, e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice)) / 25 AS w FROM o),
      c AS (SELECT least(floor((o_totalprice - lo) / w), 24)::BIGINT AS bin, count(*) AS n FROM o, e WHERE o_totalprice IS NOT NULL GROUP BY 1)
      SELECT b AS bin, round(lo + b * w, 4) AS low, round(lo + (b + 1) * w, 4) AS high, coalesce(n, 0) AS count
      FROM e, range(25) t(b) LEFT JOIN c ON bin = b""",
    "histogram_marks": f"WITH {ORDERS} SELECT round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM o",
    "kde": """WITH s AS (SELECT count(c_acctbal) AS n, stddev_samp(c_acctbal) * count(c_acctbal) ** -0.2 AS h, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer),
      g AS (SELECT p AS point, lo + p * ((hi - lo) / 199) AS x, h, n, lo, hi FROM s, range(200) t(p))
      SELECT point, round(x, 4) AS x, round(sum(exp(-0.5 * ((x - c_acctbal) / h) ** 2)) / (n * h * sqrt(2 * pi())) * n * (hi - lo) / 25, 4) AS y
      FROM g, customer GROUP BY point, x, n, h, lo, hi""",
    "density": """WITH s AS (SELECT count(c_acctbal) AS n, stddev_samp(c_acctbal) * count(c_acctbal) ** -0.2 AS h, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer),
      v AS (SELECT (c_acctbal - lo) / (h / 64) AS place, h, lo FROM customer, s WHERE c_acctbal IS NOT NULL),
      w AS (SELECT floor(place)::BIGINT AS cell, 1 - (place - floor(place)) AS weight FROM v
            UNION ALL SELECT floor(place)::BIGINT + 1, place - floor(place) FROM v),
      c AS (SELECT cell, sum(weight) AS weight FROM w GROUP BY 1),
      g AS (SELECT p AS point, lo + p * ((hi - lo) / 199) AS x, h, n, lo, hi FROM s, range(200) t(p))
      SELECT point, round(x, 4) AS x, round(sum(weight * exp(-0.5 * ((x - (lo + cell * (h / 64))) / h) ** 2)) / (n * h * sqrt(2 * pi())) * n * (hi - lo) / 25, 4) AS y
      FROM g, c GROUP BY point, x, n, h, lo, hi""",
    "box_many": """WITH e AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'house' ELSE l_suppkey || '-' || (l_partkey % 40) END AS category, l_extendedprice AS v FROM lineitem),
      q AS (SELECT category, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM e GROUP BY 1),
      j AS (SELECT e.*, q1, median, q3, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM e JOIN q USING (category))
      SELECT category, count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
      round(any_value(q3), 6) AS q3, min(v) FILTER (inside) AS whisker_low, max(v) FILTER (inside) AS whisker_high,
      count(*) FILTER (NOT inside) AS outliers FROM j GROUP BY 1""",
    "waterfall": """WITH t AS (SELECT p_name AS label, p_retailprice AS value FROM part ORDER BY 2 DESC, 1 LIMIT 10)
      SELECT row_number() OVER w AS position, label, value, round(sum(value) OVER w - value, 2) AS start, round(sum(value) OVER w, 2) AS "end"
      FROM t WINDOW w AS (ORDER BY value DESC, label ROWS UNBOUNDED PRECEDING)""",
    "funnel": f"""WITH {ORDERS}, t AS (SELECT o_orderpriority AS label, o_totalprice AS value FROM o WHERE o_totalprice IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 8)
      SELECT row_number() OVER (ORDER BY value DESC, label) AS position, label, value, round(value / sum(value) OVER (), 8) AS share FROM t""",
    "treemap": "SELECT c_mktsegment AS category, round(sum(c_acctbal), 2) AS value FROM customer WHERE c_acctbal > 0 GROUP BY 1",
    "box": f"""WITH {_BOX} SELECT category, count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
      round(any_value(q3), 6) AS q3, min(v) FILTER (inside) AS whisker_low, max(v) FILTER (inside) AS whisker_high,
      count(*) FILTER (NOT inside) AS outliers FROM j GROUP BY 1""",
    "box_outliers": f"WITH {_BOX} SELECT category, v AS value FROM j WHERE NOT inside",
    "scatter": f"WITH {ORDERS} SELECT o_totalprice, o_custkey, o_orderstatus, o_orderpriority, abs(o_totalprice) AS size FROM o WHERE o_totalprice IS NOT NULL",
    "missing_chart": f"""WITH {ORDERS} SELECT "column", percent FROM (SELECT 'o_orderstatus' AS column, round(count(*) FILTER (o_orderstatus IS NULL) / count(*) * 100, 2) AS percent FROM o
      UNION ALL SELECT 'o_totalprice', round(count(*) FILTER (o_totalprice IS NULL) / count(*) * 100, 2) FROM o) WHERE percent > 0""",
    "keyword_chart": f"WITH {words_sql()} SELECT word, count(*) AS count FROM words GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
}

ORACLES["topic_chart"] = f"SELECT doc_id, topic, confidence FROM ({_TEXT['topics']})"
ORACLES["sentiment_gauge"] = f"""SELECT doc_id, {half_up('polarity', 3)} AS value,
  CASE WHEN polarity >= 0.1 THEN 'good' WHEN polarity <= -0.1 THEN 'bad' ELSE 'middle' END AS band FROM ({_TEXT['sentiment']})"""
