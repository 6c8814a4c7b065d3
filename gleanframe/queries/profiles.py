"""Profiling queries over orders, customers and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile, sketches
from ..session import load, materialised
from .sqltext import strings


def orders(spark, sf):
    """Orders with gaps in two columns."""
    return load(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.expr("nullif(o_orderstatus, 'P')").alias("o_orderstatus"),
        F.when(F.col("o_totalprice") >= 60000, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderpriority",
    )


ORDERS = """o AS (SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
  CASE WHEN o_totalprice >= 60000 THEN o_totalprice END AS o_totalprice, o_orderpriority FROM orders)"""
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]


def lines(spark, sf):
    return load(spark, sf, "lineitem").select(
        "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.lit(7.0).alias("constant"))


LINES = """l AS (SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, 7.0::DOUBLE AS constant
  FROM lineitem)"""
LINE_COLUMNS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "constant"]


def flags(spark, sf):
    """Line items cut to a few columns, so that rows repeat."""
    return load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")


FLAGS = "f AS (SELECT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem)"

def _within_rank_error(spark, sf):
    """Quantiles out of merged daily sketches, each held against its exact rank in the table."""
    events = load(spark, sf, "events")
    daily = sketches.quantile_sketches(events.withColumn("day", F.to_date("ts")), ["value"], ["day"])
    found = materialised(sketches.merged_quantiles(daily, [0.01, 0.25, 0.5, 0.75, 0.99]), "quantiles")
    values = [r["value"] for r in found.collect()]
    ranks = events.agg(F.array(*[F.struct(F.lit(v).alias("value"), F.count_if(F.col("value") < v).alias("below"),
                                          F.count_if(F.col("value") <= v).alias("upto")) for v in values]).alias("r"))
    placed = found.join(ranks.select(F.inline("r")).dropDuplicates(["value"]), "value")
    off = F.greatest(F.col("below") / F.col("n") - F.col("prob"), F.col("prob") - F.col("upto") / F.col("n"))
    return placed.select("column", "n", "prob", (off <= F.col("error")).alias("within"))


def _within_bounds(spark, sf):
    """Distinct counts out of merged daily sketches, each held against the exact count."""
    columns = ["user_id", "event_type", "value", "event_id"]
    events = load(spark, sf, "events").withColumn("day", F.to_date("ts"))
    bounds = sketches.distinct_bounds(sketches.distinct_sketches(events, columns, ["day"]))
    exact = profile.value_counts_by_column(events.select(*[F.col(c).cast("string").alias(c) for c in columns]), columns).groupBy(
        "column").agg(F.count("*").alias("unique_count"))
    return bounds.join(exact, "column").select("column", "unique_count", F.col("unique_count").between(F.col("low"), F.col("high")).alias("within"))


QUERIES = {
    "quantile_sketches": _within_rank_error,
    "distinct_sketches": _within_bounds,
    "frequent_values": lambda spark, sf: sketches.frequent_values(
        load(spark, sf, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")), "word", 15, counters=400),
    "shape": lambda spark, sf: profile.shape(load(spark, sf, "lineitem")),
    "missing": lambda spark, sf: profile.missing(orders(spark, sf)),
    "numeric_stats": lambda spark, sf: profile.numeric_stats(orders(spark, sf)),
    "numeric_stats_lineitem": lambda spark, sf: profile.numeric_stats(lines(spark, sf)),
    "outliers_iqr": lambda spark, sf: profile.outliers_iqr(
        load(spark, sf, "events").select((F.col("value") * F.col("value")).alias("squared"), "value")),
    "categorical_stats": lambda spark, sf: profile.categorical_stats(orders(spark, sf)),
    "categorical_stats_part": lambda spark, sf: profile.categorical_stats(load(spark, sf, "part")),
    "sample_rows": lambda spark, sf: profile.sample_rows(orders(spark, sf), ["o_orderkey"]),
    "semantic_types": lambda spark, sf: profile.semantic_types(load(spark, sf, "part")),
    "dtypes": lambda spark, sf: profile.dtypes(load(spark, sf, "customer")),
    "correlation_pairs": lambda spark, sf: profile.correlation_pairs(lines(spark, sf)),
    "correlation_matrix": lambda spark, sf: profile.correlation_matrix(orders(spark, sf)).select(
        "col1", "col2", F.round("correlation", 6).alias("correlation")),
    "count_duplicates": lambda spark, sf: profile.count_duplicates(flags(spark, sf)),
    "quality_score": lambda spark, sf: profile.quality_score(orders(spark, sf)),
    "quality_score_duplicates": lambda spark, sf: profile.quality_score(flags(spark, sf)),
    "quick_stats": lambda spark, sf: profile.quick_stats(orders(spark, sf)),
    "value_counts": lambda spark, sf: profile.value_counts(load(spark, sf, "part"), "p_brand"),
    "group_sum_topk": lambda spark, sf: profile.group_sum_topk(
        load(spark, sf, "lineitem"), "l_suppkey", ["l_quantity"], 20),
}


def _gap(table: str, column: str) -> str:
    return f"SELECT '{column}' AS column, count(*) - count({column}) AS count, count(*) AS n FROM {table}"


def _stats(table: str, column: str) -> str:
    x = f"{column}::DOUBLE"
    return f"""SELECT '{column}' AS column, round(avg({x}), 4) AS mean, round(quantile_cont({x}, 0.5), 4) AS median,
      round(stddev_samp({x}), 4) AS std, round(min({x}), 4) AS min, round(max({x}), 4) AS max,
      round(quantile_cont({x}, 0.25), 4) AS q25, round(quantile_cont({x}, 0.75), 4) AS q75,
      CASE WHEN count({x}) < 3 THEN NULL WHEN min({x}) = max({x}) THEN 0.0 ELSE round(skewness({x}), 4) END::DOUBLE AS skewness,
      {_outliers(table, column)} AS outliers_iqr FROM {table}"""


def _outliers(table: str, column: str) -> str:
    x = f"{column}::DOUBLE"
    return f"""(SELECT count(*) FROM {table}, (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {table})
      WHERE {x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1))"""


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _top(table: str, columns) -> str:
    counts = _union(
        f"SELECT '{c}' AS column, {c} AS value, count(*) AS count FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in columns)
    return f"""SELECT "column", unique_count, rank, value, count FROM (
      SELECT *, count(*) OVER (PARTITION BY "column") AS unique_count,
             row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM ({counts})) WHERE rank <= 5"""


def _pairs(table: str, columns) -> str:
    return _union(
        f"SELECT '{a}' AS col1, '{b}' AS col2, CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN corr({a}, {b}) END AS r FROM {table}"
        f" WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for i, a in enumerate(columns) for b in columns[i + 1:])


def _duplicates(table: str) -> str:
    return f"""(SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS d FROM {table})"""


def _score(table: str, columns) -> str:
    gaps = _union(_gap(table, c) for c in columns)
    return f"""SELECT floor(100 - least(40, 1.5 * (SELECT avg(round(count / n * 100, 2)) FROM ({gaps})))
      - least(30, d / n * 100))::BIGINT AS score FROM {_duplicates(table)}"""


ORACLES = {
    "quantile_sketches": """SELECT 'value' AS column, (SELECT count(value) FROM events) AS n, prob::DOUBLE AS prob, true AS within
      FROM (SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.99]) AS prob)""",
    "distinct_sketches": " UNION ALL ".join(f"SELECT '{c}' AS column, count(DISTINCT {c}) AS unique_count, true AS within FROM events"
                                            for c in ("user_id", "event_type", "value", "event_id")),
    "frequent_values": r"""SELECT word, count(*) AS count FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')) AS word FROM documents)
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""",
    "shape": "SELECT count(*) AS rows, 11::BIGINT AS columns FROM lineitem",
    "missing": f'WITH {ORDERS} SELECT "column", count, round(count / n * 100, 2) AS percent FROM ('
               + _union(_gap("o", c) for c in ORDER_COLUMNS) + ")",
    "numeric_stats": f"WITH {ORDERS} " + _union(_stats("o", c) for c in ORDER_NUMBERS),
    "numeric_stats_lineitem": f"WITH {LINES} " + _union(_stats("l", c) for c in LINE_COLUMNS),
    "outliers_iqr": "WITH e AS (SELECT value * value AS squared, value FROM events) " + _union(
        f"SELECT '{c}' AS column, {_outliers('e', c)} AS outliers_iqr" for c in ("squared", "value")),
    "categorical_stats": f"WITH {ORDERS} " + _top("o", ["o_orderstatus", "o_orderpriority"]),
    "categorical_stats_part": _top("part", ["p_name", "p_brand", "p_type"]),
    "sample_rows": f"WITH {ORDERS} SELECT * FROM o ORDER BY o_orderkey LIMIT 3",
    "semantic_types": """SELECT column_name AS column, CASE
        WHEN regexp_matches(column_name, 'price|cost|fee|amount|salary|wage') THEN 'price'
        WHEN regexp_matches(column_name, 'rating|score|stars|grade|rank') THEN 'rating'
        WHEN regexp_matches(column_name, 'date|time|posted|created|updated|published') THEN 'date'
        WHEN regexp_matches(column_name, 'url|link|href|website') THEN 'url'
        WHEN regexp_matches(column_name, 'count|number|qty|quantity|total|num_') THEN 'count'
        WHEN regexp_matches(column_name, 'name|title|label|description|summary') THEN 'text'
        WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' ELSE 'categorical' END AS semantic_type
      FROM (DESCRIBE part)""",
    "dtypes": """SELECT row_number() OVER () - 1 AS position, column_name AS column,
        CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
        ELSE lower(column_type) END AS dtype FROM (DESCRIBE customer)""",
    "correlation_pairs": f"""WITH {LINES} SELECT col1, col2, round(r, 4) AS correlation,
        CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
        CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
      FROM ({_pairs('l', LINE_COLUMNS)}) WHERE r IS NOT NULL""",
    "correlation_matrix": f"""WITH {ORDERS}, p AS ({_pairs('o', ORDER_NUMBERS)})
      SELECT col1, col2, round(r, 6) AS correlation FROM p UNION ALL SELECT col2, col1, round(r, 6) FROM p
      UNION ALL SELECT c, c, 1.0::DOUBLE FROM (SELECT unnest([{strings(ORDER_NUMBERS)}]) AS c)""",
    "count_duplicates": f"WITH {FLAGS} SELECT n AS rows, d AS duplicates FROM {_duplicates('f')}",
    "quality_score": f"WITH {ORDERS} " + _score("o", ORDER_COLUMNS),
    "quality_score_duplicates": f"WITH {FLAGS} "
        + _score("f", ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"]),
    "quick_stats": f"""WITH {ORDERS} SELECT n AS rows, 5::BIGINT AS columns, 3::BIGINT AS numeric_cols,
        2::BIGINT AS text_cols, round((SELECT sum(count) FROM ({_union(_gap('o', c) for c in ORDER_COLUMNS)})) / (n * 5) * 100, 1) AS missing_pct,
        d AS duplicates, {', '.join(f'(SELECT round(avg({c}), 2) FROM o) AS {c}_mean' for c in ORDER_NUMBERS)}
      FROM {_duplicates('o')}""",
    "value_counts": "SELECT p_brand, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    "group_sum_topk": """SELECT l_suppkey, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1
      ORDER BY 2 DESC, 1 LIMIT 20""",
}
