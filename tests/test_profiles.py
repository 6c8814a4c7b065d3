"""Profiles, charts and scale behaviour against numpy and pandas on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from gleanframe.functions.numeric import bracketing, quantiles
from gleanframe.operators import charts as C
from gleanframe.operators import profile as P
from gleanframe.operators import sketches as S
from gleanframe.plans import dashboards, profiles


def numbers(spark, *columns):
    width = len(columns)
    return spark.createDataFrame(list(zip(*columns)), ", ".join(f"c{i} double" for i in range(width)))


def test_constants_and_short_columns(spark):
    table = numbers(spark, [7.0, 7.0, 7.0], [1.0, 2.0, None], [1.0, None, float("nan")], [None, None, None])
    found = {r["column"]: r for r in P.numeric_stats(table).collect()}
    assert set(found) == {"c0", "c1", "c2"}
    assert found["c0"]["skewness"] == 0.0 and found["c0"]["std"] == 0.0
    assert found["c1"]["skewness"] is None and found["c1"]["median"] == 1.5
    assert found["c2"]["std"] is None and found["c2"]["mean"] == 1.0
    assert {r["column"]: r["count"] for r in P.missing(table).collect()} == {"c0": 0, "c1": 1, "c2": 2, "c3": 3}
    # The only pair that varies shares a single row.
    assert P.correlation_pairs(table).count() == 0


def test_statistics_equal_pandas(spark):
    rng = np.random.default_rng(5)
    data = np.where(rng.random(400) < 0.1, np.nan, rng.lognormal(2, 1, 400).round(3))
    series = pd.Series(data)
    table = numbers(spark, [None if math.isnan(v) else float(v) for v in data])
    row = P.numeric_stats(table).first()
    q1, q3 = series.quantile(0.25), series.quantile(0.75)
    outside = ((series < q1 - 1.5 * (q3 - q1)) | (series > q3 + 1.5 * (q3 - q1))).sum()
    expected = [series.mean(), series.median(), series.std(), series.min(), series.max(), q1, q3, series.skew()]
    assert np.allclose(row[1:9], np.round(expected, 4)) and row["outliers_iqr"] == outside


def test_correlations_equal_pandas_over_complete_pairs(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=200)
    frame = pd.DataFrame({"c0": a, "c1": a * 2 + rng.normal(size=200), "c2": rng.normal(size=200), "c3": -a + 1e6})
    gaps = frame.copy()
    gaps.loc[::7, "c2"] = np.nan
    gaps.loc[::11, "c1"] = np.nan
    for data in (frame, gaps):
        table = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in data.values],
                                      "c0 double, c1 double, c2 double, c3 double")
        expected = data.corr()
        found = P.correlation_matrix(table).collect()
        assert len(found) == 16
        assert all(abs(r["correlation"] - expected.loc[r["col1"], r["col2"]]) < 1e-9 for r in found)
    labels = {(r["col1"], r["col2"]): (r["strength"], r["direction"]) for r in P.correlation_pairs(table).collect()}
    assert labels["c0", "c3"] == ("strong", "negative") and labels["c0", "c1"] == ("strong", "positive")


def test_duplicates_count_nulls_and_nan_as_equal(spark):
    table = spark.createDataFrame([(1.0, None), (1.0, None), (float("nan"), "x"), (float("nan"), "x"), (2.0, "y")], "a double, b string")
    assert P.count_duplicates(table).first()[:] == (5, 2)
    assert P.count_duplicates(table.where("false")).first()[:] == (0, 0)


@pytest.mark.parametrize("gap, copies, score", [(0, 0, 100), (5, 0, 62), (9, 0, 60), (0, 9, 70), (0, 1, 90)])
def test_quality_score(spark, gap, copies, score):
    table = spark.createDataFrame([(i if i >= copies else 99, None if i < gap else i) for i in range(10)], "a int, b int")
    if copies:
        table = spark.createDataFrame([(0 if i <= copies else i,) for i in range(10)], "a int")
    assert P.quality_score(table).first()[0] == score


def test_categorical_ties(spark):
    table = spark.createDataFrame([(v, None) for v in "ccaabbdefgh"] + [(None, None)], "s string, empty string")
    found = rows(P.categorical_stats(table))
    assert [(r[2], r[3], r[4]) for r in found] == [(1, "a", 2), (2, "b", 2), (3, "c", 2), (4, "d", 1), (5, "e", 1)]
    assert found[0][1] == 8


def test_semantic_types(spark):
    table = spark.createDataFrame([(1, "a", 1.0, 2, "u", "v")], "Price_date int, Rank string, x double, num_x int, other string, Homepage_link string")
    assert [r[1] for r in P.semantic_types(table).collect()] == ["price", "rating", "numeric", "count", "categorical", "url"]


def test_empty_tables(spark):
    table = spark.createDataFrame([], "a double, b string")
    parts, charts = profiles.analyze(table)
    assert parts["error"].first()[0] == "Empty DataFrame" and charts == []
    assert C.histogram(table, "a").count() == 0 and C.kde(table, "a").count() == 0
    assert P.numeric_stats(table).count() == 0 and P.correlation_pairs(table).count() == 0


@pytest.mark.parametrize("values", [
    [5.0] * 700 + list(range(300)), [1e300, -1e300, 0.0, 1.0], list(np.random.default_rng(1).zipf(1.5, 900).astype(float)),
])
def test_refined_quantiles_are_exact(spark, values):
    """The way taken by large columns, forced onto small ones."""
    probs = [0.0, 0.25, 0.5, 0.99]
    values = [float(v) for v in values]
    table = numbers(spark, values, values[::-1]).repartition(3)
    for left_values, accuracy in ((120, 100), (900, 1000)):
        found = quantiles(table, ["c0", "c1"], probs, left_values=left_values, accuracy=accuracy)
        expected = np.quantile(values, probs)
        given = table.agg(bracketing(F.col("c0"), probs, accuracy).alias("a"), bracketing(F.col("c1"), probs, accuracy).alias("b")).first()
        begun = quantiles(table, ["c0", "c1"], probs, left_values=left_values, accuracy=accuracy, brackets={"c0": given[0], "c1": given[1]})
        assert begun == found
        assert np.allclose(found["c0"], expected, rtol=1e-12) and np.allclose(found["c1"], expected, rtol=1e-12)


def test_histogram_edges(spark):
    table = numbers(spark, [0.0, 1.0, 2.0, 10.0, 10.0, None])
    found = C.histogram(table, "c0", 5).orderBy("bin").collect()
    assert [r["count"] for r in found] == [2, 1, 0, 0, 2] and found[0]["low"] == 0.0 and found[-1]["high"] == 10.0
    assert [r["count"] for r in C.histogram(numbers(spark, [4.0, 4.0]), "c0", 2).orderBy("bin").collect()] == [0, 2]


def test_density_equals_the_formula(spark):
    values = np.random.default_rng(3).normal(5, 2, 60)
    found = C.kde(numbers(spark, [float(v) for v in values]), "c0", points=20, bins=25).orderBy("point").collect()
    h = values.std(ddof=1) * 60 ** -0.2
    xs = np.linspace(values.min(), values.max(), 20)
    density = np.exp(-0.5 * ((xs[:, None] - values) / h) ** 2).sum(axis=1) / (60 * h * math.sqrt(2 * math.pi))
    assert np.allclose([r["y"] for r in found], density * 60 * np.ptp(values) / 25)
    assert np.allclose([r["x"] for r in found], xs)


def test_pie_other(spark):
    table = spark.createDataFrame([(v,) for v in "aaabbc"] + [(None,)], "s string")
    assert rows(C.pie_with_other(table, "s", 2)) == [("Other", 1), ("a", 3), ("b", 2)]
    assert rows(C.pie_with_other(table, "s", 3)) == [("a", 3), ("b", 2), ("c", 1)]


def test_box_of_many_uneven_categories(spark):
    draw = np.random.default_rng(4)
    made = [("hot", float(v)) for v in draw.integers(0, 50, 3000)] + [(f"k{i % 500}", float(v)) for i, v in enumerate(draw.normal(0, 9, 2000))]
    made += [("one", 1.0), ("two", 1.0), ("two", 2.0), ("gap", None), (None, 3.0)]
    table = spark.createDataFrame(made, "k string, v double").repartition(3)
    summary, beyond = C.box(table, "k", "v")
    found = {r["category"]: r for r in summary.collect()}
    groups = {}
    for k, v in made:
        if k is not None and v is not None:
            groups.setdefault(k, []).append(v)
    assert set(found) == set(groups)
    out = []
    for k, values in groups.items():
        q1, median, q3 = np.quantile(values, [0.25, 0.5, 0.75])
        inside = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
        out += [(k, v) for v in values if v not in set(inside)]
        r = found[k]
        assert np.allclose([r["q1"], r["median"], r["q3"]], [q1, median, q3], rtol=1e-12)
        assert (r["n"], r["whisker_low"], r["whisker_high"], r["outliers"]) == (
            len(values), min(inside), max(inside), len(values) - len(inside))
    assert rows(beyond) == sorted(out, key=repr)
    assert C.box(table.limit(0), "k", "v")[0].count() == 0


def test_binned_density_is_close(spark):
    draw = np.random.default_rng(3)
    for values in (draw.normal(5, 2, 500), np.append(draw.normal(0, 1, 300), [80.0, 80.0, -40.0]), np.repeat([1.0, 2.0], 50)):
        table = numbers(spark, [*map(float, values), None])
        exact = [r["y"] for r in C.kde(table, "c0", points=40).orderBy("point").collect()]
        found = [r["y"] for r in C.density(table, "c0", points=40).orderBy("point").collect()]
        peak = len(values) * np.ptp(values) / 25 / (values.std(ddof=1) * len(values) ** -0.2 * math.sqrt(2 * math.pi))
        assert np.abs(np.array(exact) - found).max() <= peak / (8 * C.CELLS**2) + 1e-9
    assert C.density(numbers(spark, [1.0, 1.0]), "c0").count() == 0


def test_correlations_with_gaps_and_constants(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(1e6, 3, 400)
    columns = [base, base * 2 + draw.normal(0, 5, 400), np.full(400, 0.1), draw.normal(0, 1, 400), np.where(np.arange(400) < 200, 7.0, np.nan)]
    columns[3][::3] = np.nan
    made = [tuple(None if np.isnan(v) else float(v) for v in row) for row in zip(*columns)]
    table = spark.createDataFrame(made, ", ".join(f"c{i} double" for i in range(5))).repartition(3)
    found = {(r["col1"], r["col2"]): r["correlation"] for r in P.correlation_matrix(table).collect()}
    assert len(found) == 25
    for i in range(5):
        for j in range(5):
            both = ~np.isnan(columns[i]) & ~np.isnan(columns[j])
            a, b = columns[i][both], columns[j][both]
            if a.min() == a.max() or b.min() == b.max():
                assert found[f"c{i}", f"c{j}"] is None
            else:
                assert abs(found[f"c{i}", f"c{j}"] - np.corrcoef(a, b)[0, 1]) < 1e-9
    wide = spark.createDataFrame([tuple(map(float, r)) for r in draw.normal(0, 1, (30, 130))], ", ".join(f"w{i} double" for i in range(130)))
    assert P.correlation_pairs(wide).count() == 130 * 129 // 2


def test_near_ties_are_chosen_as_by_exact_counts(spark):
    """Columns of almost equal distinct counts: the sketch's bounds overlap, so they are counted."""
    made = [(f"a{i % 1999}", f"b{i}" if i < 2000 else "b0", f"c{i % 26}", f"d{i % 25}") for i in range(6000)]
    table = spark.createDataFrame(made, "first string, second string, over string, limit string")
    choice = C.choose(table)
    assert choice.best_label == "second" and choice.categories == ["limit"]


def test_sketches_merge(spark):
    draw = np.random.default_rng(9)
    made = [(int(i % 7), float(v), f"u{int(abs(v) * 3)}") for i, v in enumerate(draw.normal(0, 100, 20_000))]
    table = spark.createDataFrame([*made, (1, None, None), (8, float("nan"), None)], "day int, v double, u string")
    quantile = S.merged_quantiles(S.quantile_sketches(table, ["v"], ["day"]), [0.0, 0.1, 0.5, 0.999]).collect()
    ordered = np.sort([m[1] for m in made])
    for r in quantile:
        assert r["n"] == 20_000
        assert abs(np.searchsorted(ordered, r["value"]) / 20_000 - r["prob"]) <= S.rank_error()
    bounds = S.distinct_bounds(S.distinct_sketches(table, ["u", "day"], ["day"])).collect()
    exact = {"u": len({m[2] for m in made}), "day": 8}
    assert all(b["low"] <= exact[b["column"]] <= b["high"] for b in bounds) and len(bounds) == 2


@pytest.mark.parametrize("counters", [5, 40, 10_000])
def test_frequent_values_are_exact(spark, counters):
    draw = np.random.default_rng(6)
    values = [int(v) for v in draw.zipf(1.6, 5000)] + list(range(10**6, 10**6 + 900)) + [None] * 30
    table = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    assert S.frequent_values(table, "v", 6, counters).collect() == P.value_counts(table, "v", 6).collect()
    flat = spark.range(300).select((F.col("id") % 100).alias("v"))
    assert S.frequent_values(flat, "v", 4, counters).collect() == P.value_counts(flat, "v", 4).collect()
    assert S.frequent_values(table.limit(0), "v").count() == 0


def test_column_choice(spark):
    table = spark.createDataFrame(
        [(i, i * 3.0, f"n{i}", f"g{i % 7}", f"r{i % 9}", "one") for i in range(120)],
        "id int, wide double, code string, sevens string, nines string, single string")
    choice = C.choose(table)
    assert (choice.best_numeric, choice.best_category, choice.best_label) == ("wide", "sevens", "code")
    assert choice.categories == ["sevens", "nines"]
    assert C.choose(table, C.REPORT).best_category == "nines"
    named = table.withColumnRenamed("id", "Total_Sales").withColumnRenamed("nines", "Home_Region").withColumnRenamed("single", "Job_Title")
    choice = C.choose(named)
    assert (choice.best_numeric, choice.best_category, choice.best_label) == ("Total_Sales", "Home_Region", "Job_Title")
    assert C.choose(spark.createDataFrame([(1,)], "a int")).axis is None


def test_dashboard_skips_what_it_cannot_draw(spark):
    texts = spark.createDataFrame([("a", "b")] * 3 + [("c", "d")], "x string, y string")
    panels = dashboards.dashboard_data(texts)
    assert set(panels) == {"kpis", "summary", "donut", "breakdown"}
    one = spark.createDataFrame([(float(i),) for i in range(5)], "v double")
    assert set(dashboards.dashboard_data(one)) == {"kpis", "histogram", "histogram_marks", "density"}


def test_dashboard_turns_money_texts_into_measures(spark):
    table = spark.createDataFrame([(i, f"${i},000", f"g{i % 3}") for i in range(12)], "i int, price string, kind string")
    panels = dashboards.dashboard_data(table, order_by=["i"])
    assert panels["donut"].columns == ["kind", "price"]
    assert rows(panels["donut"])[0] == ("g0", 18000.0)
    assert {"gauges", "heatmap", "scatter", "box", "stacked", "waterfall", "funnel"} <= set(panels)


def test_hot_keys_leave_a_partial_result_per_task(spark):
    """A third of all rows share a key: what is shuffled is bounded by tasks, not rows."""
    from gleanframe.operators.dedup import deduplicate

    rows_in = spark.range(0, 30000, 1, 6).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.lit("x" * 20).alias("v"))
    kept = deduplicate(rows_in, ["k"], ["id"])
    assert kept.count() == 50
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min_by") == 1 and "Window" not in plan
    top = P.categorical_stats(rows_in.select(F.col("id").cast("string").alias("s")))
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
