"""Numeric aggregates that stay exact and distributed at any table size."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialised

# Values that all searches together may have left between their bounds before they are sorted.
LEFT_VALUES = 200_000
SKETCH_ACCURACY = 10_000


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null, so that both count as missing."""
    col = F.col(quoted(name))
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.nanvl(col, F.lit(None).cast("double"))
    return col


def pinned(df: DataFrame, *keep: str | Column, **computed: Column) -> DataFrame:
    """Select ``keep`` and the computed columns, each evaluated once per row.

    The optimizer would paste a projected expression into every place that
    uses it, and into lambdas once per array element. A one-row generator is
    not pasted, costs no shuffle and keeps the value.
    """
    row = F.struct(*[value.alias(name) for name, value in computed.items()])
    return df.select(*keep, F.inline(F.array(row)))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def adjusted_skewness(col: Column) -> Column:
    """Bias-adjusted sample skewness; 0 for a constant, null below three values."""
    n = F.count(col)
    constant = F.min(col) == F.max(col)
    factor = F.try_divide(F.sqrt((n * (n - 1)).cast("double")), (n - 2).cast("double"))
    return F.when(n < 3, F.lit(None).cast("double")).when(constant, 0.0).otherwise(F.skewness(col) * factor)


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    left_values: int = LEFT_VALUES,
    accuracy: int = SKETCH_ACCURACY,
    sizes: dict[str, int] | None = None,
    brackets: dict[str, list[float]] | None = None,
) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of whole columns, by column name.

    Every column is narrowed down from both sides, see ``_ranked``, so that no
    task ever holds a column: at most ``left_values`` values of all columns and
    probabilities together. ``sizes`` passes in non-null counts that are known
    already, ``brackets`` what ``bracketing`` gave in the same pass; both spare a scan.
    """
    columns = list(columns)
    if not columns:
        return {}
    values = {c: present(df, c).cast("double") for c in columns}
    if sizes is None:
        counts = df.agg(*[F.count(values[c]).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        sizes = dict(zip(columns, counts))
    found: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    filled = [c for c in columns if sizes[c]]
    if filled:
        spots = {(c, p): p * (sizes[c] - 1) for c in filled for p in probs}
        floors = sorted({(c, math.floor(spot)) for (c, _), spot in spots.items()})
        around = {}
        if brackets is not None:
            around = {(c, math.floor(spot)): brackets[c][2 * i: 2 * i + 2]
                      for (c, p), spot in spots.items() for i in [list(probs).index(p)]}
        ranked, following = _ranked(
            df, values, {t: sizes[t[0]] for t in floors}, max(1, left_values // len(floors)), accuracy, around)
        following |= _next_values(df, values, {t: v for t, v in ranked.items() if t not in following})
        for (c, p), spot in spots.items():
            at = (c, math.floor(spot))
            low, part = ranked[at], spot - math.floor(spot)
            found[c][list(probs).index(p)] = low if not part or following[at] == low else low + (following[at] - low) * part
    return found


def bracketing(value: Column, probs: Sequence[float], accuracy: int = SKETCH_ACCURACY) -> Column:
    """Two values around each of the quantiles, out of one sketch, for an aggregate that is made anyway."""
    margin = 2.0 / accuracy
    return F.percentile_approx(value, [min(1.0, max(0.0, p + off)) for p in probs for off in (-margin, margin)], accuracy)


def grouped_quantiles(counts: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``category, n, quantiles`` of ``counts(category, value, copies)``, exact and interpolated, for any number of groups.

    The distinct values stand in the order of group and value, dealt to range
    partitions; each partition's copies of a group are added up, so a value's first rank is
    the copies before its partition plus those before it inside. A group that holds most of the
    rows spans many partitions. Only the values at the wanted ranks are brought together, a few a group.
    """
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = counts.repartitionByRange(parts, "category", "value").withColumn("part", F.spark_partition_id())
    placed = materialised(placed, "ranked")
    sums = placed.groupBy("category", "part").agg(F.sum("copies").alias("held"))
    before = Window.partitionBy("category").orderBy("part")
    offsets = sums.select("category", "part", (F.sum("held").over(before) - F.col("held")).alias("ahead"),
                          F.sum("held").over(Window.partitionBy("category")).alias("n"))
    inside = Window.partitionBy("category", "part").orderBy("value")
    ranked = placed.withColumn("last", F.sum("copies").over(inside)).join(offsets, ["category", "part"]).select(
        "category", "n", "value", (F.col("ahead") + F.col("last") - F.col("copies")).alias("first"), (F.col("ahead") + F.col("last")).alias("end"))
    spot = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    floors = [F.floor(spot(p)) for p in probs]

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank < F.col("end")), F.col("value")))

    wanted = F.lit(False)
    for low in floors:
        wanted = wanted | ((F.col("first") <= low + 1) & (low < F.col("end")))
    few = ranked.where(wanted).groupBy("category", "n").agg(*[
        x for i, low in enumerate(floors) for x in (at(low).alias(f"low{i}"), at(low + 1).alias(f"next{i}"))])

    def value(i: int, p: float) -> Column:
        low, following, part = F.col(f"low{i}"), F.col(f"next{i}"), spot(p) - floors[i]
        return F.when((part == 0) | (following == low), low).otherwise(low + (following - low) * part)

    return few.select("category", "n", F.array(*[value(i, p) for i, p in enumerate(probs)]).alias("quantiles"))


def _next_values(
    df: DataFrame, values: dict[str, Column], ranked: dict[tuple[str, int], float]
) -> dict[tuple[str, int], float | None]:
    """The value one rank above each of the ranks: the same one if it repeats, else the next larger."""
    if not ranked:
        return {}
    row = df.agg(*[
        x for i, ((c, _), at) in enumerate(ranked.items())
        for x in (F.count_if(values[c] <= at).alias(f"n{i}"), F.min(F.when(values[c] > at, values[c])).alias(f"m{i}"))
    ]).first()
    return {
        (c, k): at if row[2 * i] > k + 1 else row[2 * i + 1] for i, ((c, k), at) in enumerate(ranked.items())
    }


@dataclass
class _Search:
    """Where the value of one rank lies: strictly between two bounds, ``rank`` values above the lower."""

    column: str
    rank: int
    left: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def within(self, value: Column) -> Column:
        inside = value.isNotNull()
        if self.low is not None:
            inside = inside & (value > self.low)
        if self.high is not None:
            inside = inside & (value < self.high)
        return inside


def _ranked(
    df: DataFrame, values: dict[str, Column], targets: dict[tuple[str, int], int], left_rows: int, accuracy: int,
    around: dict[tuple[str, int], list[float]],
) -> tuple[dict[tuple[str, int], float], dict[tuple[str, int], float | None]]:
    """Values at 0-based ranks of columns, and those one rank above where the last step shows them.

    ``targets`` maps ``(column, rank)`` to the column's size, ``around`` to two values to begin with.

    Each round sketches two values around every rank and counts exactly what
    lies below, between and above them, which settles the rank or narrows its
    bounds by about the sketch's accuracy. The counts alone decide, so the
    result does not depend on how good the sketch is. A round is two
    column-pruned aggregates of one row, whatever the table's size: one round
    is enough up to 1e8 values, two up to 1e12.
    """
    searches = {t: _Search(*t, left=size) for t, size in targets.items()}
    while True:
        wide = [s for s in searches.values() if s.value is None and s.left > left_rows]
        if not wide:
            break
        margin = 2.0 / accuracy
        # Searches between the same bounds share a sketch.
        shared: dict[tuple, list[_Search]] = {}
        for s in wide:
            shared.setdefault((s.column, s.low, s.high), []).append(s)
        begun = bool(around)
        row = [] if begun else df.agg(*[
            F.percentile_approx(
                F.when(group[0].within(values[column]), values[column]),
                [x for s in group for x in (max(0.0, s.rank / s.left - margin), min(1.0, (s.rank + 1) / s.left + margin))],
                accuracy,
            ).alias(f"s{i}")
            for i, ((column, _, _), group) in enumerate(shared.items())
        ]).first()
        wide = [s for group in shared.values() for s in group]
        names = {id(s): t for t, s in searches.items()}
        sketches = [tuple(around[names[id(s)]]) for s in wide] if begun else [
            (found[2 * i], found[2 * i + 1]) for found, group in zip(row, shared.values()) for i in range(len(group))]
        around = {}
        tests = []
        for s, (a, b) in zip(wide, sketches):
            v, inside = values[s.column], s.within(values[s.column])
            tests += [inside & (v < a), inside & (v == a), inside & (v > a) & (v < b), inside & (v == b) & (v > a)]
        counts = df.agg(*[F.count_if(t).alias(f"n{i}") for i, t in enumerate(tests)]).first()
        for i, (s, (a, b)) in enumerate(zip(wide, sketches)):
            below, at_a, between, at_b = counts[4 * i: 4 * i + 4]
            if s.rank < below:
                s.high, s.left = a, below
            elif s.rank < below + at_a:
                s.value = a
            elif s.rank < below + at_a + between:
                s.rank, s.left, s.low, s.high = s.rank - below - at_a, between, a, b
            elif s.rank < below + at_a + between + at_b:
                s.value = b
            else:
                passed = below + at_a + between + at_b
                s.rank, s.left, s.low = s.rank - passed, s.left - passed, b
    rest = {t: s for t, s in searches.items() if s.value is None}
    following: dict[tuple[str, int], float | None] = {}
    if rest:
        picks = []
        for s in rest.values():
            value = values[s.column]
            inside = F.slice(F.array_sort(F.collect_list(F.when(s.within(value), value))), s.rank + 1, 2)
            beyond = F.lit(None).cast("double") if s.high is None else F.min(F.when(value >= s.high, value))
            picks += [inside, beyond]
        picked = df.agg(*[x.alias(f"v{i}") for i, x in enumerate(picks)]).first()
        for i, (t, s) in enumerate(rest.items()):
            pair, beyond = picked[2 * i], picked[2 * i + 1]
            s.value, following[t] = pair[0], pair[1] if len(pair) > 1 else beyond
    return {t: s.value for t, s in searches.items()}, following
