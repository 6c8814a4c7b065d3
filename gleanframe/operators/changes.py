"""Change tracking between snapshots of keyed records, and alerts on changes.

Both sides of a comparison go through one aggregate by key instead of a join
of two deduplicated inputs: a row is tagged as previous or current, the last
row of a key wins inside the aggregate, and a side that is absent is null.
That is the full outer join of two snapshots with a single shuffle, combined
on the map side, so repeated keys cost nothing.

Records are compared field by field as text. ``position`` says which of two
rows with one key is the later one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.numeric import quoted
from ..functions.patterns import KEY_FIELDS
from ..functions.text import parse_money, value_text
from ..session import materialised

# Fixed value: snapshots kept per source.
MAX_HISTORY = 60

# Snapshots per ranking bucket where the snapshot column is a number.
BUCKET = 1000


def pick_key(columns: Sequence[str]) -> str:
    """The first common key field among the columns, else the first column."""
    return next((k for k in KEY_FIELDS if k in columns), columns[0])


def _text(df: DataFrame, name: str) -> Column:
    """A field as text; null stays null."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    col, dtype = F.col(quoted(name)), df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return col
    return F.when(col.isNotNull(), value_text(col, dtype))


def _key_text(df: DataFrame, key: str, position: Sequence[str] = ()) -> Column:
    """The key as text; where no column has its name, a row's position is its key."""
    if key in df.columns:
        return F.coalesce(_text(df, key), F.lit("None"))
    if not position:
        raise ValueError(f"no column {key}: name a key column, or position columns to pair rows by")
    return F.concat_ws(" ", *[F.coalesce(_text(df, p), F.lit("None")) for p in position])


def _record(df: DataFrame, fields: Sequence[str]) -> Column:
    return F.struct(*[_text(df, f).alias(f"f{i}") for i, f in enumerate(fields)])


def _pair_up(tagged: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per key with the last previous and the last current record.

    ``tagged`` holds ``by..., key, is_current, pos, record, copies``.
    """
    rank = F.struct("pos", "record")
    current = F.col("is_current")

    def rows(side: Column) -> Column:
        return F.coalesce(F.sum(F.when(side, F.col("copies"))), F.lit(0).cast("long"))

    return tagged.groupBy(*by, "key").agg(
        F.max_by(F.when(~current, F.col("record")), F.when(~current, rank)).alias("prev"),
        F.max_by(F.when(current, F.col("record")), F.when(current, rank)).alias("cur"),
        rows(~current).alias("prev_copies"),
        rows(current).alias("cur_copies"),
    )


def _differs(i: int) -> Column:
    none = F.lit("None")
    return F.coalesce(F.col(f"prev.f{i}"), none) != F.coalesce(F.col(f"cur.f{i}"), none)


def _status(fields: Sequence[str]) -> Column:
    changed = F.lit(False)
    for i in range(len(fields)):
        changed = changed | _differs(i)
    return (
        F.when(F.col("prev_copies") == 0, "added")
        .when(F.col("cur_copies") == 0, "removed")
        .when(changed, "changed")
        .otherwise("unchanged")
    )


def changed_fields(paired: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``by..., key, field, previous, current, diff, pct_change, direction`` of keys on both sides."""
    if not fields:
        raise ValueError("no field to compare")
    changed = F.filter(
        F.array(*[
            F.when(_differs(i), F.struct(
                F.lit(f).alias("field"), F.col(f"prev.f{i}").alias("previous"), F.col(f"cur.f{i}").alias("current")))
            for i, f in enumerate(fields)
        ]),
        lambda c: c.isNotNull(),
    )
    rows = paired.where((F.col("prev_copies") > 0) & (F.col("cur_copies") > 0)).select(*by, "key", F.inline(changed))
    return measured(rows, by)


def measured(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by..., key, field, previous, current`` with the numeric difference, percentage and direction."""
    numbers = rows.withColumn("_p", parse_money(F.coalesce("previous", F.lit("None")))).withColumn(
        "_c", parse_money(F.coalesce("current", F.lit("None"))))
    diff = F.col("_c") - F.col("_p")
    numeric = F.col("_p").isNotNull() & F.col("_c").isNotNull()
    pct = F.when(F.col("_p") == 0, 0.0).otherwise(F.try_divide(diff, F.col("_p")) * 100)
    return numbers.select(
        *by, "key", "field", "previous", "current",
        F.when(numeric, F.round(diff, 4)).alias("diff"),
        F.when(numeric, F.round(pct, 2)).alias("pct_change"),
        F.when(~numeric, "changed").when(diff > 0, "up").otherwise("down").alias("direction"),
    )


def summarised(paired: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``by..., added, removed, changed, unchanged_count, total_changes, has_changes``.

    Where one side is empty every row of the other counts, repeated keys too.
    """
    status = _status(fields)
    counted = paired.withColumn("status", status).groupBy(*by).agg(
        F.count_if(F.col("status") == "added").alias("a"),
        F.count_if(F.col("status") == "removed").alias("r"),
        F.count_if(F.col("status") == "changed").alias("changed"),
        F.count_if(F.col("status") == "unchanged").alias("unchanged_count"),
        F.coalesce(F.sum("prev_copies"), F.lit(0)).alias("p"),
        F.coalesce(F.sum("cur_copies"), F.lit(0)).alias("c"),
    )
    return counted.select(
        *by,
        F.when(F.col("p") == 0, F.col("c")).otherwise(F.col("a")).alias("added"),
        F.when(F.col("c") == 0, F.col("p")).otherwise(F.col("r")).alias("removed"),
        "changed", "unchanged_count",
    ).withColumn("total_changes", F.col("added") + F.col("removed") + F.col("changed")).withColumn(
        "has_changes", F.col("total_changes") > 0)


def _tagged(df: DataFrame, key: str, fields: Sequence[str], position: Sequence[str], is_current: bool) -> DataFrame:
    return df.select(
        _key_text(df, key, position).alias("key"),
        F.lit(is_current).alias("is_current"),
        F.struct(*[F.col(quoted(p)) for p in position], F.lit(0)).alias("pos"),
        _record(df, fields).alias("record"), F.lit(1).cast("long").alias("copies"),
    )


def _compared(
    previous: DataFrame, current: DataFrame, key: str | None, value_fields: Sequence[str] | None, position: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    key = key or pick_key(previous.columns)
    fields = list(value_fields) if value_fields else [c for c in current.columns if c not in position]
    paired = _pair_up(
        _tagged(previous, key, fields, position, False).unionByName(_tagged(current, key, fields, position, True)), [])
    return paired, fields


def detect_changes(
    previous: DataFrame, current: DataFrame, key: str | None = None,
    value_fields: Sequence[str] | None = None, position: Sequence[str] = (),
) -> DataFrame:
    """``key, status, copies``: added, removed, changed or unchanged.

    ``copies`` counts the rows of an added or removed key.
    """
    paired, fields = _compared(previous, current, key, value_fields, position)
    copies = F.when(F.col("cur_copies") > 0, F.col("cur_copies")).otherwise(F.col("prev_copies"))
    return paired.select("key", _status(fields).alias("status"), copies.alias("copies"))


def field_changes(
    previous: DataFrame, current: DataFrame, key: str | None = None,
    value_fields: Sequence[str] | None = None, position: Sequence[str] = (),
) -> DataFrame:
    """One row per field that differs between the two records of a key.

    Fields are the named ones or the columns of the current table. Values
    differ when their texts do. With a number on both sides the row has the
    difference, the percentage of the previous value (0 where that is 0) and
    ``up``, or ``down`` also for equal numbers; else the direction is ``changed``.
    """
    paired, fields = _compared(previous, current, key, value_fields, position)
    return changed_fields(paired, [], fields)


def change_summary(
    previous: DataFrame, current: DataFrame, key: str | None = None,
    value_fields: Sequence[str] | None = None, position: Sequence[str] = (),
) -> DataFrame:
    paired, fields = _compared(previous, current, key, value_fields, position)
    return summarised(paired, [], fields)


def rule_table(spark: SparkSession, rules: Sequence[dict]) -> DataFrame:
    """Alert rules held by the caller as a table: ``rule, field, condition, threshold, label``."""
    rows = [
        (i, r.get("field"), r.get("condition"), float(r.get("threshold", 0)), r.get("label", f"{r.get('field')} alert"))
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, "rule long, field string, condition string, threshold double, label string")


def check_alerts(changes: DataFrame, rules: DataFrame | Sequence[dict]) -> DataFrame:
    """Every change row joined with every rule it triggers, as ``alert``.

    ``above`` and ``below`` compare the current number, ``change_pct`` the size
    of the percentage, which may equal the threshold. Rules given as a list
    live on the driver and are broadcast; a rule table is joined as its size
    suggests, where adaptive execution splits frequent fields.
    """
    if isinstance(rules, DataFrame):
        table = rules
    else:
        table = F.broadcast(rule_table(changes.sparkSession, rules))
    table = table.select(
        "field", "condition", F.coalesce("threshold", F.lit(0.0)).alias("threshold"),
        F.coalesce("label", F.concat("field", F.lit(" alert"))).alias("alert"),
    )
    number = parse_money(F.coalesce("current", F.lit("None")))
    fires = (
        F.when(F.col("condition") == "above", number > F.col("threshold"))
        .when(F.col("condition") == "below", number < F.col("threshold"))
        .when(F.col("condition") == "change_pct", number.isNotNull() & (F.abs("pct_change") >= F.col("threshold")))
    )
    return changes.join(table, "field").where(fires).drop("condition", "threshold")


def _bucket(df: DataFrame, snapshot: str) -> Column:
    """A coarse, order-keeping bucket of the snapshot column: a day, or a thousand numbers."""
    dtype, col = df.schema[snapshot].dataType, F.col(quoted(snapshot))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(col)
    if isinstance(dtype, T.DateType):
        return F.trunc(col, "year")
    if isinstance(dtype, T.NumericType):
        return F.floor(col / BUCKET)
    return F.substring(col, 1, 10)


def number_snapshots(df: DataFrame, source: str, snapshot: str) -> DataFrame:
    """``source, snapshot, n, last_n``: snapshots of a source numbered from 1; rows without either have none.

    Ranked inside buckets first, then bucket totals are accumulated, so that a
    source with most of the snapshots is not ranked by one task.
    """
    distinct = df.select(F.col(quoted(source)).alias(source), F.col(quoted(snapshot)).alias(snapshot)).distinct()
    listed = distinct.withColumn("__b", _bucket(distinct, snapshot))
    # Stated here, the filter is the same below both uses of the list, and its exchange is made once.
    listed = listed.where(F.col(source).isNotNull() & F.col(snapshot).isNotNull() & F.col("__b").isNotNull())
    sizes = listed.groupBy(source, "__b").agg(F.count("*").alias("__size"))
    before = Window.partitionBy(source).orderBy("__b")
    offsets = sizes.select(
        source, "__b",
        (F.sum("__size").over(before) - F.col("__size")).alias("__before"),
        F.sum("__size").over(Window.partitionBy(source)).alias("last_n"),
    )
    inside = Window.partitionBy(source, "__b").orderBy(snapshot)
    ranked = listed.withColumn("__r", F.row_number().over(inside))
    return ranked.join(offsets, [source, "__b"]).select(
        source, snapshot, (F.col("__before") + F.col("__r")).alias("n"), "last_n")


def snapshot_index(df: DataFrame, source: str, snapshot: str) -> DataFrame:
    """The numbered snapshots as ``__source, __snapshot, n, last_n``, whatever the table calls them.

    Built once and written: Spark then knows its size, sends it to the tasks
    where it is small and joins by shuffle, with skewed snapshots split, where
    it is not. The operators below take one as ``index``, for callers that use
    several of them; without it each builds its own.
    """
    return materialised(snapshot_numbers(df, source, snapshot), "snapshot-index")


def snapshot_numbers(df: DataFrame, source: str, snapshot: str) -> DataFrame:
    """What ``snapshot_index`` writes."""
    keys = df.select(F.col(quoted(source)).alias("__source"), F.col(quoted(snapshot)).alias("__snapshot"))
    return number_snapshots(keys, "__source", "__snapshot")


def _within(df: DataFrame, index: DataFrame, source: str, snapshot: str) -> DataFrame:
    """Rows of the snapshots in the index."""
    wanted = (F.col(quoted(source)) == F.col("__source")) & (F.col(quoted(snapshot)) == F.col("__snapshot"))
    return df.join(index.select("__source", "__snapshot"), wanted, "left_semi")


def retain(df: DataFrame, source: str, snapshot: str, keep: int = MAX_HISTORY, index: DataFrame | None = None) -> DataFrame:
    """Rows of the newest ``keep`` snapshots of every source."""
    index = (index if index is not None else snapshot_index(df, source, snapshot)).where(F.col("last_n") - F.col("n") < keep)
    return _within(df, index, source, snapshot)


def latest(df: DataFrame, source: str, snapshot: str, back: int = 0, index: DataFrame | None = None) -> DataFrame:
    """Rows of each source's newest snapshot, or of the one ``back`` steps before."""
    index = (index if index is not None else snapshot_index(df, source, snapshot)).where(F.col("last_n") - F.col("n") == back)
    return _within(df, index, source, snapshot)


def previous(df: DataFrame, source: str, snapshot: str, index: DataFrame | None = None) -> DataFrame:
    return latest(df, source, snapshot, back=1, index=index)


def paired_snapshots(
    df: DataFrame, source: str, snapshot: str, key: str, fields: Sequence[str], position: Sequence[str],
    index: DataFrame | None = None, copies: str | None = None,
) -> DataFrame:
    """Each snapshot against the one before it: ``source, n, key, prev, cur, ...``.

    A row plays the current record of its own snapshot and the previous record
    of the next one, so the comparison needs no self-join. ``copies`` names a
    column that says for how many rows of its key a row stands.
    """
    index = index if index is not None else snapshot_index(df, source, snapshot)
    roles = F.array(
        F.struct(F.col("n").alias("n"), F.lit(True).alias("is_current")),
        F.when(F.col("n") < F.col("last_n"), F.struct((F.col("n") + 1).alias("n"), F.lit(False).alias("is_current"))),
    )
    rows = df.select(
        F.col(quoted(source)).alias("__source"), F.col(quoted(snapshot)).alias("__snapshot"),
        _key_text(df, key, position).alias("key"),
        F.struct(*[F.col(quoted(p)) for p in position], F.lit(0)).alias("pos"),
        _record(df, fields).alias("record"), (F.col(quoted(copies)) if copies else F.lit(1)).cast("long").alias("copies"),
    ).join(index, ["__source", "__snapshot"])
    tagged = rows.select(
        F.col("__source").alias(source), "key", "pos", "record", "copies",
        F.explode(F.filter(roles, lambda r: r.isNotNull())).alias("role")
    ).select(F.col(quoted(source)), "key", "pos", "record", "copies", "role.n", "role.is_current")
    return _pair_up(tagged, [source, "n"])


def _fields(df: DataFrame, source: str, snapshot: str, value_fields: Sequence[str] | None, position: Sequence[str]):
    return list(value_fields) if value_fields else [
        c for c in df.columns if c not in {source, snapshot, *position}]


def snapshot_diffs(
    df: DataFrame, source: str, snapshot: str, key: str,
    value_fields: Sequence[str] | None = None, position: Sequence[str] = (), index: DataFrame | None = None,
) -> DataFrame:
    """``source, n, key, status`` of every key of every snapshot; the first is all added."""
    fields = _fields(df, source, snapshot, value_fields, position)
    paired = paired_snapshots(df, source, snapshot, key, fields, position, index)
    return paired.select(source, "n", "key", _status(fields).alias("status"))


def snapshot_field_changes(
    df: DataFrame, source: str, snapshot: str, key: str,
    value_fields: Sequence[str] | None = None, position: Sequence[str] = (), index: DataFrame | None = None,
) -> DataFrame:
    fields = _fields(df, source, snapshot, value_fields, position)
    return changed_fields(paired_snapshots(df, source, snapshot, key, fields, position, index), [source, "n"], fields)


def snapshot_summaries(
    df: DataFrame, source: str, snapshot: str, key: str,
    value_fields: Sequence[str] | None = None, position: Sequence[str] = (), index: DataFrame | None = None,
) -> DataFrame:
    fields = _fields(df, source, snapshot, value_fields, position)
    return summarised(paired_snapshots(df, source, snapshot, key, fields, position, index), [source, "n"], fields)


def field_history(
    df: DataFrame, source: str, snapshot: str, key: str, field: str, position: Sequence[str] = ()
) -> DataFrame:
    """``source, snapshot, key, number, raw`` of one field over time; the later row of a key wins.

    ``number`` is null where the text is no number; missing values are left out.
    """
    raw = _text(df, field)
    rank = F.struct(*[F.col(quoted(p)) for p in position], raw)
    return (
        df.where(F.col(quoted(field)).isNotNull())
        .groupBy(F.col(quoted(source)).alias(source), F.col(quoted(snapshot)).alias(snapshot), _key_text(df, key, position).alias("key"))
        .agg(F.max_by(raw, rank).alias("raw"))
        .select(source, snapshot, "key", parse_money(F.col("raw")).alias("number"), "raw")
    )


def session_summary(
    df: DataFrame, source: str, snapshot: str, key: str, rules: DataFrame | Sequence[dict] = (),
    value_fields: Sequence[str] | None = None, position: Sequence[str] = (), keep: int = MAX_HISTORY, index: DataFrame | None = None,
) -> DataFrame:
    """Per source: retained snapshots, their changes, all alerts, first and last snapshot."""
    fields = _fields(df, source, snapshot, value_fields, position)
    index = index if index is not None else snapshot_index(df, source, snapshot)
    paired = paired_snapshots(df, source, snapshot, key, fields, position, index)
    totals = index.groupBy(F.col("__source").alias(source)).agg(
        F.least(F.max("last_n"), F.lit(keep)).alias("snapshots_taken"),
        F.min("__snapshot").alias("first_snapshot"),
        F.max("__snapshot").alias("latest_snapshot"),
        F.max("last_n").alias("last_n"),
    )
    changes = (
        summarised(paired, [source, "n"], fields)
        .join(totals.select(source, "last_n"), source)
        .where(F.col("last_n") - F.col("n") < keep)
        .groupBy(source).agg(F.sum("total_changes").alias("total_changes"))
    )
    result = totals.drop("last_n").join(changes, source, "left")
    if isinstance(rules, DataFrame) or rules:
        fired = check_alerts(changed_fields(paired, [source, "n"], fields), rules)
        alerts = fired.groupBy(source).agg(F.count("*").alias("total_alerts"))
        result = result.join(alerts, source, "left")
    else:
        result = result.withColumn("total_alerts", F.lit(0).cast("long"))
    return result.select(
        source, "snapshots_taken", F.coalesce("total_changes", F.lit(0)).alias("total_changes"),
        F.coalesce("total_alerts", F.lit(0)).alias("total_alerts"), "first_snapshot", "latest_snapshot")
