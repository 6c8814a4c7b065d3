"""Change tracking, alerts and the streaming watch on literal rows."""

from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gleanframe.operators import changes as C
from gleanframe.streaming import keyed
from gleanframe.streaming.watch import COPIES, SnapshotWatch, closed_snapshots, watch

SCHEMA = "pos int, name string, price string, stock string"
PREVIOUS = [
    (0, "same", "5", "a"), (1, "text", "1", "x"), (2, "cents", "$1,000", "x"), (3, "zero", "0", "x"),
    (4, "gone", "1", "x"), (5, "twice", "1", "x"), (6, "twice", "2", "x"), (7, "word", "5", "x"), (8, "null", None, "x"),
]
CURRENT = [
    (0, "same", "5", "a"), (1, "text", "1.0", "x"), (2, "cents", "$1,100", "y"), (3, "zero", "3", "x"),
    (4, "new", "1", "x"), (5, "twice", "2", "x"), (6, "word", "n/a", "x"), (7, "null", "None", "x"),
]


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(PREVIOUS, SCHEMA), spark.createDataFrame(CURRENT, SCHEMA)


def test_statuses(sides):
    found = dict((r[0], r[1]) for r in C.detect_changes(*sides, position=["pos"]).collect())
    assert found == {
        "same": "unchanged", "text": "changed", "cents": "changed", "zero": "changed", "gone": "removed", "new": "added",
        "twice": "unchanged", "word": "changed", "null": "unchanged"}


def test_field_rules(sides):
    found = rows(C.field_changes(*sides, position=["pos"]))
    assert found == [
        ("cents", "price", "$1,000", "$1,100", 100.0, 10.0, "up"),
        ("cents", "stock", "x", "y", None, None, "changed"),
        ("text", "price", "1", "1.0", 0.0, 0.0, "down"),
        ("word", "price", "5", "n/a", None, None, "changed"),
        ("zero", "price", "0", "3", 3.0, 0.0, "up"),
    ]


def test_watched_fields_only(sides):
    found = C.field_changes(*sides, value_fields=["stock", "absent"], position=["pos"])
    assert rows(found.select("key", "field")) == [("cents", "stock")]


def test_summaries_count_rows_when_a_side_is_empty(spark, sides):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.change_summary(*sides, position=["pos"]).first()[:] == (1, 1, 4, 3, 6, True)
    assert C.change_summary(empty, sides[0], position=["pos"]).first()["added"] == 9
    assert C.change_summary(sides[0], empty, position=["pos"]).first()["removed"] == 9
    assert C.change_summary(empty, empty, position=["pos"]).first()["has_changes"] is False


def test_vanished_fields_are_not_seen(spark):
    before = spark.createDataFrame([("a", 1, 2)], "id string, x int, y int")
    after = spark.createDataFrame([("a", 1, 5)], "id string, x int, z int")
    assert rows(C.field_changes(before, after)) == [("a", "z", None, "5", None, None, "changed")]


def test_key_choice():
    assert C.pick_key(["rank", "title", "x"]) == "title"
    assert C.pick_key(["x", "y"]) == "x"


def test_alert_conditions(spark):
    changed = spark.createDataFrame([
        ("a", "price", "9", "10", 1.0, 11.11, "up"), ("b", "price", "$1,000", "$900.5", -99.5, -9.95, "down"),
        ("c", "price", "1", "n/a", None, None, "changed"), ("d", "stock", "1", "2", 1.0, 100.0, "up")],
        "key string, field string, previous string, current string, diff double, pct_change double, direction string")
    rules = [
        {"field": "price", "condition": "above", "threshold": 10, "label": "over ten"},
        {"field": "price", "condition": "above", "threshold": 9.99},
        {"field": "price", "condition": "below", "threshold": 900.5},
        {"field": "price", "condition": "change_pct", "threshold": 9.95, "label": "moved"},
        {"field": "price", "condition": "above"},
        {"field": "other", "condition": "above", "threshold": 0},
        {"field": "stock", "condition": "sideways", "threshold": 0},
    ]
    found = rows(C.check_alerts(changed, rules).select("key", "alert"))
    expected = sorted([
        ("a", "price alert"), ("a", "price alert"), ("a", "price alert"), ("a", "moved"),
        ("b", "over ten"), ("b", "price alert"), ("b", "price alert"), ("b", "moved")])
    assert found == expected
    assert rows(C.check_alerts(changed, C.rule_table(spark, rules)).select("key", "alert")) == expected


def history(n, start=date(2024, 1, 1)):
    """Snapshots of two sources; the second skips days."""
    made = []
    for i in range(n):
        day = start + timedelta(days=i)
        for key in range(4):
            if (i + key) % 5:
                made.append(("one", day, i, f"k{key}", str(key * i % 7), "x" if i % 3 else "y"))
        if i % 2:
            made.append(("two", day, i, "only", str(i // 4), "z"))
    return made


HISTORY = "source string, day date, pos int, key string, price string, note string"
ARGS = dict(source="source", snapshot="day", key="key", value_fields=["price", "note"], position=["pos"])


def restated(made):
    """Changed fields per source and snapshot, by walking the snapshots in order."""
    found = []
    for source in ("one", "two"):
        days = sorted({m[1] for m in made if m[0] == source})
        last = {}
        for day in days:
            now = {m[3]: m[4:] for m in made if m[0] == source and m[1] == day}
            for key in now.keys() & last.keys():
                found += [(source, day, key, f, a, b) for f, a, b in zip(("price", "note"), last[key], now[key]) if a != b]
            last = now
    return sorted(found, key=repr)


def test_snapshot_numbers_across_buckets(spark):
    made = [("s", i) for i in range(2500)] + [("t", i * 700) for i in range(10)]
    found = C.number_snapshots(spark.createDataFrame(made, "source string, snap long"), "source", "snap")
    listed = {(r["source"], r["snap"]): (r["n"], r["last_n"]) for r in found.collect()}
    assert all(listed["s", i] == (i + 1, 2500) for i in range(2500))
    assert all(listed["t", i * 700] == (i + 1, 10) for i in range(10))


def test_snapshots_against_a_walk(spark):
    made = history(40)
    table = spark.createDataFrame(made, HISTORY)
    index = C.number_snapshots(table, "source", "day")
    found = C.snapshot_field_changes(table, **ARGS).join(index, ["source", "n"])
    assert rows(found.select("source", "day", "key", "field", "previous", "current")) == restated(made)
    first = C.snapshot_diffs(table, **ARGS).where("n = 1")
    assert {r["status"] for r in first.collect()} == {"added"}


def test_sixty_snapshots_are_kept(spark):
    table = spark.createDataFrame(history(62), HISTORY)
    kept = C.retain(table, "source", "day").where("source = 'one'")
    assert kept.select("day").distinct().count() == 60
    assert kept.agg(F.min("day")).first()[0] == date(2024, 1, 3)
    assert C.latest(table, "source", "day").select("day").distinct().count() == 1
    assert rows(C.previous(table, "source", "day").where("source = 'two'").select("day")) == [(date(2024, 2, 29),)]
    summary = {r["source"]: r for r in C.session_summary(table, **{**ARGS, "rules": [
        {"field": "price", "condition": "above", "threshold": 5}]}).collect()}
    assert summary["one"]["snapshots_taken"] == 60 and summary["two"]["snapshots_taken"] == 31
    fired = [c for c in restated(history(62)) if c[3] == "price" and float(c[5]) > 5]
    assert sum(r["total_alerts"] for r in summary.values()) == len(fired)


def test_field_history(spark):
    table = spark.createDataFrame([
        ("s", 1, 0, "k", "$1,5"), ("s", 1, 1, "k", None), ("s", 1, 2, "j", "x"), ("s", 2, 0, "k", "7"), ("s", 2, 1, "k", "8")],
        "source string, snap int, pos int, key string, price string")
    assert rows(C.field_history(table, "source", "snap", "key", "price", ["pos"])) == [
        ("s", 1, "j", None, "x"), ("s", 1, "k", 15.0, "$1,5"), ("s", 2, "k", 8.0, "8")]


def test_watch_over_many_batches_equals_the_batch_job(spark, tmp_path):
    made = history(12)
    table = spark.createDataFrame(made, HISTORY)
    job = SnapshotWatch(f"{tmp_path}/store", "source", "day", "key", ["price", "note"],
                        [{"field": "price", "condition": "above", "threshold": 3}], ["pos"])
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    # Days arrive three, then one, then two at a time, across restarts of the query.
    bounds = [0, 3, 4, 6, 12]
    for low, high in zip(bounds, bounds[1:]):
        table.where(F.col("pos").between(low, high - 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        watch(stream, job, f"{tmp_path}/checkpoint", {"availableNow": True}).awaitTermination()
    found = job.read(spark, "changes")
    assert rows(found.select("source", "snapshot", "key", "field", "previous", "current")) == restated(made)
    index = C.number_snapshots(table, "source", "day")
    batch = C.snapshot_summaries(table, **ARGS).join(index, ["source", "n"]).select("source", "day", "added", "removed", "changed")
    assert rows(job.read(spark, "summaries").select("source", "snapshot", "added", "removed", "changed")) == rows(batch)
    alerts = C.check_alerts(found, job.rules)
    assert job.read(spark, "alerts").count() == alerts.count() > 0


def test_a_batch_may_run_twice(spark, tmp_path):
    made = history(6)
    table = spark.createDataFrame(made, HISTORY)
    job = SnapshotWatch(f"{tmp_path}/store", "source", "day", "key", ["price", "note"], position=["pos"])
    job(table.where("pos < 3"), 0)
    job(table.where("pos >= 3"), 1)
    job(table.where("pos >= 3"), 1)
    found = job.read(spark, "changes").select("source", "snapshot", "key", "field", "previous", "current")
    assert rows(found) == restated(made)


def test_timestamps_number_snapshots(spark):
    start = datetime(2024, 1, 1)
    made = [("s", start + timedelta(hours=7 * i)) for i in range(30)]
    found = C.number_snapshots(spark.createDataFrame(made, "source string, at timestamp"), "source", "at")
    assert [r["n"] for r in found.orderBy("at").collect()] == list(range(1, 31))


def test_rows_without_a_key_pair_by_position(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b")], "row int, v string")
    now = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "row int, v string")
    found = C.detect_changes(before, now, "id", ["v"], ["row"])
    assert rows(found) == [("1", "unchanged", 1), ("2", "changed", 1), ("3", "added", 1)]
    with pytest.raises(ValueError):
        C.detect_changes(before, now, "id", ["v"])


def test_a_snapshot_column_may_have_any_name(spark):
    for name in ("n", "last_n", "record", "pos"):
        table = spark.createDataFrame([("s", 1, "k", "a"), ("s", 2, "k", "b")], f"source string, {name} int, item string, v string")
        found = C.snapshot_field_changes(table, "source", name, "item", ["v"])
        assert rows(found.select("source", "n", "previous", "current")) == [("s", 2, "a", "b")]
        assert rows(C.latest(table, "source", name)) == [("s", 2, "k", "b")]


def test_late_and_split_snapshots_stay_out_of_the_state(spark, tmp_path):
    job = SnapshotWatch(f"{tmp_path}/store", "source", "snap", "key", ["v"])
    arrivals = [[(1, "x", "a"), (1, "y", "a")], [(3, "x", "b"), (3, "y", "a")], [(2, "x", "z")], [(3, "z", "q")],
                [(4, "x", "c"), (4, "y", "a")]]
    for batch_id, made in enumerate(arrivals):
        job(spark.createDataFrame([("s", *m) for m in made], "source string, snap int, key string, v string"), batch_id)
    found = job.read(spark, "changes").select("snapshot", "key", "previous", "current")
    assert rows(found) == [(3, "x", "a", "b"), (4, "x", "b", "c")]
    assert rows(job.read(spark, "late").select("snap", "key", "v")) == [(2, "x", "z"), (3, "z", "q")]


STREAM = "source string, at timestamp, pos long, key string, price string, note string"


def timed(made):
    """The history with its days as timestamps."""
    start = datetime(2024, 1, 1)
    days = sorted({r[1] for r in made})
    return [(r[0], start + timedelta(days=days.index(r[1])), *r[2:]) for r in made]


def test_split_and_shuffled_snapshots_are_closed_by_the_watermark(spark, tmp_path):
    """Halves of snapshots in different batches, over a restart, give the rows of the batch comparison."""
    made = history(12)
    assert [f.name for f in spark.createDataFrame(made[:1], HISTORY).schema] == ["source", "day", "pos", "key", "price", "note"]
    table = spark.createDataFrame(timed(made), STREAM)
    job = SnapshotWatch(f"{tmp_path}/store", "source", "at", "key", ["price", "note"], position=["pos"], copies=COPIES)
    args = dict(source="source", snapshot="at", key="key", value_fields=["price", "note"], delay="5 days", position=["pos"])
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    # Every second row is three days late.
    half = F.pmod(F.xxhash64("source", "key", "pos", "at"), F.lit(2))
    arrival = F.floor((F.datediff("at", F.lit("2024-01-01")) + 3 * half) / 4)
    for part in range(5):
        rows_of = table.where(arrival == part)
        if part == 4:
            rows_of = rows_of.unionByName(spark.createDataFrame([(None, datetime(2025, 1, 1), None, None, None, None)], STREAM))
        rows_of.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if part % 2 == 0:
            watch(closed_snapshots(stream, **args), job, f"{tmp_path}/checkpoint", {"availableNow": True}).awaitTermination()
    found = job.read(spark, "changes").select("source", F.datediff("snapshot", F.lit("2024-01-01")).alias("d"), "key", "field", "previous", "current")
    names = sorted({r[1] for r in made})
    assert rows(found) == sorted([(r[0], names.index(r[1]), *r[2:]) for r in restated(made)], key=repr)
    index = C.number_snapshots(table, "source", "at")
    batch = C.snapshot_summaries(table, "source", "at", "key", ["price", "note"], ["pos"]).join(index, ["source", "n"])
    counts = ["source", "added", "removed", "changed", "unchanged_count"]
    assert rows(job.read(spark, "summaries").select("snapshot", *counts)) == rows(batch.select("at", *counts))
    # Only two generations of the state are kept.
    assert sorted(p.name for p in (tmp_path / "store" / "state").iterdir()) == ["slot=0", "slot=1"]


def test_sources_that_did_not_come_stay_in_the_state(spark, tmp_path):
    job = SnapshotWatch(f"{tmp_path}/store", "source", "snap", "key", ["v"])
    arrivals = [[("a", 1, "x", "1"), ("b", 1, "x", "1")], [("a", 2, "x", "2")], [("a", 3, "x", "3")], [("b", 2, "x", "5")]]
    for batch_id, made in enumerate(arrivals):
        job(spark.createDataFrame(made, "source string, snap int, key string, v string"), batch_id)
    found = job.read(spark, "changes").select("source", "snapshot", "previous", "current")
    assert rows(found) == [("a", 2, "1", "2"), ("a", 3, "2", "3"), ("b", 2, "1", "5")]


def test_keyed_state_over_batches_and_a_restart(spark, tmp_path):
    made = [("s", f"2024-01-{d:02d}", d * 10 + p, k, f"${(d * 7 + p) % 5}", None if d % 3 else "n")
            for d in range(1, 13) for k in ("x", "y") for p in range(2) if not (k == "y" and d in (4, 5))]
    table = spark.createDataFrame(made, "source string, day string, pos long, key string, price string, note string")
    (tmp_path / "in").mkdir()
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, keyed.PROVIDER)
    try:
        for low, high in ((1, 4), (5, 5), (6, 12)):
            table.where(F.substring("day", 9, 2).cast("int").between(low, high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
            found = keyed.keyed_changes(stream, "source", "day", "key", ["price", "note"], position=["pos"])
            found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
                "checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    expected = []
    for key in ("x", "y"):
        last = {}
        for _, day, pos, k, price, note in made:
            if k == key and pos % 10 == 1:
                for field, value in (("price", price), ("note", note or "None")):
                    if field in last and last[field] != value:
                        expected.append((key, day, field, last[field], value))
                    last[field] = value
    out = spark.read.parquet(f"{tmp_path}/out")
    assert rows(out.select("key", "snapshot", "field", "previous", "current")) == sorted(expected, key=repr)
    up = out.where("field = 'price'").select("previous", "current", "direction").collect()
    assert all((r["direction"] == "up") == (r["current"] > r["previous"]) for r in up)


def test_keyed_state_forgets_after_its_time(spark, tmp_path):
    """With a time to live, a value that was not seen for a second is no longer compared with."""
    schema = "source string, day string, key string, price string"
    (tmp_path / "in").mkdir()
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, keyed.PROVIDER)
    try:
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        found = keyed.keyed_changes(stream, "source", "day", "key", ["price"], ttl_ms=1000)
        # State with a time to live is looked through at every trigger, so such a stream never runs dry by itself.
        query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
            "checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="1 second").start()
        for day, price in (("1", "a"), ("2", "b")):
            spark.createDataFrame([("s", day, "x", price)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            query.awaitTermination(12)
        query.stop()
    finally:
        spark.conf.set(setting, before)
    assert spark.read.schema("previous string").parquet(f"{tmp_path}/out").count() == 0


def test_keyed_state_is_read_and_written_once_a_key_and_batch():
    class State:
        value, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, *args, **kwargs):
            return State()

    one = keyed.LastValues(["a", "b"], None)
    one.init(Handle())
    rows = [("s", "k", "2", "", "1", "x"), ("s", "k", "1", " 1", "0", "x"), ("s", "k", "1", " 0", "9", "w")]
    found = list(one.handleInputRows(("s", "k"), iter(rows), None))
    assert [tuple(r) for r in found] == [("s", "k", "2", "a", "0", "1")] and State.calls == ["get", "update"]
    found = list(one.handleInputRows(("s", "k"), iter([("s", "k", "3", "", "1", "y")]), None))
    assert [tuple(r) for r in found] == [("s", "k", "3", "b", "x", "y")]
