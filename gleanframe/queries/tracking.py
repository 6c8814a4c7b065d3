"""Change-tracking queries: daily event totals per user as snapshots of a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes
from ..session import load, materialised, shared_dir
from ..streaming import keyed, watch
from .sqltext import half_up

RULES = [
    {"field": "total", "condition": "above", "threshold": 60.0, "label": "large total"},
    {"field": "total", "condition": "below", "threshold": 5},
    {"field": "n", "condition": "change_pct", "threshold": 100.0, "label": "count moved"},
    {"field": "total", "condition": "change_pct", "threshold": 250.0, "label": "total moved"},
]
FIELDS = ["n", "total", "last"]
SNAPSHOT = dict(source="event_type", snapshot="day", key="user_id")


def snapshots(spark, sf):
    """Per event type and day, one record per user."""
    total = F.sum(F.col("value").cast("decimal(18,2)"))
    return (
        load(spark, sf, "events")
        .groupBy("event_type", F.to_date("ts").alias("day"), "user_id")
        .agg(F.count("*").alias("n"), F.concat(F.lit("$"), total.cast("string")).alias("total"),
             F.max_by("props", F.struct("ts", "event_id")).alias("last"))
    )


def _arrivals(spark, sf):
    """The snapshots as they come in: a week at a time, where a user's rows may be up to four days behind."""
    at = F.datediff("day", F.lit("2024-01-01").cast("date")) + F.pmod(F.xxhash64("user_id"), F.lit(5))
    rows = materialised(snapshots(spark, sf).withColumn("week", F.floor(at / 7)).withColumn("day", F.col("day").cast("timestamp")), "arrivals")
    weeks = rows.agg(F.min("week"), F.max("week")).first()
    return [rows.where(F.col("week") == w).drop("week").coalesce(1) for w in range(weeks[0], weeks[1] + 1)]


def _keyed(spark, sf):
    """Field changes of single users out of keyed state, over several micro-batches."""
    root = shared_dir(spark, "keyed")
    rows = materialised(snapshots(spark, sf), "daily")
    days = rows.agg(F.min("day"), F.max("day")).first()
    third = (days[1] - days[0]) / 3
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, keyed.PROVIDER)
    try:
        # What came since the last run is one micro-batch, whatever the number of its files.
        for i in range(3):
            low, high = F.col("day") >= days[0] + i * third, F.col("day") < days[0] + (i + 1) * third
            rows.where(low & (high if i < 2 else F.lit(True))).write.mode("append").parquet(f"{root}/input")
            stream = spark.readStream.schema(rows.schema).parquet(f"{root}/input")
            found = keyed.keyed_changes(stream, **SNAPSHOT, value_fields=FIELDS)
            found.writeStream.format("parquet").option("path", f"{root}/changes").option(
                "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(f"{root}/changes").select(
        F.col("source").alias("event_type"), F.to_date("snapshot").alias("snapshot"), "key", "field", "previous", "current", "diff",
        "pct_change", "direction")


def _two(spark, sf):
    """All events in two overlapping spans, where the last event of a user wins."""
    events = load(spark, sf, "events")
    ts = F.col("ts")
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    rows = lambda span: events.where(span).select("user_id", "event_type", "value", "event_id")
    return rows(ts < at("2024-01-17")), rows(ts >= at("2024-01-14"))


TWO = dict(key="user_id", value_fields=["event_type", "value"], position=["event_id"])

QUERIES = {
    "detect_changes": lambda spark, sf: changes.detect_changes(*_two(spark, sf), **TWO),
    "field_changes": lambda spark, sf: changes.field_changes(*_two(spark, sf), **TWO),
    "change_summary": lambda spark, sf: changes.change_summary(*_two(spark, sf), **TWO),
    "check_alerts": lambda spark, sf: changes.check_alerts(
        changes.snapshot_field_changes(snapshots(spark, sf), **SNAPSHOT, value_fields=FIELDS), RULES
    ).select("event_type", "n", "key", "field", "alert", "current", "pct_change"),
    "snapshot_diffs": lambda spark, sf: changes.snapshot_diffs(
        snapshots(spark, sf), **SNAPSHOT, value_fields=FIELDS),
    "snapshot_field_changes": lambda spark, sf: changes.snapshot_field_changes(
        snapshots(spark, sf), **SNAPSHOT, value_fields=FIELDS),
    "snapshot_summaries": lambda spark, sf: changes.snapshot_summaries(
        snapshots(spark, sf), **SNAPSHOT, value_fields=FIELDS),
    "retain_snapshots": lambda spark, sf: changes.retain(snapshots(spark, sf), "event_type", "day", 12),
    "latest_snapshot": lambda spark, sf: changes.latest(snapshots(spark, sf), "event_type", "day"),
    "previous_snapshot": lambda spark, sf: changes.previous(snapshots(spark, sf), "event_type", "day"),
    "field_history": lambda spark, sf: changes.field_history(snapshots(spark, sf), **SNAPSHOT, field="total"),
    "session_summary": lambda spark, sf: changes.session_summary(
        snapshots(spark, sf), **SNAPSHOT, rules=RULES, value_fields=FIELDS, keep=20),
    "watch_stream": lambda spark, sf: watch.replay(
        _arrivals(spark, sf), **SNAPSHOT, value_fields=FIELDS, delay="5 days").select(
            "event_type", F.to_date("snapshot").alias("snapshot"), "key", "field", "previous", "current", "diff", "pct_change", "direction"),
    "keyed_stream": lambda spark, sf: _keyed(spark, sf),
}

_SNAPSHOTS = """s AS (SELECT event_type, ts::DATE AS day, user_id, count(*) AS n,
    '$' || sum(value::DECIMAL(18,2)) AS total, arg_max(props, (ts, event_id)) AS last FROM events GROUP BY ALL),
  idx AS (SELECT event_type, day, row_number() OVER (PARTITION BY event_type ORDER BY day) AS num,
                 count(*) OVER (PARTITION BY event_type) AS last_num FROM (SELECT DISTINCT event_type, day FROM s)),
  r AS (SELECT s.*, num, last_num, user_id::VARCHAR AS key FROM s JOIN idx USING (event_type, day)),
  p AS (SELECT event_type, num + 1 AS num, key, n, total, last FROM r WHERE num < last_num),
  j AS (SELECT coalesce(r.event_type, p.event_type) AS event_type, coalesce(r.num, p.num) AS num,
               coalesce(r.key, p.key) AS key, r.key AS rk, p.key AS pk, r.n::VARCHAR AS cn, p.n::VARCHAR AS pn,
               r.total AS ct, p.total AS pt, r.last AS cl, p.last AS pl
        FROM r FULL OUTER JOIN p ON r.event_type = p.event_type AND r.num = p.num AND r.key = p.key),
  st AS (SELECT event_type, num, key, CASE WHEN pk IS NULL THEN 'added' WHEN rk IS NULL THEN 'removed'
           WHEN cn <> pn OR ct <> pt OR cl <> pl THEN 'changed' ELSE 'unchanged' END AS status FROM j),
  fc AS (SELECT event_type, num, key, 'n' AS field, pn AS previous, cn AS current FROM j WHERE pn <> cn
         UNION ALL SELECT event_type, num, key, 'total', pt, ct FROM j WHERE pt <> ct
         UNION ALL SELECT event_type, num, key, 'last', pl, cl FROM j WHERE pl <> cl)"""


def _changes(rows: str, by: str) -> str:
    return f"""SELECT {by} field, previous, current, {half_up("c - p", 4)} AS diff,
      CASE WHEN p IS NULL OR c IS NULL THEN NULL WHEN p = 0 THEN 0.0 ELSE {half_up("(c - p) / p * 100", 2)} END::DOUBLE AS pct_change,
      CASE WHEN p IS NULL OR c IS NULL THEN 'changed' WHEN c > p THEN 'up' ELSE 'down' END AS direction
    FROM (SELECT *, try_cast(translate(previous, ',$£₹%', '') AS DOUBLE) AS p,
                    try_cast(translate(current, ',$£₹%', '') AS DOUBLE) AS c FROM {rows})"""


_ALERTS = f"""fires AS (SELECT *, try_cast(translate(current, '$', '') AS DOUBLE) AS c FROM ({_changes('fc', 'event_type, num, key,')})),
  alerts AS (SELECT *, 'large total' AS alert FROM fires WHERE field = 'total' AND c > 60
    UNION ALL SELECT *, 'total alert' FROM fires WHERE field = 'total' AND c < 5
    UNION ALL SELECT *, 'count moved' FROM fires WHERE field = 'n' AND abs(pct_change) >= 100
    UNION ALL SELECT *, 'total moved' FROM fires WHERE field = 'total' AND abs(pct_change) >= 250)"""

_TWO = """a AS (SELECT user_id::VARCHAR AS key, count(*) AS k, arg_max(event_type, event_id) AS t, arg_max(value, event_id) AS v
    FROM events WHERE ts < TIMESTAMP '2024-01-17' GROUP BY 1),
  b AS (SELECT user_id::VARCHAR AS key, count(*) AS k, arg_max(event_type, event_id) AS t, arg_max(value, event_id) AS v
    FROM events WHERE ts >= TIMESTAMP '2024-01-14' GROUP BY 1),
  two AS (SELECT coalesce(a.key, b.key) AS key, a.k AS ak, b.k AS bk, a.t AS ta, b.t AS bt, a.v AS av, b.v AS bv,
      CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed'
           WHEN a.t <> b.t OR a.v <> b.v THEN 'changed' ELSE 'unchanged' END AS status
    FROM a FULL OUTER JOIN b ON a.key = b.key)"""

_SUMMARY = """count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed,
  count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged_count,
  count(*) FILTER (status <> 'unchanged') AS total_changes, count(*) FILTER (status <> 'unchanged') > 0 AS has_changes"""

ORACLES = {
    "detect_changes": f"WITH {_TWO} SELECT key, status, coalesce(bk, ak) AS copies FROM two",
    "field_changes": f"""WITH {_TWO}, tf AS (
        SELECT key, 'event_type' AS field, ta AS previous, bt AS current FROM two WHERE ta <> bt
        UNION ALL SELECT key, 'value', av::VARCHAR, bv::VARCHAR FROM two WHERE av <> bv) """ + _changes("tf", "key,"),
    "change_summary": f"WITH {_TWO} SELECT {_SUMMARY} FROM two",
    "check_alerts": f"""WITH {_SNAPSHOTS}, {_ALERTS}
      SELECT event_type, num AS n, key, field, alert, current, pct_change FROM alerts""",
    "snapshot_diffs": f"WITH {_SNAPSHOTS} SELECT event_type, num AS n, key, status FROM st",
    "snapshot_field_changes": f"WITH {_SNAPSHOTS} " + _changes("fc", "event_type, num AS n, key,"),
    "snapshot_summaries": f"WITH {_SNAPSHOTS} SELECT event_type, num AS n, {_SUMMARY} FROM st GROUP BY 1, 2",
    "retain_snapshots": f"WITH {_SNAPSHOTS} SELECT event_type, day, user_id, n, total, last FROM r WHERE num > last_num - 12",
    "latest_snapshot": f"WITH {_SNAPSHOTS} SELECT event_type, day, user_id, n, total, last FROM r WHERE num = last_num",
    "previous_snapshot": f"WITH {_SNAPSHOTS} SELECT event_type, day, user_id, n, total, last FROM r WHERE num = last_num - 1",
    "field_history": f"""WITH {_SNAPSHOTS} SELECT event_type, day, user_id::VARCHAR AS key, total AS raw,
        translate(total, '$', '')::DOUBLE AS number FROM s""",
    "session_summary": f"""WITH {_SNAPSHOTS}, {_ALERTS},
      t AS (SELECT event_type, least(max(last_num), 20) AS snapshots_taken, max(last_num) AS last_num,
              min(day) AS first_snapshot, max(day) AS latest_snapshot FROM idx GROUP BY 1)
      SELECT event_type, snapshots_taken, first_snapshot, latest_snapshot,
        (SELECT count(*) FROM st WHERE st.event_type = t.event_type AND status <> 'unchanged' AND num > last_num - 20) AS total_changes,
        (SELECT count(*) FROM alerts WHERE alerts.event_type = t.event_type) AS total_alerts FROM t""",
    "watch_stream": f"""WITH {_SNAPSHOTS}, named AS (SELECT fc.*, day AS snapshot FROM fc JOIN idx USING (event_type, num))
      """ + _changes("named", "event_type, snapshot, key,"),
    "keyed_stream": f"""WITH {_SNAPSHOTS}, seen AS (
        SELECT event_type, day AS snapshot, user_id::VARCHAR AS key, n::VARCHAR AS cn, total AS ct, last AS cl,
               lag(n::VARCHAR) OVER w AS pn, lag(total) OVER w AS pt, lag(last) OVER w AS pl
        FROM s WINDOW w AS (PARTITION BY event_type, user_id ORDER BY day)),
      fc2 AS (SELECT event_type, snapshot, key, 'n' AS field, pn AS previous, cn AS current FROM seen WHERE pn <> cn
        UNION ALL SELECT event_type, snapshot, key, 'total', pt, ct FROM seen WHERE pt <> ct
        UNION ALL SELECT event_type, snapshot, key, 'last', pl, cl FROM seen WHERE pl <> cl)
      """ + _changes("fc2", "event_type, snapshot, key,"),
}
