"""Continuous change tracking over a stream of snapshots.

Rows of a snapshot may come split over many micro-batches and in any order. They are
gathered per source, snapshot and key in Spark's streaming state (the last record of
a key and its number of rows), and a snapshot is closed when the watermark passes
it: when a snapshot has come that is newer by more than ``delay``. Closed
snapshots leave the state and go, whole, to the comparison; rows of a closed
snapshot that come later still are dropped by the watermark and counted by Spark.

The comparison of one micro-batch takes its closed snapshots with each other and the
first one of a source with the newest one stored, appends changes, alerts
and summaries, and writes the newest snapshot of every source. The store has two
slots: a batch reads the one that an earlier batch wrote and overwrites the other,
so a batch that runs twice gives the same, a lost executor or a restarted query loses nothing, and
no more than one older generation is kept.

Layout below ``path``: ``state/slot=0|1``, ``incoming`` and ``numbers`` (overwritten by
each batch), and ``changes``, ``alerts``, ``summaries`` and ``late`` by batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.numeric import quoted
from ..operators import changes as C
from ..session import shared_dir

COPIES = "__copies"


class SnapshotWatch:
    """The work of one micro-batch of whole snapshots, usable as a ``foreachBatch`` function.

    A batch rewrites the newest snapshot of every source, one pass without a shuffle.
    Rows without a source or snapshot are left out.
    Snapshots that are not newer than the stored one of their source go to ``late``.
    ``copies`` names a column that says for how many rows of its key a row stands.
    """

    def __init__(
        self, path: str, source: str, snapshot: str, key: str, value_fields: Sequence[str],
        rules: Sequence[dict] = (), position: Sequence[str] = (), copies: str | None = None,
    ):
        self.path = path
        self.source, self.snapshot, self.key = source, snapshot, key
        self.fields, self.rules, self.position = list(value_fields), list(rules), list(position)
        self.copies = copies
        self.columns = list(dict.fromkeys([source, snapshot, key, *self.fields, *self.position, *([copies] if copies else [])]))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = F.col(quoted(self.source)).isNotNull() & F.col(quoted(self.snapshot)).isNotNull()
        rows = batch.where(known).select(*[quoted(c) for c in self.columns])
        # The batch is read several times below; write it once instead of
        # running its lineage again or holding it in executor memory.
        rows = self._written(rows, "incoming")
        if rows.isEmpty():
            return
        slot, state = self._state(spark, batch_id, rows.schema)
        stored = None
        if state is not None:
            stored = state.join(rows.select(self.source).distinct(), self.source, "left_semi")
            rows = self._in_time(rows, stored, batch_id)
        both = rows if stored is None else rows.unionByName(stored)
        index = self._written(C.snapshot_numbers(both, self.source, self.snapshot), "numbers")
        paired = C.paired_snapshots(both, self.source, self.snapshot, self.key, self.fields, self.position, index, self.copies)
        names = index.select(F.col("__source").alias(self.source), "n", F.col("__snapshot").alias("snapshot"))
        if stored is not None:
            # The stored snapshot was reported when it arrived.
            known = stored.select(self.source).distinct().withColumn("seen", F.lit(True))
            names = names.join(known, self.source, "left").where(F.col("seen").isNull() | (F.col("n") > 1)).drop("seen")
        by = [self.source, "n"]
        found = C.changed_fields(paired, by, self.fields).join(names, by).drop("n")
        found = self._written(found, "changes", batch_id)
        if self.rules:
            self._written(C.check_alerts(found, self.rules), "alerts", batch_id)
        self._written(C.summarised(paired, by, self.fields).join(names, by).drop("n"), "summaries", batch_id)
        newest = C.latest(both, self.source, self.snapshot, index=index)
        if state is not None:
            newest = newest.unionByName(state.join(rows.select(self.source).distinct(), self.source, "left_anti"))
        self._written(newest.withColumn("__batch", F.lit(batch_id).cast("long")), f"state/slot={slot}")

    def _in_time(self, rows: DataFrame, stored: DataFrame, batch_id: int) -> DataFrame:
        """The rows of new snapshots; the others are written to ``late``."""
        newest = stored.groupBy(self.source).agg(F.max(self.snapshot).alias("__newest"))
        marked = rows.join(newest, self.source, "left")
        own = [quoted(c) for c in self.columns]
        self._written(marked.where(F.col(self.snapshot) <= F.col("__newest")).select(*own), "late", batch_id)
        new = F.col("__newest").isNull() | (F.col(self.snapshot) > F.col("__newest"))
        return marked.where(new).select(*own)

    def _written(self, df: DataFrame, table: str, batch_id: int | None = None) -> DataFrame:
        target = f"{self.path}/{table}" + ("" if batch_id is None else f"/batch_id={batch_id}")
        df.write.mode("overwrite").parquet(target)
        return df.sparkSession.read.schema(df.schema).parquet(target)

    def _state(self, spark: SparkSession, batch_id: int, schema: T.StructType) -> tuple[int, DataFrame | None]:
        """The slot to write, and the newest snapshots as an earlier batch left them in the other."""
        full = T.StructType([*schema.fields, T.StructField("__batch", T.LongType())])
        held = {}
        for slot in (0, 1):
            try:
                table = spark.read.schema(full).parquet(f"{self.path}/state/slot={slot}")
                held[slot] = table.agg(F.max("__batch")).first()[0], table
            except AnalysisException:  # never written
                continue
        earlier = {s: (b, t) for s, (b, t) in held.items() if b is not None and b < batch_id}
        if not earlier:
            return 0, None
        slot = max(earlier, key=lambda s: earlier[s][0])
        return 1 - slot, earlier[slot][1].drop("__batch")

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.option("basePath", f"{self.path}/{table}").parquet(f"{self.path}/{table}").drop("batch_id")


def closed_snapshots(
    stream: DataFrame, source: str, snapshot: str, key: str, value_fields: Sequence[str], delay: str,
    position: Sequence[str] = (),
) -> DataFrame:
    """The stream's snapshots once they are closed, one row a key: its last record and ``__copies``, its rows.

    ``snapshot`` must be a timestamp; its watermark is ``delay`` behind the newest one
    seen. The state holds one row a key of each open snapshot. A row whose source is
    null belongs to no snapshot and only moves the watermark on.
    """
    fields = list(dict.fromkeys([*value_fields, *position]))
    row = F.struct(*[F.col(quoted(c)) for c in fields])
    rank = F.struct(*[F.col(quoted(p)) for p in position], row)
    last = stream.withWatermark(snapshot, delay).groupBy(source, snapshot, key).agg(
        F.max_by(row, rank).alias("__row"), F.count("*").alias(COPIES))
    # Not filtered here: Spark would drop the rows without a source before they move the watermark.
    return last.select(
        source, snapshot, key, *[F.col("__row")[f].alias(f) for f in fields], COPIES)


def watch(stream: DataFrame, job: SnapshotWatch, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start tracking a stream whose micro-batches hold whole snapshots, as ``closed_snapshots`` gives them."""
    return (
        stream.writeStream.foreachBatch(job)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start()
    )


def replay(
    parts: Sequence[DataFrame], source: str, snapshot: str, key: str, value_fields: Sequence[str], delay: str,
    rules: Sequence[dict] = (), position: Sequence[str] = (),
) -> DataFrame:
    """Send tables through the stream, at least one micro-batch each, and return its changes.

    Snapshots may be split between the tables, as long as rows come within
    ``delay`` of the newest one. A last row of no source closes what is still open.
    """
    spark = parts[0].sparkSession
    root = shared_dir(spark, "watch")
    for part in parts:
        part.write.mode("append").parquet(f"{root}/input")
    newest = spark.read.schema(parts[0].schema).parquet(f"{root}/input").agg(F.max(snapshot).alias("at"))
    closing = newest.select(*[
        (F.col("at") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 SECOND") if c.name == snapshot else F.lit(None)).cast(c.dataType).alias(c.name)
        for c in parts[0].schema.fields])
    closing.write.mode("append").parquet(f"{root}/input")
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/input")
    job = SnapshotWatch(f"{root}/store", source, snapshot, key, value_fields, rules, position, COPIES)
    query = watch(closed_snapshots(stream, source, snapshot, key, value_fields, delay, position), job,
                  f"{root}/checkpoint", {"availableNow": True})
    query.awaitTermination()
    return job.read(spark, "changes")
