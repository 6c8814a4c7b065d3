"""Field changes of single keys over a stream, without snapshots: state is the last value of each field.

The stream's rows are grouped by source and key; a stateful processor keeps the last
value of every field with a time to live, and gives a row where a value
differs from the one before. Keys that are gone cannot be told from keys that
did not come, so nothing is ever reported as removed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.numeric import quoted
from ..functions.text import value_text
from ..operators.changes import measured

# The processor travels with the task; workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])

# Spark keeps a processor's state in this provider only.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "source string, key string, snapshot string, field string, previous string, current string"


class LastValues(StatefulProcessor):
    """The last value of each field of one key, in one piece of state: all fields of a row are seen together."""

    def __init__(self, fields: Sequence[str], ttl_ms: int | None):
        self.fields, self.ttl_ms = list(fields), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = ", ".join(f"f{i} string" for i in range(len(self.fields)))
        self.last = handle.getValueState("last", schema, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:
        """A key's rows of one micro-batch, in the order of snapshot and position."""
        newest: dict[str, tuple] = {}
        for row in rows:
            snapshot, rank, *values = row[2:]
            if snapshot not in newest or newest[snapshot][0] <= rank:
                newest[snapshot] = rank, values
        known = self.last.get()
        before = tuple(known) if known is not None else None
        found: list[list[Row]] = [[] for _ in self.fields]
        for snapshot, (_, values) in sorted(newest.items()):
            for i, field in enumerate(self.fields):
                if before is not None and before[i] != values[i]:
                    found[i].append(Row(source=key[0], key=key[1], snapshot=snapshot, field=field, previous=before[i], current=values[i]))
            before = tuple(values)
        self.last.update(before)
        for changes in found:
            yield from changes

    def close(self) -> None:
        pass


def keyed_changes(
    stream: DataFrame, source: str, snapshot: str, key: str, value_fields: Sequence[str],
    ttl_ms: int | None = None, position: Sequence[str] = (),
) -> DataFrame:
    """``source, key, snapshot, field, previous, current, diff, pct_change, direction`` of a stream.

    Values are compared as text, null as ``None``. A key's rows must come in the order of
    their snapshots from one micro-batch to the next; within a batch they are put in
    order, and of rows of one snapshot the last by ``position`` counts. ``snapshot``
    must order as its text does (dates, timestamps, equally long numbers). With ``ttl_ms``,
    a value that was not seen for so long is forgotten, and the stream needs a processing-time trigger, as Spark looks through
    such state at every trigger and never finds that all is done. Where the session's state store provider
    is not ``PROVIDER``, Spark raises.
    """
    def text(name: str):
        col, kind = F.col(quoted(name)), stream.schema[name].dataType
        return F.coalesce(F.when(col.isNotNull(), value_text(col, kind)), F.lit("None"))

    rank = F.concat_ws(" ", *[F.lpad(text(p), 24, " ") for p in position])
    rows = stream.where(F.col(quoted(snapshot)).isNotNull()).select(
        text(source).alias("source"), text(key).alias("key"), F.col(quoted(snapshot)).cast("string").alias("snapshot"),
        rank.alias("rank"), *[text(f).alias(f"f{i}") for i, f in enumerate(value_fields)])
    found = rows.groupBy("source", "key").transformWithState(
        LastValues(value_fields, ttl_ms), _OUT, "Append", "None" if ttl_ms is None else "ProcessingTime")
    return measured(found, ["source", "snapshot"])
