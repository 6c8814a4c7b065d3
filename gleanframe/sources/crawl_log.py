"""Freshness of a log of fetched pages, ``key, ts, payload``."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import comparable

# Fixed value: seconds an entry stays fresh.
TTL = 3600


def _cutoff(log: DataFrame, ts: str, as_of: datetime, ttl: float) -> Column:
    limit = (as_of - timedelta(seconds=ttl)).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(limit).cast(log.schema[ts].dataType)


def fresh_rows(log: DataFrame, as_of: datetime, ttl: float = TTL, key: str = "url", ts: str = "ts") -> DataFrame:
    """The newest row of each key, where it is at most ``ttl`` seconds old.

    Stale rows are filtered in the scan: the newest row of a key is fresh
    exactly if the key has a fresh row. The newest is picked by an aggregate
    combined on the map side.
    """
    fresh = log.where(F.col(ts) >= _cutoff(log, ts, as_of, ttl))
    newest = F.max_by(F.struct(*log.columns), F.struct(F.col(ts), *comparable(log, log.columns)))
    return fresh.groupBy(F.col(key).alias("__key")).agg(newest.alias("row")).select("row.*")


def freshness_stats(
    log: DataFrame, as_of: datetime, ttl: float = TTL, ts: str = "ts", payload: str = "payload"
) -> DataFrame:
    """Totals of the log; an entry without a readable time counts as expired."""
    valid = F.count_if(F.col(ts) >= _cutoff(log, ts, as_of, ttl))
    return log.agg(
        F.count("*").alias("total_entries"),
        valid.alias("valid_entries"),
        (F.count("*") - valid).alias("expired_entries"),
        F.coalesce(F.sum(F.octet_length(payload)), F.lit(0)).cast("long").alias("size_bytes"),
    )
