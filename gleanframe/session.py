"""Session defaults, table loading and shared-folder lookup."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cpus: int | str = "*", app: str = "gleanframe", **extra: str) -> SparkSession:
    """Session for tests and benches; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        **SESSION_DEFAULTS,
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        **extra,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Bytes of a table's files that one task of a spread table takes.
SPREAD_BYTES = 1024 * 1024
# Groups of rows that a task of a dealt table has.
DEALS = 16


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread_tasks(df: DataFrame) -> int | None:
    """Tasks of about ``SPREAD_BYTES`` of a table's files, at least one a core; ``None`` where its size is not told."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return None
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES))


def load_spread(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table dealt out to tasks of about ``SPREAD_BYTES``, and to all cores when it is small.

    For heavy work per row: a file may have few or large row groups, and would be few tasks that grow with
    the table. Rows are dealt by their place in the file, which is even and, unlike dealing in turns,
    needs no sort of what a task has read; a task that runs again deals them alike.
    """
    df = load(spark, sf_dir, table)
    tasks = spread_tasks(df)
    return df if tasks is None else df.repartition(tasks, F.monotonically_increasing_id())


def load_by_key(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """``load_spread`` with rows dealt by a column of many values, such as an id.

    What is grouped or joined by this column alone, or by it and others, then needs no further shuffle.
    """
    df = load(spark, sf_dir, table)
    tasks = spread_tasks(df)
    return df.repartition(key) if tasks is None else df.repartition(tasks, key)


def load_dealt(spark: SparkSession, sf_dir: str, table: str, deal: str) -> tuple[DataFrame, int | None]:
    """``load_spread`` with a column ``deal`` that its rows are dealt by, and the number of its tasks.

    Rows of one deal are in one task, so that they can be grouped by it without a shuffle. A task has about
    ``DEALS`` of them, as one each would come out uneven.
    """
    df = load(spark, sf_dir, table)
    tasks = spread_tasks(df)
    place = F.monotonically_increasing_id()
    if tasks is None:
        return df.withColumn(deal, place).repartition(deal), None
    return df.withColumn(deal, place % (DEALS * tasks)).repartition(tasks, deal), tasks


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Every executor has to reach it. Where the setting is absent, a temporary
    folder is taken if driver and tasks share one machine (tests); a cluster
    without the setting raises, as its executors would each write to their own
    disk and a later read would miss rows.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="gleanframe-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For an intermediate result that several jobs read: its lineage is run
    once, and the copy outlives the executors that wrote it.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
