"""Pages, CSV and JSON in and out."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import clean_dataframe
from ..operators.reshape import flatten

# Quotes inside a value are doubled, and spaces belong to the value.
_QUOTING = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_pages(spark: SparkSession, path: str, format: str = "parquet", nested: bool = False) -> DataFrame:
    """``page_id, url, html`` from Parquet, or with ``format="html"`` one page per file of a folder or pattern.

    With ``nested`` the files of all folders below count too. Give a pattern of folders rather than of files where there are
    many: folders are listed by tasks, a pattern of files by the driver.
    """
    if format not in ("parquet", "html"):
        raise ValueError("format is parquet or html")
    if format == "parquet":
        return spark.read.parquet(path).select("page_id", "url", "html")
    files = spark.read.option("recursiveFileLookup", nested).text(path, wholetext=True)
    url = F.col("_metadata.file_path")
    return files.select(F.xxhash64(url).alias("page_id"), url.alias("url"), F.col("value").alias("html"))


def _is_local(spark: SparkSession, path: str) -> bool:
    """Whether a path is in a folder that tasks reach by plain file calls."""
    scheme = urlsplit(path).scheme
    if not scheme:
        try:
            scheme = urlsplit(spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///").scheme
        except Exception:
            # No access to the session's settings: left to Spark.
            return False
    return scheme == "file"


def write_pages(pages: DataFrame, path: str) -> None:
    """``page_id, html`` as a file a page below ``path/part=*``; a null page is empty. Each ends with a line break.

    Every task has a folder of its own, which is committed with one rename and listed as one. Pages of equal ids are files of
    their own; a file's path holds ``page_id=`` and the id. In a local or mounted folder files are written by plain calls: Spark's writer
    starts several processes a file there to set its mode.
    """
    source = pages.select(F.col("page_id").cast("long"), F.coalesce("html", F.lit("")).alias("html"))
    if not _is_local(pages.sparkSession, path):
        source.withColumn("part", F.spark_partition_id()).write.partitionBy("part", "page_id").option("maxRecordsPerFile", 1).text(path)
        return
    folder = unquote(urlsplit(path).path) if urlsplit(path).scheme else path

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        own = f"{folder}/_part-{context.partitionId()}-{context.taskAttemptId()}"
        written = 0
        for batch in batches:
            os.makedirs(own, exist_ok=True)
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(f"{own}/page_id={'' if page_id is None else page_id}.{written}.txt", "xb") as file:
                    file.write(html + b"\n")
                written += 1
        if written:
            try:
                os.rename(own, f"{folder}/part={context.partitionId()}")
            except OSError:
                # Another attempt of this task has committed; its files are the same pages.
                if not os.path.isdir(f"{folder}/part={context.partitionId()}"):
                    raise
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["written"])

    if os.path.exists(folder):
        raise FileExistsError(path)
    os.makedirs(folder)
    source.select("page_id", F.col("html").cast("binary")).mapInArrow(write, "written long").agg(F.sum("written")).collect()


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, clean: bool = False,
             multi_line: bool = True) -> DataFrame:
    """A CSV file with a header row; give ``schema`` to spare the pass that infers types.

    Values may hold quotes, commas and line breaks. A file is then one task;
    ``multi_line=False`` splits large files whose values have no line breaks.
    Empty values are null.
    """
    reader = spark.read.options(header=True, multiLine=multi_line, **_QUOTING)
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path, inferSchema=True)
    return clean_dataframe(df) if clean else df


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON Lines, one record per line with its nulls; part files are written in parallel."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, flat: bool = True, mode: str = "errorifexists",
              map_keys: Mapping[str, Sequence[str]] | None = None) -> None:
    """CSV part files with a header each, nested columns flattened; ``read_csv`` reads them back."""
    (flatten(df, map_keys=map_keys) if flat else df).write.mode(mode).options(header=True, **_QUOTING).csv(path)
