"""A corpus made ready for training: five stages, each over all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``.

All stages: null and empty texts are documents without words, which no stage but
mixing drops; repeated rows are rows of their own; columns beside those of
``documents`` are kept under any name; no rows give no rows; texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.llm import severity
from gleanframe.llm.decontaminate import clean_documents
from gleanframe.llm.mixing import mixed_rows, word_count
from gleanframe.llm.ngram_join import one_of_each
from gleanframe.llm.sharding import byte_size, shard
from gleanframe.session import load, materialised

SHARDS = 24


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labelled ones does not reject.

    Without enough labels for any word to tell, all documents stay. Equal texts share their fate.
    """
    model = severity.fit(docs.select("doc_id", "text"), load(spark, sf_dir, "labels"))
    return severity.graded(docs, model).where(~F.col("toxic")).select("row.*")


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Texts without words are no copies of each other. Of rows that share the smallest id one stays.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; an empty benchmark leaves all."""
    return clean_documents(docs, load(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares, by whole documents: as often as their source's budget takes them.

    The null source is one of them. Rows with equal ids stand by their texts; of equal rows it does not matter which is at the cut.
    """
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source",
        word_count(F.col("text")).alias("words"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tie"))
    return mixed_rows(sized, size="words", tie="tie").select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``shard`` and ``slot``: contiguous shards of nearly equal bytes.

    Columns of these two names are replaced. Rows with equal ids are dealt in the order in which they come.
    """
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "doc_id",
                        byte_size(F.col("text")).alias("bytes"))
    return shard(sized, SHARDS, size="bytes").select("row.*", "shard", "slot")


STAGES = [
    ("toxicity", toxicity), ("ngram_join", ngram_join), ("decontamination", decontamination),
    ("mixing", mixing), ("sharding", sharding),
]

# The first stage is a learnt model; the pipeline is tested stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
