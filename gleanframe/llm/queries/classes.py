"""Language and toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...session import load
from .. import language, severity


def _held_out() -> Column:
    """A quarter of the ids, by their checksum, is never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = language.fit(docs.where(~_held_out()).select("doc_id", "text", "lang"))
    found = language.identified(docs.select("doc_id", "text", _held_out().alias("held_out")), model)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", "accepted")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = severity.fit(docs, load(spark, sf_dir, "labels"))
    found = severity.graded(docs, model)
    return found.select("row.doc_id", "severity", "expected_severity", "p_toxic", "toxic")


QUERIES = {"op2_language": op2_language, "op7_toxicity": op7_toxicity}

# Learnt models have no SQL; they are tested on held-out rows.
ORACLES: dict[str, str] = {}
