"""Personal data and secrets in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...session import load
from ..located import joined, number_of
from ..privacy import private_spans
from ..secrets import secret_spans


def op3_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_spans(load(spark, sf_dir, "documents").select("doc_id", "text"), everywhere=True)
    return found.select(
        "doc_id", *[number_of(F.col("base"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "terms"))).alias("spans"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[number_of(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "random"))).alias("spans"))


QUERIES = {"op3_privacy": op3_privacy, "op9_secrets": op9_secrets}

# Places of matches and the counted models have no short SQL; they are tested against brute force.
ORACLES: dict[str, str] = {}
