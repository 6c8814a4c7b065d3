"""Mixing and sharding over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...session import load
from ..mixing import mix, word_count
from ..sharding import byte_size, shard

SHARDS = 24


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tie"))
    return mix(docs, tie="tie").select("doc_id", "size", "source_size", "target", "taken")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", byte_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    dealt = shard(docs, SHARDS, order=("doc_id", "size", "text_crc32"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_mixing": op6_mixing, "op8_sharding": op8_sharding}

# Sharding has none: DuckDB has no CRC-32.
ORACLES = {
    "op6_mixing": r"""
WITH docs AS (SELECT doc_id, source, len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])) AS size,
                     coalesce(md5(doc_id::VARCHAR), '') AS k, md5(coalesce(text, '')) AS tie FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size,
                 [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w
          FROM docs GROUP BY source),
totals AS (SELECT 1.5::DOUBLE * sum(source_size) AS total, sum(w) AS all_w FROM sizes),
levels AS (SELECT source, source_size, w, 2 * source_size AS c,
                  coalesce(sum(2 * source_size) OVER earlier, 0) AS c_before, coalesce(sum(w) OVER earlier, 0) AS w_before
           FROM sizes WINDOW earlier AS (ORDER BY 2 * source_size / w::DOUBLE, source IS NULL, source
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT levels.*, c / w::DOUBLE <= (total - c_before) / (all_w - w_before) AS stopped, total, all_w
           FROM levels, totals),
rates AS (SELECT (any_value(total) - coalesce(sum(c) FILTER (stopped), 0))
                 / (any_value(all_w) - coalesce(sum(w) FILTER (stopped), 0)) AS rate FROM marked),
targets AS (SELECT source, source_size, CASE WHEN stopped THEN c::DOUBLE ELSE w * rate END AS target FROM marked, rates),
placed AS (SELECT docs.*, source_size, target,
                  coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY k, tie
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS front
           FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source),
cut AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS epochs FROM placed)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - front)))::BIGINT AS taken
FROM cut""",
}
