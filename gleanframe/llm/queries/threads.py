"""The prefix trie of all conversations, rebuilt so that they share first turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...session import load, materialised
from ..turn_tries import numbered_turns, prefix_nodes

# Every conversation of a run of ids takes up to three first turns of the run's first one.
RUN = 20
HEADS = 4


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and members of the rebuilt conversations, as ``prefix_nodes`` takes them."""
    turns = materialised(numbered_turns(conversations), "numbered")
    counts = materialised(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "counts")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    named = counts.withColumn("h", taken).withColumn("base", F.col("conv_id") - F.col("conv_id") % RUN)
    there = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    heads = F.least("h", F.coalesce("n_base", F.lit(0)))
    plan = materialised(named.join(there, "base", "left").select(
        "conv_id", "base", "h", heads.alias("heads"), (heads + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("n_turns")), "plan")
    first = turns.where((F.col("pos") < HEADS - 1) & (F.col("conv_id") % RUN == 0)).withColumnRenamed("conv_id", "base")
    shared = plan.select("conv_id", "base", "h").join(first, "base").where(F.col("pos") < F.col("h"))
    own = turns.join(plan.select("conv_id", "h", "heads"), "conv_id").where(F.col("pos") >= F.col("h")).withColumn(
        "pos", F.col("pos") - F.col("h") + F.col("heads"))
    columns = ["conv_id", "pos", "a", "b", "words"]
    return shared.select(*columns).unionByName(own.select(*columns)), plan.select("conv_id", "n_turns")


def op13_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_nodes(*rebuilt(load(spark, sf_dir, "conversations")))


QUERIES = {"op13_threads": op13_threads}

# DuckDB has no CRC-32: a table of its 256 steps, made by shifting.
_SHIFT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
ORACLES = {
    "op13_threads": rf"""
WITH crc AS (SELECT list(e ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: {_SHIFT}) AS e FROM range(256) r(i))),
turns AS (SELECT conv_id, role, text, row_number() OVER (
              PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text)) - 1 AS pos
          FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
              [4294967295]::BIGINT[] || list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
              lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 4 AS h
          FROM (SELECT DISTINCT conv_id FROM turns), crc),
parts AS (SELECT c.conv_id, 0 AS own, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < h
          UNION ALL SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= h),
seqs AS (SELECT conv_id, coalesce(s, []) AS s FROM convs LEFT JOIN (
             SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY own, pos) AS s FROM parts GROUP BY conv_id) USING (conv_id)),
nodes AS (SELECT s[1 : d] AS p, d, min(conv_id) AS conv_id, count(*) AS n,
                 coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '') AS ends
          FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seqs) GROUP BY 1, 2),
kids AS (SELECT p[1 : d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
facts AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children,
                 CASE WHEN nodes.d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(nodes.p[nodes.d].text, '[^\x20\x09-\x0D]+')) END AS saved
          FROM nodes LEFT JOIN kids ON kids.d = nodes.d AND kids.p = nodes.p),
sums AS (SELECT x.p, x.d, count(*) FILTER (y.n_children = 0) AS n_leaves, sum(y.saved) AS saved
         FROM facts x JOIN facts y ON y.d >= x.d AND y.p[1 : x.d] = x.p GROUP BY 1, 2)
SELECT f.conv_id, f.d::BIGINT AS depth, parent.conv_id AS parent_conv_id, f.n::BIGINT AS n_convs,
       f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens,
       sha256(f.ends) AS ends_sha256
FROM facts f JOIN sums ON sums.d = f.d AND sums.p = f.p
LEFT JOIN facts parent ON parent.d = f.d - 1 AND parent.p = f.p[1 : f.d - 1]""",
}
