"""Benchmark decontamination over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...session import load
from ..decontaminate import benchmark_matches


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = benchmark_matches(docs, load(spark, sf_dir, "benchmark"))
    items = F.array_distinct(F.transform(F.filter("matches", lambda m: m["item_id"].isNotNull()),
                                         lambda m: m["item_id"].cast("string")))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op4_decontamination": op4_decontamination}

ORACLES = {
    "op4_decontamination": r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id,
                     coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
full_windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS size,
                        array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS gram
                 FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM full_windows),
grams AS (SELECT rid, p, size, array_to_string(w[p : p + size - 1], ' ') AS gram
          FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM docs, sizes WHERE len(w) >= size)),
hits AS (SELECT DISTINCT rid, p, size, item_id FROM grams JOIN full_windows USING (size, gram)),
words_hit AS (SELECT rid, count(DISTINCT q) AS n_hit
              FROM (SELECT rid, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT rid, p, size FROM hits)) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words_hit USING (rid) LEFT JOIN found USING (rid)""",
}
