"""Ranked search for every benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ...session import load
from ..ranked import top_documents


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES = {"op12_search": op12_search}

_TERMS = (r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])")

ORACLES = {
    "op12_search": f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
totals AS (SELECT count(*) AS all_docs, sum(len(w))::BIGINT AS all_terms FROM docs WHERE len(w) > 0),
counts AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM docs) GROUP BY rid, t),
holders AS (SELECT t, count(*) AS df FROM counts GROUP BY t),
asked AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark)),
sums AS (SELECT item_id, rid, sum(floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
                                  * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * all_docs) // all_terms))))::BIGINT AS score
         FROM asked JOIN counts USING (t) JOIN holders USING (t) JOIN docs USING (rid), totals GROUP BY item_id, rid),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
           FROM sums JOIN docs USING (rid) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
