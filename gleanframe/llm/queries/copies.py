"""Near copies, repeated passages and close vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ...session import load
from ..ngram_join import near_classes
from ..passages import repeated_passages
from ..vector_copies import close_vectors


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return close_vectors(load(spark, sf_dir, "embeddings"))


QUERIES = {"op1_ngram_join": op1_ngram_join, "op5_passages": op5_passages, "op10_vector_copies": op10_vector_copies}

ORACLES = {
    "op1_ngram_join": r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id,
                               coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
grams AS (SELECT DISTINCT rid, doc_id, array_to_string(w[p : p + 4], ' ') AS g
          FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM docs WHERE len(w) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM grams GROUP BY rid),
pairs AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT rid AS a, rid AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links
FROM docs JOIN (SELECT reach.a AS rid, min(d.doc_id) AS class_id FROM reach JOIN docs d ON d.rid = reach.b GROUP BY 1) USING (rid)
LEFT JOIN (SELECT a AS rid, count(*) AS n FROM links GROUP BY 1) USING (rid)""",
    "op10_vector_copies": """
WITH RECURSIVE vecs AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
usable AS (SELECT * FROM vecs WHERE label IS NOT NULL AND len(v) > 0 AND list_count(v) = len(v)
           AND len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.rid AS a, b.rid AS b FROM usable a JOIN usable b
          ON a.label = b.label AND a.rid <> b.rid AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT rid AS a, rid AS b FROM vecs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lowest AS (SELECT reach.a AS rid, min(v.vec_id) AS component_id FROM reach JOIN vecs v ON v.rid = reach.b GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM vecs JOIN lowest USING (rid) LEFT JOIN (SELECT a AS rid, count(*) AS n FROM links GROUP BY 1) USING (rid)""",
    "op5_passages": r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w
              FROM documents),
spots AS (SELECT rid, p, md5(array_to_string(w[p : p + 34], ' ')) AS h
          FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS p FROM docs WHERE len(w) >= 35)),
twice AS (SELECT h FROM spots GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + 35)) AS q FROM spots SEMI JOIN twice USING (h)),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY q) AS words, count(*) AS n
         FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM docs) ANTI JOIN gone USING (rid, q) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(words, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)""",
}
