"""Licence wording in all documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...session import load
from ..license_wording import BASE_PHRASES, WORDINGS
from ..licenses import TEMPLATES, license_matches

# A wording of this many mandatory words counts one half.
HALF = 4


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_matches(load(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("matches", lambda m: m["base"])
    longest = F.array_max(F.transform("matches", lambda m: m["mandatory"]))

    def labels(matches: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["first"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(longest / (longest + HALF), F.lit(0.0)).alias("score"))


QUERIES = {"op11_licenses": op11_licenses}


def _pattern(wording: str) -> str:
    """A wording as a regular expression over words that each follow a blank."""
    parts = []
    for mark, most, word in re.findall(r"<<(optional|end|any:(\d+))>>|([^\s<]+)", wording):
        parts.append(f" {word}" if word else "(?:" if mark == "optional" else ")?" if mark == "end" else f"(?: [^ ]+){{0,{most}}}")
    return "".join(parts)


def _phrase(words: list[str]) -> str:
    return " AND ".join(f"w[p{f' + {i}' if i else ''}] = '{x}'" for i, x in enumerate(words))


_WORDING = ", ".join(f"('{t.label}', {t.mandatory}, '{_pattern(t.wording)}( |$)')" for t in TEMPLATES)
_BASE = " UNION ALL ".join(
    f"SELECT rid, p, '{label}' AS label FROM spots WHERE {_phrase(phrase.split())}" for phrase, label in BASE_PHRASES.items())

ORACLES = {
    "op11_licenses": rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id,
                     coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
spots AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM docs),
places AS ({_BASE}),
base AS (SELECT rid, count(*) AS n, min(p) - 1 AS low, max(p) - 1 AS high,
                array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM places GROUP BY rid),
wordings(label, mandatory, pattern) AS (VALUES {_WORDING}),
found AS (SELECT rid, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(mandatory) AS m
          FROM docs JOIN wordings ON regexp_matches(' ' || array_to_string(w, ' '), pattern) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, low::BIGINT AS first_word,
       high::BIGINT AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(found.labels, '') AS labels,
       coalesce(m / (m + {HALF})::DOUBLE, 0)::DOUBLE AS score
FROM docs LEFT JOIN base USING (rid) LEFT JOIN found USING (rid)""",
}
assert set(WORDINGS).isdisjoint(BASE_PHRASES.values())
