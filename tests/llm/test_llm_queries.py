"""Registered training-data queries against DuckDB, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from compare import compare, duck
from gleanframe.llm.queries import ORACLES, QUERIES
from gleanframe.session import load, materialised

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, name):
    ok, note = compare(spark, duck(SF_DIR), SF_DIR, name, QUERIES[name], ORACLES[name])
    assert ok, note


def test_one_query_each():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in QUERIES


def test_stages(spark):
    """Each stage is held against what its operator's own query or rule says of its input."""
    docs = load(spark, SF_DIR, "documents")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialised(stage(spark, docs, SF_DIR), name)
        kept.append(docs.count())
        if name != "sharding":
            assert docs.columns == before.columns
            assert docs.join(before, ["doc_id", "text"], "left_anti").count() == 0
        if name == "ngram_join":
            from gleanframe.llm.ngram_join import near_classes

            assert near_classes(docs.select("doc_id", "text")).where("n_links > 0").count() == 0
            assert docs.count() == near_classes(before.select("doc_id", "text")).select("class_id").distinct().count()
        if name == "decontamination":
            from gleanframe.llm.decontaminate import benchmark_matches

            hit = benchmark_matches(before, load(spark, SF_DIR, "benchmark")).where("n_hit > 0").count()
            assert docs.count() == before.count() - hit
    assert kept[-1] == kept[-2]
    rows = docs.groupBy("shard").agg({"slot": "max", "doc_id": "count"}).collect()
    assert all(r["max(slot)"] + 1 == r["count(doc_id)"] for r in rows)


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF_DIR).columns[-2:] == ["shard", "slot"]
