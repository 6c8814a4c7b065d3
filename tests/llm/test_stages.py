"""Each stage of the pipeline against plain Python, on a table with enough labels and every edge case."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_operators import brute_classes, prose

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, row string, words long, tie string"
PASSAGE = " ".join(f"bench{i}" for i in range(14))


def made():
    draw = random.Random(2)
    texts = []
    for i in range(240):
        bad = i % 6 == 0
        texts.append(prose(i + 20, 40) + (" idiot scum" + " trash" * (i % 3) if bad else ""))
    texts += [None, "", "...", "one", prose(501, 3000)]
    texts += [prose(700, 60), prose(700, 60), prose(700, 59) + " edit", "start " + PASSAGE + " end", PASSAGE[:40]]
    rows = [(i, t, "en", draw.choice(["a", "a", "a", "b", None]), 1, 9, "r", 2, "t") for i, t in enumerate(texts)]
    return rows + [rows[30], (None, prose(900, 30), None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame([(i, i % 2, int(i % 6 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(
        f"{root}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def docs(spark, rows=None):
    return spark.createDataFrame(made() if rows is None else rows, SCHEMA)


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


def test_toxic_documents_go_and_clean_ones_stay(spark, tables):
    out = pipeline.toxicity(spark, docs(spark), tables)
    assert out.columns == docs(spark).columns
    assert ids(out) == sorted((r[0] for r in made() if not (r[1] and "idiot" in r[1])), key=str)


def test_one_of_each_group_of_near_copies_stays(spark, tables):
    rows = made()
    first = brute_classes([r[1] for r in rows])
    lowest = {}
    for position, root, _ in first:
        key = rows[position][0]
        lowest.setdefault(root, []).append(key if key is not None else float("inf"))
    out = pipeline.ngram_join(spark, docs(spark), tables)
    expected = [None if min(v) == float("inf") else min(v) for v in lowest.values()]
    assert ids(out) == sorted(expected, key=str) and out.columns == docs(spark).columns


def test_benchmark_passages_go(spark, tables):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())

    item = words(PASSAGE)
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    dirty = {r[0] for r in made() if any(tuple(words(r[1])[i : i + 10]) in windows for i in range(len(words(r[1]))))}
    assert dirty == {248}
    out = pipeline.decontamination(spark, docs(spark), tables)
    assert ids(out) == sorted((r[0] for r in made() if r[0] not in dirty), key=str)


def test_sources_meet_their_targets_by_whole_documents(spark, tables):
    rows = made()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in ("a", "b", None)}
    weights, limits = {"a": 3, "b": 1, None: 2}, {s: 2 * n for s, n in totals.items()}
    targets, left, open_ones = {}, 1.5 * sum(totals.values()), set(totals)
    while open_ones:
        share = left / sum(weights[s] for s in open_ones)
        full = {s for s in open_ones if weights[s] * share >= limits[s]}
        for s in full or open_ones:
            targets[s] = limits[s] if full else weights[s] * share
        left -= sum(targets[s] for s in full)
        open_ones = open_ones - full if full else set()
    out = pipeline.mixing(spark, docs(spark), tables)
    assert out.columns == docs(spark).columns
    taken, copies = {}, {}
    for r in out.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + size(r["text"])
        copies[r["doc_id"], r["text"]] = copies.get((r["doc_id"], r["text"]), 0) + 1
    largest = max(size(r[1]) for r in rows)
    for s in totals:
        assert abs(taken[s] - targets[s]) <= largest
    for r in rows:
        whole = int(targets[r[3]] // totals[r[3]])
        assert copies.get((r[0], r[1]), 0) >= whole * sum(x == r for x in rows)


def test_shards_are_contiguous_and_even(spark, tables):
    out = pipeline.sharding(spark, docs(spark), tables)
    assert out.columns == [c for c in docs(spark).columns if c != "shard"] + ["shard", "slot"]
    rows = out.collect()
    assert len(rows) == len(made())
    size = lambda r: len((r["text"] or "").encode()) + 8
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert keys == sorted(keys)
    total, before = sum(map(size, rows)), 0
    for r in ordered:
        # The shard in which the middle of the row's bytes falls.
        assert r["shard"] == min(23, (2 * before + size(r)) * 24 // (2 * total))
        before += size(r)
    for s in {r["shard"] for r in rows}:
        assert [r["slot"] for r in ordered if r["shard"] == s] == list(range(sum(r["shard"] == s for r in rows)))


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_no_rows(spark, tables, name, stage):
    assert stage(spark, docs(spark, []), tables).count() == 0


def test_extra_columns_keep_their_values(spark, tables):
    out = pipeline.sharding(spark, pipeline.mixing(spark, docs(spark).where(F.col("doc_id") < 9), tables), tables)
    assert {(r["row"], r["words"], r["tie"]) for r in out.collect()} == {("r", 2, "t")}
