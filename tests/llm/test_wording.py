"""Licence templates against a plain matcher, with every edge case of the texts."""

import random

import pytest
from pyspark.sql import functions as F

from gleanframe.llm.licenses import TEMPLATES, Automaton, Template, license_matches
from gleanframe.llm.queries.wording import op11_licenses

SMALL = [Template("plain", "mit license", True), Template("opt", "a <<optional>> b c <<end>> d"),
         Template("any", "a <<any:2>> d"), Template("nested", "<<optional>> x <<optional>> y <<end>> <<end>> z")]


def ways(wording):
    """All runs a wording accepts, with None for a free word."""
    def read(tokens):
        runs = [()]
        while tokens:
            token = tokens.pop(0)
            if token == "<<end>>":
                return runs
            if token == "<<optional>>":
                inner = read(tokens)
                runs = [r + i for r in runs for i in [(), *inner]]
            elif token.startswith("<<any:"):
                runs = [r + (None,) * k for r in runs for k in range(int(token[6:-2]) + 1)]
            else:
                runs = [r + (token,) for r in runs]
        return runs
    return read(wording.split())


def brute(words, templates):
    found = []
    for start in range(len(words)):
        for t in templates:
            ends = [start + len(w) for w in ways(t.wording) if start + len(w) <= len(words)
                    and all(x is None or x == y for x, y in zip(w, words[start:]))]
            if ends:
                found.append((start, max(ends), t.label))
    return found


def test_random_texts(spark):
    draw = random.Random(7)
    texts = [" ".join(draw.choice("a b c d x y z mit license other".split()) for _ in range(draw.randrange(0, 40))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)], "doc_id long, text string, matches string, n_words int")
    rows = {r["row"]["doc_id"]: r for r in license_matches(docs, SMALL).collect()}
    for i, text in enumerate(texts):
        got = [(m["first"], m["end"], m["label"]) for m in rows[i]["matches"]]
        assert got == brute(text.split(), SMALL) and rows[i]["n_words"] == len(text.split())


def test_edge_texts(spark, tmp_path):
    long_text = "word " * 300_000 + "GNU General-Public\nLICENSE, version 3"
    texts = [None, "", "...", "MIT Licenses", "The MIT License!", "the mit license", "Éapache license", long_text, "mit", "CC BY-NC 4.0"]
    rows = [(None if i == 5 else i, t, "x") for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = op11_licenses(spark, str(tmp_path)).collect()
    of = {r["doc_id"]: r for r in found}
    assert len(found) == 11 and of[0]["n_words"] == of[1]["n_words"] == of[2]["n_words"] == 0
    assert of[0]["first_word"] is None and of[0]["score"] == 0 and of[0]["labels"] == ""
    assert of[3]["base_labels"] == "" and of[4]["base_labels"] == "mit" and of[None]["base_labels"] == "mit"
    assert of[6]["n_base"] == 0 and of[8]["n_base"] == 0
    assert (of[7]["first_word"], of[7]["labels"], of[7]["n_words"]) == (300_000, "gpl,gpl-3.0", 300_006)
    assert of[9]["labels"] == "cc-by,cc-by-nc-4.0"
    assert sum(r["doc_id"] == 4 for r in found) == 2


def test_no_rows(spark):
    assert license_matches(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mandatory_wording_must_be_exact():
    notice = next(t for t in TEMPLATES if t.label == "mit-notice")
    assert notice.mandatory > 30
    plain = [w for w in notice.wording.replace("<<any:2>>", "Software").split() if "<<" not in w]
    machine = Automaton([notice])

    def accepted(words):
        numbers = [machine.vocabulary.index(w) + 1 if w in machine.vocabulary else 0 for w in words]
        import numpy as np
        return len(machine.matches(np.array(numbers), np.full(len(numbers), len(numbers)))[0])

    assert accepted(plain) == 1 and accepted([w for w in plain if w != "hereby"]) == 0


@pytest.mark.parametrize("wording", ["<<any:2>>", "a <<optional>> b", "Upper"])
def test_bad_markup_raises(wording):
    with pytest.raises(ValueError):
        Automaton([Template("t", wording)])


def test_query_columns(spark):
    assert [c for c, _ in op11_licenses(spark, "/root/testdata/sf0.001").dtypes] == [
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert op11_licenses(spark, "/root/testdata/sf0.001").where(~F.col("score").between(0, 1)).count() == 0
