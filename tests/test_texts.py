"""Text operators on literal rows."""

import re
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gleanframe.functions import text as X
from gleanframe.functions.membership import likely_in
from gleanframe.operators import chunks, extracts, sentiment, topics, words
from gleanframe.plans.texts import text_profile, word_count


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "v string").select(column(F.col("v"))).first()[0]


def test_accented_words_are_no_keywords(spark):
    found = words.keywords(docs(spark, "énon non naïve cat_s cat cat2 Cats CATS dog's"))
    assert rows(found) == [("cat", 1), ("cats", 2), ("dog", 1), ("non", 1)]


def test_keyword_ties_go_to_the_first_appearance_per_text(spark):
    found = words.keywords(docs(spark, "zebra apple zebra apple mango"), top_n=2, key="doc_id")
    assert rows(found) == [(0, 1, "zebra", 2), (0, 2, "apple", 2)]


def test_bigrams_bridge_stop_words_but_not_texts(spark):
    found = words.bigrams(docs(spark, "red and the blue", "green is red blue", "", "one"))
    assert rows(found) == [("green red", 1), ("red blue", 2)]


def test_number_backtracking(spark):
    found = extracts.numbers(docs(spark, "3.14abc 5. é7 8,9 $ 1,000.50 and 50 % or 1.5%; 2000000000"))
    assert rows(found.where("kind = 'numbers'").select("value")) == rows(
        spark.createDataFrame([(str(float(n)),) for n in re.findall(r"\b\d+\.?\d*\b", "3.14abc 5. é7 8,9 $ 1,000.50 and 50 % or 1.5%")], "v string"))
    assert rows(found.where("kind = 'prices'").select("value")) == [("$ 1,000.50",)]
    assert rows(found.where("kind = 'percentages'").select("value")) == [("1.5%",), ("50 %",)]


def test_entities(spark):
    text = ("Ada Lovelace and Alan Turing met Ada Lovelace on Jan 5, 2024 or 2024-01-05 or 5/1/24; "
            "mail a.b@x.org, see https://x.org/a?b=1 and call (555) 123-4567 or 555.123.4567")
    found = rows(extracts.entities(docs(spark, text, "nothing here")))
    assert found == [
        (0, "dates", "2024-01-05", 1), (0, "dates", "5/1/24", 1), (0, "dates", "Jan 5, 2024", 1),
        (0, "emails", "a.b@x.org", 1),
        (0, "phones", "555) 123-4567", 1), (0, "phones", "555.123.4567", 1),
        (0, "proper_nouns", "Ada Lovelace", 2), (0, "proper_nouns", "Alan Turing", 1),
        (0, "urls", "https://x.org/a?b=1", 1),
    ]


def test_key_values(spark):
    text = "Net Revenue: $500 billion, Net Revenue: 7%, emails: 3 at a@b.co; and Founded: 1, May 5, 2020"
    found = {(r["name"], r["value"]) for r in extracts.key_values(docs(spark, text)).collect()}
    # The later pair of a label wins, a label replaces the list of its name and starts as early as it can.
    assert found == {("prices_found", "$500"), ("dates_found", "May 5, 2020"), ("net_revenue", "7%"), ("emails", "3"),
                     ("and_founded", "1,")}


def test_topic_keywords_match_inside_words(spark):
    found = topics.topics(docs(spark, "main street")).collect()
    assert [(r["topic"], r["matches"], r["confidence"]) for r in found] == [("Technology", 1, 0.077)]


def test_topics_rank_by_confidence_then_list_order(spark):
    found = topics.topics(docs(spark, "hotel bank learn law buy doctor data")).collect()
    assert [r["topic"] for r in found] == ["News", "Education", "Travel", "Health", "E-Commerce"]
    assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]


LEXICON = [("good", 0.75, 0.5), ("great", 1.0, 1.0), ("bad", -0.75, 0.5), ("so", 0.1, 0.0), ("meh", -0.1, 0.25)]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "word string, polarity double, subjectivity double")


def test_sentiment_labels(spark, lexicon):
    found = sentiment.sentiment(docs(spark, "Good!", "so-so", "meh", "bad", "good bad", "", None), lexicon)
    assert [r[1:] for r in rows(found)] == [
        (0.75, 0.5, "very positive"), (0.1, 0.0, "positive"), (-0.1, 0.25, "negative"), (-0.75, 0.5, "very negative"),
        (0.0, 0.5, "neutral"), (0.0, 0.0, "neutral"), (0.0, 0.0, "neutral")]


def test_sentiment_columns_picks_long_texts(spark, lexicon):
    table = spark.createDataFrame(
        [(1, "good " * 8, "bad"), (2, "bad " * 8, "good"), (3, None, "x")], "id long, body string, tag string")
    scored = sentiment.sentiment_columns(table, lexicon, "id")
    assert scored.columns == ["id", "body", "tag", "body_polarity", "body_sentiment"]
    assert rows(scored.select("id", "body_sentiment")) == [(1, "very positive"), (2, "very negative"), (3, "neutral")]
    assert rows(sentiment.sentiment_summary(scored)) == [
        ("body_sentiment", "neutral", 1, 33.3), ("body_sentiment", "very negative", 1, 33.3),
        ("body_sentiment", "very positive", 1, 33.3)]


def test_page_sentiment_extremes_and_limits(spark, lexicon):
    text = "It is good. It is bad! It is great? It is plain. It is good."
    row = sentiment.page_sentiment(docs(spark, text), lexicon).first()
    assert row["sentence_count"] == 5 and row["average_polarity"] == 0.35
    assert [s["polarity"] for s in row["most_positive"]] == [1.0, 0.75, 0.75]
    assert row["most_negative"][0]["text"] == "It is bad!"
    short = sentiment.page_sentiment(docs(spark, text), lexicon, max_sentences=2).first()
    assert short["sentence_count"] == 2 and short["average_polarity"] == 0.0 and short["polarity"] == row["polarity"]
    cut = sentiment.page_sentiment(docs(spark, text), lexicon, max_chars=11).first()
    assert cut["polarity"] == 0.75


def test_page_sentiment_keeps_whole_sentences(spark, lexicon):
    text = "It is good " + "and plain " * 20 + "here."
    row = sentiment.page_sentiment(docs(spark, text), lexicon).first()
    assert row["most_positive"][0]["text"] == text
    cut = sentiment.page_sentiment(docs(spark, text), lexicon, sentence_chars=100).first()
    assert cut["most_positive"][0]["text"] == text[:100]


def test_text_profile(spark, lexicon):
    parts = text_profile(docs(spark, " Good software \n in 2024 "), lexicon)
    assert set(parts) == {"summary", "keywords", "bigrams", "entities", "topics", "sentiment"}
    assert parts["summary"].first()["word_count"] == 4
    assert value(spark, word_count, "  ") == 0


@pytest.mark.parametrize("text, length", [("a" * 10, 10), ("x" * 90 + "\n" + "y" * 50, 90), ("x" * 60 + "\n" + "y" * 90, 100)])
def test_trim_content(spark, text, length):
    assert len(value(spark, lambda c: X.trim_content(c, 100), text)) == length


@pytest.mark.parametrize("text, number", [
    ("$1,200.50", 1200.5), (" 7% ", 7.0), ("12.5d", None), ("€5", None), ("1e3", 1000.0), ("", None), (".5", 0.5),
    ("1_000", None), ("inf", float("inf")), ("0x10", None), (None, None)])
def test_parse_money(spark, text, number):
    assert value(spark, X.parse_money, text) == number


@pytest.mark.parametrize("url, host", [
    ("http://www.web.de/x", "eb.de"), ("https://user:pw@Host.COM:80/a", "user:pw@host.com:80"), ("plain", ""),
    ("https://x.org|bad/", "x.org|bad"), (None, "")])
def test_domain(spark, url, host):
    assert value(spark, X.domain, url) == host


@pytest.mark.parametrize("text, title", [("net_income 2nd-half", "Net Income 2Nd-Half"), ("a1b", "A1B"), ("", "")])
def test_humanize_follows_title_case(spark, text, title):
    assert value(spark, X.humanize, text) == title == text.replace("_", " ").title()


@pytest.mark.parametrize("number", [0.1, 1.0, 1e7, 123456789.25, 1e15, 1e16, 1.5e300, 1e-4, 1.25e-5, -2.5e-7, 0.0, 3.0e22])
def test_float_text(spark, number):
    from pyspark.sql import types as T

    shown = spark.createDataFrame([(number,)], "v double").select(X.value_text(F.col("v"), T.DoubleType())).first()[0]
    assert shown == str(number)


def test_nested_value_text(spark):
    df = spark.createDataFrame([([1, None], {"a": True}, "it's", ("q\"", 1.0))],
                               "l array<int>, m map<string,boolean>, s string, t struct<x:string,y:double>")
    shown = df.select(*[X.value_text(F.col(f.name), f.dataType) for f in df.schema.fields]).first()
    assert list(shown) == ["[1, None]", "{'a': True}", "it's", "{'x': 'q\"', 'y': 1.0}"]
    quoted = spark.createDataFrame([(["it's", "a\nb"],)], "l array<string>")
    assert quoted.select(X.value_text(F.col("l"), quoted.schema["l"].dataType)).first()[0] == str(["it's", "a\nb"])


def sentence_rule(text, size, overlap):
    """Restated: greedy packing, the next chunk begins with the last one's tail."""
    chunk, done = "", []
    for sentence in [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]:
        if chunk and len(chunk) + 1 + len(sentence) > size:
            done.append(chunk.strip())
            chunk = f"{chunk[-overlap:]} {sentence}"
        else:
            chunk = f"{chunk} {sentence}".strip()
    return done + ([chunk.strip()] if chunk.strip() else [])


def paragraph_rule(text, size, overlap):
    chunk, tail, done = "", "", []
    for para in [p.strip() for p in re.split(r"\n\n+", text) if p.strip()]:
        if len(para) > size:
            if chunk:
                done.append(chunk.strip())
            done += sentence_rule(para, size, overlap)
            chunk, tail = "", done[-1][-overlap:]
        elif not chunk:
            chunk = f"{tail}\n\n\n\n{para}".strip()
        elif len(chunk) + 2 + len(para) > size:
            done.append(chunk.strip())
            tail = chunk[-overlap:]
            chunk = f"{tail}\n\n{para}".strip()
        else:
            chunk = f"{chunk}\n\n{para}"
    return done + ([chunk.strip()] if chunk.strip() else [])


PROSE = "\n\n".join(
    " ".join(f"Sentence {i}.{j} says {'very ' * (i * j % 7)}little{'!' if j % 3 else '?'}" for j in range(i % 9 + 1)) for i in range(40))


@pytest.mark.parametrize("size, overlap", [(80, 10), (120, 30), (200, 200), (400, 50), (1000, 7)])
@pytest.mark.parametrize("strategy", ["paragraphs", "sentences"])
def test_chunks_follow_the_rule(spark, strategy, size, overlap):
    texts = [PROSE, PROSE.replace("\n\n", "\n\n\n \n\n"), "x" * 500, "word. " * 300, "a\n\n" + "b. " * 200 + "\n\nc"]
    rule = paragraph_rule if strategy == "paragraphs" else sentence_rule
    found = chunks.chunk(docs(spark, *texts), strategy, size, overlap=overlap).collect()
    for i, text in enumerate(texts):
        mine = sorted((r["chunk_num"], r["chunk"], r["total_chunks"]) for r in found if r["doc_id"] == i)
        expected = [text] if len(text) <= size else rule(text, size, overlap)
        assert [m[1] for m in mine] == expected
        assert all(m[2] == len(expected) for m in mine)


def test_short_and_empty_texts(spark):
    assert rows(chunks.chunk(docs(spark, "", " as is ", None)).select("doc_id", "chunk")) == [(1, " as is ")]
    with pytest.raises(ValueError):
        chunks.chunk(docs(spark, "x"), overlap=0)


def test_counting_per_text_needs_no_shuffle(spark):
    import contextlib
    import io

    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        words.keywords(docs(spark, "a text"), key="doc_id").explain("formatted")
        words.bigrams(docs(spark, "a text"), key="doc_id").explain("formatted")
    assert "Exchange" not in text.getvalue()


def test_long_texts_are_counted_in_a_sort(spark):
    body = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnop'[i * i % 6]}" for i in range(60_000))
    found = words.keywords(docs(spark, body, None, "", "the of"), key="doc_id", top_n=100).collect()
    counts, first = {}, {}
    for i, w in enumerate(body.split()):
        if re.fullmatch("[a-z]{3,}", w):
            counts[w] = counts.get(w, 0) + 1
            first.setdefault(w, i)
    expected = sorted(counts, key=lambda w: (-counts[w], first[w]))[:100]
    assert [(r["word"], r["count"]) for r in sorted(found, key=lambda r: r["rank"])] == [(w, counts[w]) for w in expected]


def test_many_label_pairs_stay_linear(spark):
    body = "\n".join(f"Label {'abcdefghijklmnopqrstuvwxyz'[i % 26]}: {i}" for i in range(40_000))
    start = time.time()
    found = {r["name"]: r["value"] for r in extracts.key_values(docs(spark, body)).collect()}
    assert time.time() - start < 60
    assert found["label_a"] == str(max(i for i in range(40_000) if i % 26 == 0)) and len(found) == 26


def test_bitmap_holds_every_word(spark):
    table = spark.createDataFrame([(f"w{i}",) for i in range(3000)] + [(None,)], "word string")
    test = likely_in(table, "word", 1 << 16)
    assert table.where("word is not null").where(~test(F.col("word"))).count() == 0
    others = spark.range(3000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("word"))
    assert others.where(test(F.col("word"))).count() < 300
    assert others.where(likely_in(table.limit(0), "word")(F.col("word"))).count() == 0


def test_sentences_are_not_sent_with_every_word(spark, lexicon):
    import contextlib
    import io

    from gleanframe.operators.sentiment import page_sentiment

    table = docs(spark, "Good and bad. A good one! Nothing here", "", "good good good")
    scored = page_sentiment(table, lexicon)
    assert {r["doc_id"]: [s["text"] for s in r["most_positive"]] for r in scored.collect() if r["sentence_count"]} == {
        r["doc_id"]: r["t"] for r in scored.selectExpr("doc_id", "transform(most_positive, s -> s.text) t").collect() if r["t"]}
    assert all(s["text"] for r in scored.collect() for s in r["most_positive"])
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        scored.select("doc_id", "polarity", "label", "sentence_count").explain("formatted")
    assert "any_value" not in plan.getvalue()


def test_sentences_are_not_sent_for_their_scores(spark, tmp_path):
    import contextlib
    import io

    from gleanframe.queries.text import QUERIES

    table = spark.createDataFrame(
        [(0, "Good one. Nothing. Bad one! More? Last"), (1, None), (2, ""), (3, "Only silence here. And here"),
         (4, "Good one. Nothing. Bad one"), (4, "Good one. Nothing. Bad one"), (4, "Good one"), (None, "Bad one. Good one"), (None, "Bad one")],
        "doc_id long, text string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("good bad",)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = QUERIES["page_sentiment"](spark, str(tmp_path))
    good, bad = ((4 * 5 + 103) % 27 - 13) / 16, ((3 * 5 + 98) % 27 - 13) / 16
    rounded = lambda x, n: int(abs(x) * 10**n + 0.5) / 10**n * (1 if x > 0 else -1)
    least, most = sorted([rounded(good, 3), rounded(bad, 3)])
    assert min(least, 0) == 0.0 or least < 0
    shown = {r["doc_id"]: (r["polarity"], r["sentence_count"], r["best"], r["worst"], r["worst_text"], r["shown"]) for r in found.collect()}
    assert found.count() == len(shown) == 6
    overall = rounded((good + bad) / 2, 4)
    first = {True: (0.0, "Nothing."), False: (least, "Good one." if good < bad else "Bad one!")}[least > 0]
    assert shown[0] == (overall, 5, max(most, 0.0), *first, 3)
    assert shown[1] == shown[2] == (0.0, 0, None, None, None, 0)
    assert shown[3] == (0.0, 2, 0.0, 0.0, "Only silence here.", 2)
    assert shown[4][1] == 3 and shown[4][0] == rounded((3 * good + 2 * bad) / 5, 4) and shown[4][5] == 3
    assert shown[None][:2] == (rounded((2 * bad + good) / 3, 4), 2)
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        found.explain()
    by_id = re.findall(r"Exchange hashpartitioning\(doc_id[^)]*\), (\w+)", plan.getvalue())
    assert by_id and set(by_id) == {"REPARTITION_BY_NUM"}


def test_counts_in_a_row_are_kernels(spark, lexicon, monkeypatch):
    import contextlib
    import io
    import random

    from gleanframe.functions import kernels
    from gleanframe.functions.patterns import TOPIC_KEYWORDS
    from gleanframe.plans.texts import text_overview

    # Words cross the ends of blocks.
    monkeypatch.setattr(kernels, "_BLOCK", 16)
    chosen = random.Random(3)
    parts = [w for words in TOPIC_KEYWORDS.values() for w in words] + ["é", "\u2003", " ", "x", "machine", "learning", "a", "i", "\x1f", "pap"]
    bodies = [None, "", "ai", "a", "pap", "machine", "learning"] + [
        "".join(chosen.choice(parts) + chosen.choice(["", " "]) for _ in range(chosen.randrange(30))) for _ in range(200)]
    table = docs(spark, *bodies).withColumn("words", F.split("text", " ")).coalesce(1)
    found = table.select(
        "text", "words", kernels.held_words(F.col("text"), list(TOPIC_KEYWORDS.values())).alias("held"),
        kernels.spaced_words(F.col("text")).alias("spaced"), kernels.most_frequent(F.col("words"), 3).alias("top")).collect()
    assert len(found) == len(bodies)
    for r in found:
        body, words_ = r["text"] or "", r["words"] or []
        assert r["held"] == [sum(w in body for w in words) for words in TOPIC_KEYWORDS.values()]
        assert r["spaced"] == (None if r["text"] is None else len(body.split()))
        ranked = sorted(set(words_), key=lambda w: (-words_.count(w), words_.index(w)))[:3]
        assert [tuple(t) for t in r["top"]] == [(words_.count(w), words_.index(w), w) for w in ranked]
    assert spark.sql("select array('b', null, 'a', 'b', 'a', null) v").select(kernels.most_frequent(F.col("v"), 2)).first()[0] == [(2, 0, "b"), (2, 2, "a")]
    broken = spark.sql("select cast(x'61ff2062' as string) v")
    assert broken.select(kernels.spaced_words(F.col("v")), kernels.held_words(F.col("v"), [["b", "ab"], ["a"]])).first()[:] == (2, [1, 1])
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        text_overview(table, lexicon).explain()
    # Counted without a sorted array of every word, and scored without the sentences.
    assert "_starts" not in plan.getvalue() and "collect_list" not in plan.getvalue()


def test_phrases_are_counted_in_more_tasks_as_documents_grow(spark, tmp_path, monkeypatch):
    import contextlib
    import io
    import os

    from gleanframe import session
    from gleanframe.queries.text import QUERIES

    letters = "abcdefghijklmnop"
    texts = [" ".join("word" + letters[i * n % 16] + letters[n % 16] + letters[i % 16] for n in range(40)) for i in range(300)]
    table = docs(spark, *texts, *["very same text"] * 400, *texts[:50], None, "", "one").coalesce(1)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    files = [f"{tmp_path}/documents.parquet/{f}" for f in os.listdir(f"{tmp_path}/documents.parquet") if f.endswith(".parquet")]
    monkeypatch.setattr(session, "SPREAD_BYTES", sum(map(os.path.getsize, files)) // 100)
    found = QUERIES["bigrams"](spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in words.bigrams(table).collect()]
    assert [tuple(r) for r in found.collect()][:2] == [("same text", 400), ("very same", 400)]
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        QUERIES["bigrams"](spark, str(tmp_path)).explain()
    shuffles = [(name, int(n)) for name, n in re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, (\d+)\)", plan.getvalue())]
    assert plan.getvalue().count("Exchange") == len(shuffles) == 2
    assert dict(shuffles)["phrase"] >= 12 > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_deals_are_added_up_however_the_table_lies(spark):
    table = docs(spark, "red blue red blue", None, "red blue", "blue red", "red blue").withColumn(
        "d", F.when(F.col("doc_id") < 4, F.col("doc_id") % 2))
    for t in (table, table.repartition(3, "d"), table.withColumn("d", F.lit(1))):
        for tasks in (None, 1, 5):
            assert rows(words.bigrams(t, deal="d", tasks=tasks)) == [("blue red", 2), ("red blue", 4)]
