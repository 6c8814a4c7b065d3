"""Queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import chunks, clean, extracts, sentiment, topics, words
from ..plans import texts
from ..session import load, load_by_key, load_dealt, load_spread
from .sqltext import ASCII_DIGITS, ASCII_WORDS, TOKENS, half_up, words as words_sql


def _docs(spark, sf):
    return load_spread(spark, sf, "documents")


def lexicon(spark, sf):
    """A scored word list made from the words of ``benchmark``: sixteenths by length and first letter."""
    found = load(spark, sf, "benchmark").select(
        F.explode(X.extract_all(F.lower("text"), r"[\p{L}\p{N}_]+")).alias("word")).distinct()
    size, letter = F.length("word"), F.ascii("word")
    return found.select(
        "word",
        (((size * 5 + letter) % 27 - 13) / 16.0).cast("double").alias("polarity"),
        ((size + letter) % 9 / 8.0).cast("double").alias("subjectivity"),
    )


def _scored_columns(spark, sf):
    table = _docs(spark, sf).select("doc_id", "lang", "source", "text", F.substring("text", 1, 60).alias("opening"))
    return sentiment.sentiment_columns(table, lexicon(spark, sf), "doc_id")


def _docs_by_id(spark, sf):
    return load_by_key(spark, sf, "documents", "doc_id")


def _page_sentiment(spark, sf):
    scored = sentiment.page_sentiment(_docs_by_id(spark, sf), lexicon(spark, sf), sentence_chars=sentiment.SENTENCE_CHARS)
    # A text without sentences has no extremes.
    best, worst = F.get("most_positive", F.lit(0)), F.get("most_negative", F.lit(0))
    return scored.select(
        "doc_id", "polarity", "subjectivity", "label", "sentence_count", "average_polarity",
        best["polarity"].alias("best"), worst["polarity"].alias("worst"), worst["text"].alias("worst_text"), F.size("most_positive").cast("long").alias("shown"))


# Tasks whose phrases one task counts: a MB of documents makes 2.4 MB of phrases to shuffle.
COUNTED = 8


def _bigrams(spark, sf):
    table, tasks = load_dealt(spark, sf, "documents", "_deal")
    if tasks is not None:
        tasks = max(spark.sparkContext.defaultParallelism, -(-tasks // COUNTED))
    return words.bigrams(table, deal="_deal", tasks=tasks)


QUERIES = {
    "keywords": lambda spark, sf: words.keywords(_docs(spark, sf)),
    "keywords_per_document": lambda spark, sf: words.keywords(_docs(spark, sf), top_n=25, key="doc_id"),
    "keywords_conversations": lambda spark, sf: words.keywords(
        load_spread(spark, sf, "conversations"), top_n=20, min_length=4),
    "word_frequency": lambda spark, sf: words.word_frequency(_docs(spark, sf)),
    "bigrams": _bigrams,
    "bigrams_per_document": lambda spark, sf: words.bigrams(_docs(spark, sf), key="doc_id"),
    "numbers": lambda spark, sf: extracts.numbers(_docs(spark, sf)),
    "entities": lambda spark, sf: extracts.entities(_docs(spark, sf)),
    "entity_counts": lambda spark, sf: extracts.entity_counts(_docs(spark, sf)),
    "key_values": lambda spark, sf: extracts.key_values(_docs(spark, sf)),
    "topics": lambda spark, sf: topics.topics(_docs(spark, sf)),
    "sentiment": lambda spark, sf: sentiment.sentiment(_docs(spark, sf), lexicon(spark, sf)),
    "sentiment_conversations": lambda spark, sf: sentiment.sentiment(
        load_spread(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("k"), "text"),
        lexicon(spark, sf), key="k").select("k.*", "polarity", "subjectivity", "label"),
    "sentiment_columns": lambda spark, sf: _scored_columns(spark, sf).drop("text", "opening"),
    "sentiment_summary": lambda spark, sf: sentiment.sentiment_summary(_scored_columns(spark, sf)),
    "page_sentiment": _page_sentiment,
    "text_profile": lambda spark, sf: texts.text_overview(_docs_by_id(spark, sf), lexicon(spark, sf)),
    "chunk_paragraphs": lambda spark, sf: chunks.chunk(_docs(spark, sf), "paragraphs", 1500, overlap=100),
    "chunk_sentences": lambda spark, sf: chunks.chunk(_docs(spark, sf), "sentences", 600, overlap=50),
    "chunk": lambda spark, sf: chunks.chunk(_docs(spark, sf)),
    "estimate_tokens": lambda spark, sf: _docs(spark, sf).select(
        "doc_id", X.estimate_tokens(F.col("text")).alias("tokens")),
    "trim_content": lambda spark, sf: _docs(spark, sf).select(
        "doc_id", X.trim_content(F.col("text")).alias("trimmed")),
    "min_length_filter": lambda spark, sf: clean.min_length_filter(_docs(spark, sf)).select(
        "doc_id", F.length("text").cast("long").alias("chars")),
    "humanize": lambda spark, sf: load(spark, sf, "part").select(
        "p_partkey", X.humanize(F.concat_ws("_", "p_type", "p_brand", "p_name")).alias("label")),
}


def _top_sql(value: str, counted: str, key: str | None, n: int) -> str:
    if key is None:
        return f"SELECT {value}, count(*) AS count FROM {counted} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {n}"
    return f"""SELECT {key}, rank, {value}, count FROM (
      SELECT {key}, {value}, count, row_number() OVER (PARTITION BY {key} ORDER BY count DESC, first_pos) AS rank
      FROM (SELECT {key}, {value}, count(*) AS count, min(pos) AS first_pos FROM {counted} GROUP BY 1, 2))
    WHERE rank <= {n}"""


_PAIRS = """pairs AS (SELECT doc_id, pos, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS phrase
  FROM words),
found AS (SELECT * FROM pairs WHERE phrase IS NOT NULL)"""

# The patterns of the library once more, in the syntax of the comparison's regular expressions.
_PRICE = r"[$£€¥₹]\s*[\d,]+\.?\d*"
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
_URL = r"https?://[^\s<>\"{}|\\^`\[\]]+"
_PHONE = r"\b[+]?[(]?[0-9]{3}[)]?[-\s.]?[0-9]{3}[-\s.]?[0-9]{4,6}\b"
_DAYS = r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}"
_DATE = (rf"(?i)\b(?:{_DAYS}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
         r"[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b")
_FULL_DATE = (rf"\b(?:{_DAYS}|(?:January|February|March|April|May|June|July|August|September|October|"
              r"November|December)\s+\d{1,2},?\s+\d{4})\b")
_NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
_LABEL = (r"([A-Za-z][A-Za-z\s]{2,20}):\s*([£$€₹¥]?\s*[\d,\.]+\s*(?:billion|million|trillion|%)?)")


def _listed(kind: str, lists: str) -> str:
    return f"SELECT doc_id, '{kind}' AS kind, unnest(l) AS value, generate_subscripts(l, 1) AS pos FROM ({lists})"


_ENTITY_ROWS = " UNION ALL ".join(
    _listed(kind, f"SELECT doc_id, regexp_extract_all({source}, '{pattern}') AS l FROM documents")
    for kind, source, pattern in [
        ("emails", "text", _EMAIL), ("urls", "text", _URL), ("phones", ASCII_WORDS, _PHONE),
        ("dates", ASCII_WORDS, _DATE), ("proper_nouns", ASCII_DIGITS, _NAME),
    ]
)

_TOPIC_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS ordinal, '{topic}' AS topic, {len(kws)} AS size, "
    + " + ".join(f"contains(low, '{k}')::BIGINT" for k in kws) + " AS matches FROM low"
    for i, (topic, kws) in enumerate(P.TOPIC_KEYWORDS.items())
)

_LEXICON = r"""lexicon AS (SELECT DISTINCT word,
    ((length(word) * 5 + ascii(word)) % 27 - 13) / 16.0::DOUBLE AS polarity, ((length(word) + ascii(word)) % 9) / 8.0::DOUBLE AS subjectivity
  FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM benchmark))"""


def _label(p: str) -> str:
    return (f"CASE WHEN {p} >= 0.5 THEN 'very positive' WHEN {p} >= 0.1 THEN 'positive' WHEN {p} <= -0.5 THEN 'very negative' "
            f"WHEN {p} <= -0.1 THEN 'negative' ELSE 'neutral' END")


def _sentiment(table: str, key: str) -> str:
    return f"""scores AS (SELECT {key}, avg(polarity) AS p, avg(subjectivity) AS s
        FROM (SELECT {key}, unnest({TOKENS}) AS word FROM {table}) JOIN lexicon USING (word) GROUP BY ALL),
      scored AS (SELECT {key}, coalesce({half_up('p', 4)}, 0.0) AS polarity, coalesce({half_up('s', 4)}, 0.0) AS subjectivity
        FROM {table} LEFT JOIN scores USING ({key}))"""


# A sentence ends at white space after a full stop, question or exclamation mark.
_SENTENCES = r"""cut AS (SELECT doc_id, str_split(regexp_replace(text, '([.!?])\s+', E'\\1\x01', 'g'), E'\x01') AS l FROM documents),
  sentences AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS no FROM cut),
  sents AS (SELECT doc_id, no, trim(raw, E' \t\n\r') AS text FROM sentences WHERE trim(raw, E' \t\n\r') <> '')"""


ORACLES = {
    "sentiment": f"WITH {_LEXICON}, {_sentiment('documents', 'doc_id')} SELECT *, {_label('polarity')} AS label FROM scored",
    "sentiment_conversations": f"WITH {_LEXICON}, {_sentiment('conversations', 'conv_id, turn')} SELECT *, {_label('polarity')} AS label FROM scored",
    "sentiment_columns": f"""WITH {_LEXICON}, {_sentiment('documents', 'doc_id')},
      openings AS (SELECT doc_id, substring(text, 1, 60) AS text FROM documents),
      {_sentiment('openings', 'doc_id').replace('scores', 'oscores').replace('scored', 'oscored')}
      SELECT doc_id, lang, source, a.polarity AS text_polarity, {_label('a.polarity')} AS text_sentiment,
        b.polarity AS opening_polarity, {_label('b.polarity')} AS opening_sentiment
      FROM documents JOIN scored a USING (doc_id) JOIN oscored b USING (doc_id)""",
    "sentiment_summary": f"""WITH {_LEXICON}, {_sentiment('documents', 'doc_id')},
      openings AS (SELECT doc_id, substring(text, 1, 60) AS text FROM documents),
      {_sentiment('openings', 'doc_id').replace('scores', 'oscores').replace('scored', 'oscored')},
      l AS (SELECT 'text_sentiment' AS c, {_label('polarity')} AS label FROM scored
            UNION ALL SELECT 'opening_sentiment', {_label('polarity')} FROM oscored)
      SELECT c AS column, label, count(*) AS count, round(count(*) / (SELECT count(*) FROM documents) * 100, 1) AS percent FROM l GROUP BY 1, 2""",
    "page_sentiment": f"""WITH {_LEXICON}, {_SENTENCES},
      tokens AS (SELECT doc_id, no, unnest({TOKENS}) AS word FROM sents),
      hits AS (SELECT doc_id, no, sum(polarity) AS p, sum(subjectivity) AS s, count(*) AS n FROM tokens JOIN lexicon USING (word) GROUP BY 1, 2),
      per AS (SELECT doc_id, no, text, coalesce({half_up('p / n', 3)}, 0.0) AS polarity FROM sents LEFT JOIN hits USING (doc_id, no)),
      a AS (SELECT doc_id, count(*) AS sentence_count, {half_up('sum(polarity::DECIMAL(10,3))::DOUBLE / count(*)', 4)} AS average_polarity, max(polarity) AS best,
              min(polarity) AS worst, arg_min(substring(text, 1, 100), (polarity, no)) AS worst_text FROM per GROUP BY 1),
      o AS (SELECT doc_id, {half_up('sum(p) / sum(n)', 4)} AS p, {half_up('sum(s) / sum(n)', 4)} AS s FROM hits GROUP BY 1),
      f AS (SELECT doc_id, coalesce(p, 0.0) AS polarity, coalesce(s, 0.0) AS subjectivity, coalesce(sentence_count, 0) AS sentence_count,
              coalesce(average_polarity, 0.0) AS average_polarity, best, worst, worst_text, coalesce(least(sentence_count, 3), 0) AS shown
            FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN o USING (doc_id))
      SELECT *, {_label('polarity')} AS label FROM f""",
    "keywords": f"WITH {words_sql()} " + _top_sql("word", "words", None, 20),
    "keywords_per_document": f"WITH {words_sql()} " + _top_sql("word", "words", "doc_id", 25),
    "keywords_conversations": f"WITH {words_sql('conversations', 'conv_id', 4)} " + _top_sql("word", "words", None, 20),
    "word_frequency": f"WITH {words_sql()} " + _top_sql("word", "words", None, 30),
    "bigrams": f"WITH {words_sql()}, {_PAIRS} " + _top_sql("phrase", "found", None, 10),
    "bigrams_per_document": f"WITH {words_sql()}, {_PAIRS} " + _top_sql("phrase", "found", "doc_id", 10),
    "numbers": rf"""WITH n AS (SELECT doc_id, {ASCII_WORDS} AS a, text FROM documents),
      found AS (
        {_listed('prices', f"SELECT doc_id, regexp_extract_all(text, '{_PRICE}') AS l FROM n")}
        UNION ALL
        {_listed('percentages', r"SELECT doc_id, regexp_extract_all(text, '\d+\.?\d*\s*%') AS l FROM n")}
        UNION ALL
        {_listed('numbers', r"SELECT doc_id, list_transform(list_filter(regexp_extract_all(a, '\b\d+\.?\d*\b'), lambda x: x::DOUBLE < 1e9), lambda x: x::DOUBLE::VARCHAR) AS l FROM n")})
      SELECT doc_id, kind, pos, value FROM found""",
    "entities": f"SELECT doc_id, kind, value, count(*) AS count FROM ({_ENTITY_ROWS}) GROUP BY 1, 2, 3",
    "entity_counts": f"SELECT kind, value, count(*) AS count FROM ({_ENTITY_ROWS}) GROUP BY 1, 2",
    "key_values": rf"""WITH lists AS (
        SELECT doc_id, 'prices_found' AS name, regexp_extract_all(text, '{_PRICE}') AS l FROM documents
        UNION ALL SELECT doc_id, 'dates_found', list_sort(list_distinct(regexp_extract_all({ASCII_WORDS}, '{_FULL_DATE}'))) FROM documents
        UNION ALL SELECT doc_id, 'emails', list_sort(list_distinct(regexp_extract_all(text, '{_EMAIL}'))) FROM documents
        UNION ALL SELECT doc_id, 'phones', list_sort(list_distinct(regexp_extract_all({ASCII_WORDS}, '{_PHONE}'))) FROM documents
        UNION ALL SELECT doc_id, 'urls_found', list_sort(list_distinct(regexp_extract_all(text, '{_URL}'))) FROM documents),
      listed AS (SELECT doc_id, name, generate_subscripts(l, 1) AS pos, unnest(l) AS value FROM lists),
      raw AS (SELECT doc_id, regexp_extract_all(text, '{_LABEL}', 1) AS a,
                     regexp_extract_all(text, '{_LABEL}', 2) AS b FROM documents),
      pairs AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS label, unnest(b) AS value FROM raw),
      named AS (SELECT doc_id, i, regexp_replace(lower(trim(label, E' \t\n\r')), '\s+', '_', 'g') AS name,
                       trim(value, E' \t\n\r') AS value FROM pairs),
      last AS (SELECT doc_id, name, arg_max(value, i) AS value FROM named GROUP BY 1, 2)
      SELECT doc_id, name, pos, value FROM listed t WHERE name = 'urls_found'
        OR NOT EXISTS (SELECT 1 FROM last s WHERE s.doc_id = t.doc_id AND s.name = t.name)
      UNION ALL
      SELECT doc_id, name, 1, value FROM last s WHERE name <> 'urls_found'
        OR NOT EXISTS (SELECT 1 FROM listed t WHERE t.doc_id = s.doc_id AND t.name = 'urls_found')""",
    "topics": f"""WITH low AS (SELECT doc_id, lower(text) AS low FROM documents),
      hits AS ({_TOPIC_ROWS}),
      scored AS (SELECT doc_id, ordinal, topic, matches, round(matches / size, 3) AS confidence FROM hits WHERE matches > 0),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, ordinal) AS rank FROM scored)
      SELECT doc_id, rank, topic, confidence, matches FROM ranked WHERE rank <= 5""",
    "estimate_tokens": "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents",
    "trim_content": r"""WITH cut AS (SELECT doc_id, text, substring(text, 1, 4000) AS head FROM documents),
      broken AS (SELECT *, regexp_extract(head, '(?s)^(.*)\n', 1) AS lines FROM cut)
      SELECT doc_id, CASE WHEN length(text) <= 4000 THEN text WHEN length(lines) > 2800 THEN lines ELSE head END AS trimmed
      FROM broken""",
    "min_length_filter": r"""SELECT doc_id, length(text) AS chars FROM documents
      WHERE length(trim(text, E' \t\n\r')) >= 20""",
    "humanize": r"""SELECT p_partkey, array_to_string(list_transform(
        regexp_extract_all(replace(p_type || '_' || p_brand || '_' || p_name, '_', ' '), '[A-Za-z]+|[^A-Za-z]+'),
        lambda r: upper(r[1]) || lower(r[2:])), '') AS label FROM part""",
}

ORACLES["text_profile"] = rf"""WITH kw AS ({ORACLES['keywords_per_document']}), bg AS ({ORACLES['bigrams_per_document']}),
  en AS ({ORACLES['entities']}), tp AS ({ORACLES['topics']}), se AS ({ORACLES['page_sentiment']})
  SELECT d.doc_id, length(text) AS text_length, len(regexp_extract_all(text, '\S+')) AS word_count,
    (SELECT count(*) FROM kw WHERE kw.doc_id = d.doc_id) AS keyword_count, k.word AS top_keyword,
    (SELECT count(*) FROM bg WHERE bg.doc_id = d.doc_id) AS bigram_count, b.phrase AS top_bigram,
    (SELECT count(*) FROM en WHERE en.doc_id = d.doc_id) AS entity_count, t.topic AS top_topic,
    se.polarity, se.label, se.sentence_count
  FROM documents d LEFT JOIN kw k ON k.doc_id = d.doc_id AND k.rank = 1 LEFT JOIN bg b ON b.doc_id = d.doc_id AND b.rank = 1
    LEFT JOIN tp t ON t.doc_id = d.doc_id AND t.rank = 1 LEFT JOIN se ON se.doc_id = d.doc_id"""

# The fold of a text into chunks as a recursive query: one step per sentence.
_FOLD = r"""WITH RECURSIVE {sentences}, numbered AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS i FROM sents),
  fold AS (
    SELECT doc_id, 0::BIGINT AS i, '' AS open, NULL::VARCHAR AS closed FROM documents WHERE length(text) > {size}
    UNION ALL
    SELECT f.doc_id, n.i,
      CASE WHEN f.open <> '' AND length(f.open) + length(n.text) + 1 > {size} THEN right(f.open, {overlap}) || ' ' || n.text
           ELSE trim(f.open || ' ' || n.text, E' \t\n\r') END,
      CASE WHEN f.open <> '' AND length(f.open) + length(n.text) + 1 > {size} THEN trim(f.open, E' \t\n\r') END
    FROM fold f JOIN numbered n ON n.doc_id = f.doc_id AND n.i = f.i + 1),
  chunks AS (
    SELECT doc_id, i, closed AS chunk FROM fold WHERE closed IS NOT NULL
    UNION ALL SELECT doc_id, 1000000 + i, trim(open, E' \t\n\r') FROM fold f
      WHERE i = (SELECT coalesce(max(n.i), 0) FROM numbered n WHERE n.doc_id = f.doc_id) AND trim(open, E' \t\n\r') <> ''
    UNION ALL SELECT doc_id, 1, text FROM documents WHERE length(text) BETWEEN 1 AND {size})
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS chunk_num, count(*) OVER (PARTITION BY doc_id) AS total_chunks, chunk FROM chunks"""


def _fold(size: int, overlap: int) -> str:
    return _FOLD.format(sentences=_SENTENCES, size=size, overlap=overlap)


ORACLES["chunk_sentences"] = _fold(600, 50)
# The documents hold no blank line: a text is one paragraph, and an over-long one is split by sentence.
ORACLES["chunk_paragraphs"] = _fold(1500, 100)
ORACLES["chunk"] = _fold(6000, 200)
