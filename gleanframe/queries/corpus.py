"""Queries over HTML pages, as given and as written by Spark from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import pages
from ..session import load_spread


def _pages(spark, sf):
    return load_spread(spark, sf, "pages")


def _money(name):
    return F.col(name).cast("decimal(12,2)").cast("string")


def infobox_pages(spark, sf):
    """A page with an infobox per customer."""
    row = lambda label, value: F.concat(F.lit(f"<tr><th> {label} </th><td>"), value, F.lit("</td></tr>"))
    html = F.concat(
        F.lit("<html><body><p>About</p><table class='wide InfoBox'>"),
        row("Customer Name", F.col("c_name")), row("Market/Segment", F.lower("c_mktsegment")),
        row("Balance ($)", _money("c_acctbal")), F.lit("<tr><td>alone</td></tr>"),
        row("Nation", F.concat(F.lit("<b> N</b>"), F.col("c_nationkey").cast("string"))),
        F.lit("</table><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table></body>"))
    return load_spread(spark, sf, "customer").select(
        F.col("c_custkey").alias("page_id"),
        F.concat(F.lit("https://en.wikipedia.org/wiki/"), "c_custkey").alias("url"), html.alias("html"))


def table_pages(spark, sf):
    """A page with a table per order; the blank heading shifts the names."""
    html = F.concat(
        F.lit("<table><tr><th>Order Key</th><th>Status</th><th> </th><th>Total (USD)</th></tr><tr><td>"),
        F.col("o_orderkey").cast("string"), F.lit("</td><td>"), F.col("o_orderstatus"), F.lit("</td><td>"),
        F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.lower("o_orderpriority")), F.lit("</td><td>"),
        _money("o_totalprice"), F.lit("</td></tr><tr><td>short</td></tr><tr><td> </td><td></td></tr></table>"))
    return load_spread(spark, sf, "orders").select(
        F.col("o_orderkey").alias("page_id"), F.concat(F.lit("https://shop.example.com/o/"), "o_orderkey").alias("url"),
        html.alias("html"))


def card_pages(spark, sf):
    """A page with two product cards per part, and an element that says too little."""
    html = F.concat(
        F.lit("<nav><div class=item><h2>menu</h2><p>x</p></div></nav><section><div class='card big'><h3>"), F.col("p_name"),
        F.lit("</h3><span class='unit-price'> $"), _money("p_retailprice"), F.lit("</span><em class=stars>"),
        F.col("p_size").cast("string"), F.lit("</em><p>"), F.col("p_type"), F.lit(" <i>"), F.col("p_brand"),
        F.lit("</i></p><a href='/p/"), F.col("p_partkey").cast("string"), F.lit("'>see</a></div>"),
        F.lit("<li class=listing><b class=Name>offer</b> now £ "), F.col("p_size").cast("string"),
        F.lit(",000 only<script>var x='$9'</script></li><div class=post>nothing</div></section>"))
    return load_spread(spark, sf, "part").select(
        F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://shop.example.com/p/"), "p_partkey").alias("url"),
        html.alias("html"))


def mixed_pages(spark, sf):
    shift = lambda df, i: df.withColumn("page_id", F.col("page_id") * 3 + i)
    return shift(infobox_pages(spark, sf), 0).unionByName(shift(table_pages(spark, sf), 1)).unionByName(
        shift(card_pages(spark, sf), 2))


def meta_pages(spark, sf):
    """Pages with every kind of metadata, the description twice."""
    html = F.concat(
        F.lit("<head><title> "), F.col("p_name"), F.lit(" &amp; co</title><meta name=Description content='first'>"),
        F.lit("<meta name='description' content='"), F.col("p_type"), F.lit("'><meta property='og:title' content='"),
        F.col("p_brand"), F.lit("'/><meta name=keywords content='a, b'><link rel='next canonical' href='/c/"),
        F.col("p_partkey").cast("string"), F.lit("'></head><body><title>late</title>"))
    return load_spread(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.lit("").alias("url"), html.alias("html"))


def _fields(df, *names):
    return df.select(*[c for c in df.columns if c != "fields"], F.size("fields").cast("long").alias("n"),
                     *[F.try_element_at("fields", F.lit(n)).alias(n) for n in names])


def _typed_pages(spark, sf):
    """The pages under changing hosts, with a script mark and a content type on some."""
    n = F.col("page_id")
    host = F.get(F.array(*[F.lit(h) for h in (
        "https://netflix.com/", "https://www.reddit.com/r/", "https://en.wikipedia.org/", "http://m.bbc.co.uk/")]), (n % 5).cast("int"))
    return load_spread(spark, sf, "pages").select(
        "page_id", F.concat(F.coalesce(host, F.lit("")), F.when(host.isNull(), F.col("url")).otherwise("")).alias("url"),
        F.when(n % 10 == 4, F.concat("html", F.lit("<DIV class='a' ID=\"Root\">"))).otherwise(F.col("html")).alias("html"),
        F.when(n % 15 == 14, "application/JSON; charset=utf-8").otherwise("text/html").alias("content_type"))


def _broken_pages(spark, sf):
    """The pages, with a declaration that no browser knows at the front of every seventh."""
    return _pages(spark, sf).withColumn("html", F.concat(
        F.when(F.col("page_id") % 7 == 0, "<![mark[x]]>").otherwise(""), "html"))


def _listed_pages(spark, sf):
    """The pages, each with a table of two columns at its end."""
    row = F.concat(F.lit("<tr><td>"), F.col("page_id").cast("string"), F.lit("</td><td>"), F.length("html").cast("string"),
                   F.lit("</td></tr>"))
    table = F.concat(F.lit("<table><tr><th>Page No</th><th>Chars</th></tr>"), row, row, F.lit("</table>"))
    return _pages(spark, sf).withColumn("html", F.concat("html", table))


QUERIES = {
    "pages_to_text": lambda spark, sf: pages.pages_to_text(_pages(spark, sf)).drop("url"),
    "pages_to_text_all": lambda spark, sf: pages.pages_to_text(_pages(spark, sf), region="all").drop("url"),
    "main_content": lambda spark, sf: pages.main_content(_pages(spark, sf)).drop("url"),
    "page_content": lambda spark, sf: pages.page_content(_pages(spark, sf), 20).drop("url"),
    "page_metadata": lambda spark, sf: pages.page_metadata(_pages(spark, sf)).drop("url"),
    "page_metadata_kinds": lambda spark, sf: pages.page_metadata(meta_pages(spark, sf)).drop("url"),
    "page_titles": lambda spark, sf: pages.page_titles(_pages(spark, sf)),
    "extract_tables": lambda spark, sf: _fields(
        pages.extract_tables(table_pages(spark, sf)).drop("url"), "order_key", "status", "total__usd"),
    "extract_lists": lambda spark, sf: _fields(
        pages.extract_lists(card_pages(spark, sf)).drop("url"), "title", "price", "rating", "description", "url"),
    "extract_infobox": lambda spark, sf: _fields(
        pages.extract_infobox(infobox_pages(spark, sf)).drop("url"), "customer_name", "market_segment", "balance", "nation"),
    "extract_records": lambda spark, sf: pages.extract_records(mixed_pages(spark, sf)).select(
        "page_id", "strategy", "table_no", "row_no", F.size("fields").cast("long").alias("n")),
    "page_records": lambda spark, sf: pages.page_records(mixed_pages(spark, sf)),
    "page_records_given": lambda spark, sf: pages.page_records(_listed_pages(spark, sf)),
    "broken_pages": lambda spark, sf: pages.parse_pages(_broken_pages(spark, sf), "text").drop("url"),
    "page_errors": lambda spark, sf: pages.page_errors(_broken_pages(spark, sf)).drop("url"),
    "classify_pages": lambda spark, sf: pages.classify_pages(_typed_pages(spark, sf), "content_type").drop("url"),
}

_WS = r"E' \t\n\r'"


def _plain(text: str) -> str:
    # A reference may lack its semicolon where a title was cut.
    for entity, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{entity};?', '{char}', 'g')"
    return text


def _strings(html: str) -> str:
    return f"""list_filter(list_transform(string_split_regex({html}, '<[^>]*>'), lambda s: trim({_plain('s')}, {_WS})), lambda s: s <> '')"""


def _squeezed(lines: str) -> str:
    text = f"regexp_replace(regexp_replace(array_to_string({lines}, chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', E'\\n\\n', 'g')"
    return f"trim(array_to_string(list_transform(str_split({text}, chr(10)), lambda x: trim(x, {_WS})), chr(10)), {_WS})"


# The given pages hold an article, one ad, navigation and a footer, and nothing nested in them matters.
_PARTS = rf"""h AS (SELECT page_id, url, regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '<x>', 'g') AS html FROM pages),
  parts AS (SELECT page_id, {_strings('html')} AS all_lines,
    {_strings("regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)")} AS article,
    {_strings("""regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1)""")} AS ad FROM h),
  reader AS (SELECT page_id, all_lines, regexp_replace(array_to_string(CASE
      WHEN length(array_to_string(article, chr(10))) > 500 THEN article
      WHEN length(array_to_string(ad, '')) > 200 THEN ad ELSE list_concat(ad, article) END, chr(10)), '\n{{4,}}', E'\n\n\n', 'g') AS text FROM parts)"""

_SHORT = "CASE WHEN length(text) < 50 THEN array_to_string(all_lines, chr(10)) ELSE text END"
_AMOUNT = "({0}::DECIMAL(12,2))::VARCHAR"

_INFO = f"""SELECT c_custkey AS id, c_name AS customer_name, lower(c_mktsegment) AS market_segment,
  {_AMOUNT.format('c_acctbal')} AS balance, 'N' || c_nationkey AS nation FROM customer"""
_TABLE = """SELECT o_orderkey AS id, o_orderkey::VARCHAR AS order_key, o_orderstatus AS status,
  CASE WHEN o_custkey % 3 <> 0 THEN lower(o_orderpriority) END AS total__usd FROM orders"""
_CARDS = f"""SELECT p_partkey AS id, 0::BIGINT AS row_no, p_name AS title, '$' || {_AMOUNT.format('p_retailprice')} AS price, p_size::VARCHAR AS rating,
    p_type || p_brand AS description, '/p/' || p_partkey AS url FROM part
  UNION ALL SELECT p_partkey, 1, 'offer', '£ ' || p_size || ',000', NULL, NULL, NULL FROM part"""

_RECORD_NAMES = ["customer_name", "market_segment", "balance", "nation", "order_key", "status", "total__usd",
                 "title", "price", "rating", "description", "url"]

ORACLES = {
    "pages_to_text": f"WITH {_PARTS} SELECT page_id, {_squeezed('article')} AS text FROM parts",
    "pages_to_text_all": f"WITH {_PARTS} SELECT page_id, {_squeezed('all_lines')} AS text FROM parts",
    "main_content": f"WITH {_PARTS} SELECT page_id, text FROM reader",
    "page_content": f"WITH {_PARTS} SELECT page_id, {_SHORT} AS text FROM reader WHERE length(trim({_SHORT}, {_WS})) >= 20",
    "page_metadata": f"""SELECT page_id, trim({_plain("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, {_WS}) AS title,
      '' AS description, '' AS keywords, '' AS canonical_url, '' AS og_title, '' AS og_description FROM pages""",
    "page_metadata_kinds": """SELECT p_partkey AS page_id, p_name || ' & co' AS title, p_type AS description, 'a, b' AS keywords,
      '/c/' || p_partkey AS canonical_url, p_brand AS og_title, '' AS og_description FROM part""",
    "page_titles": f"SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), {_WS}) AS raw_title FROM pages",
    "extract_tables": f"""SELECT id AS page_id, 0::BIGINT AS table_no, 0::BIGINT AS row_no, order_key, status, total__usd,
      2 + (total__usd IS NOT NULL)::BIGINT AS n FROM ({_TABLE})""",
    "extract_lists": f"""SELECT id AS page_id, row_no, title, price, rating, description, url,
      CASE row_no WHEN 0 THEN 5::BIGINT ELSE 2 END AS n FROM ({_CARDS})""",
    "extract_infobox": f"SELECT id AS page_id, 4::BIGINT AS n, customer_name, market_segment, balance, nation FROM ({_INFO})",
    "extract_records": f"""SELECT id * 3 AS page_id, 'infobox' AS strategy, 0::BIGINT AS table_no, 0::BIGINT AS row_no, 4::BIGINT AS n FROM ({_INFO})
      UNION ALL SELECT id * 3 + 1, 'tables', 0, 0, 2 + (total__usd IS NOT NULL)::BIGINT FROM ({_TABLE})
      UNION ALL SELECT id * 3 + 2, 'lists', 0, row_no, CASE row_no WHEN 0 THEN 5 ELSE 2 END FROM ({_CARDS})""",
    "page_records_given": """SELECT page_id, url, 1::BIGINT AS row_no, unnest(['page_no', 'chars']) AS field,
      unnest([page_id::VARCHAR, length(html)::VARCHAR]) AS value FROM pages""",
    "broken_pages": f"""WITH {_PARTS} SELECT page_id, {_squeezed('article')} AS text,
      CASE WHEN page_id % 7 = 0 THEN 'malformed declaration' END AS error FROM parts""",
    "page_errors": "SELECT page_id, 'malformed declaration' AS error FROM pages WHERE page_id % 7 = 0",
    "page_records": f"""WITH wide AS (
      SELECT id * 3 AS page_id, 'https://en.wikipedia.org/wiki/' || id AS url, 1::BIGINT AS row_no, customer_name, market_segment, balance, nation FROM ({_INFO})
      UNION ALL BY NAME SELECT id * 3 + 1 AS page_id, 'https://shop.example.com/o/' || id AS url, 1::BIGINT AS row_no, order_key, status, total__usd FROM ({_TABLE})
      UNION ALL BY NAME SELECT id * 3 + 2 AS page_id, 'https://shop.example.com/p/' || id AS url, row_no + 1 AS row_no, title, price, rating, description,
        url AS link FROM ({_CARDS}))
      SELECT * FROM (SELECT page_id, url, row_no, unnest([{', '.join(repr(n) for n in _RECORD_NAMES)}]) AS field,
        unnest([{', '.join(_RECORD_NAMES).replace(', url', ', link')}]) AS value FROM wide) WHERE value IS NOT NULL""",
    "classify_pages": f"""WITH t AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://netflix.com/' WHEN 1 THEN 'https://www.reddit.com/r/'
          WHEN 2 THEN 'https://en.wikipedia.org/' WHEN 3 THEN 'http://m.bbc.co.uk/' ELSE url END AS url,
          html || CASE WHEN page_id % 10 = 4 THEN '<DIV class=''a'' ID="Root">' ELSE '' END AS html FROM pages),
        d AS (SELECT *, ltrim(lower(regexp_extract(url, '://([^/?#]*)', 1)), 'w.') AS domain FROM t)
      SELECT page_id, domain, CASE
        WHEN regexp_matches(domain, '({"|".join(x.replace(".", "[.]") for x in P.DYNAMIC_DOMAINS)})$') THEN 'dynamic'
        WHEN regexp_matches(domain, '({"|".join(x.replace(".", "[.]") for x in P.STATIC_DOMAINS)})$') THEN 'static'
        WHEN regexp_matches(html, '(?i){"|".join(x.replace("'", "''") for x in P.SCRIPT_FINGERPRINTS)}') THEN 'dynamic'
        WHEN page_id % 15 = 14 THEN 'dynamic' ELSE 'static' END AS page_type FROM d""",
}
