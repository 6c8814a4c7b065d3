"""Queries over sources, cleaning, reshaping and duplicates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.patterns import WHITESPACE, WRAPPER_KEYS
from ..operators import clean, dedup, reshape
from ..session import load, load_spread, shared_dir, spread_tasks
from ..sources import crawl_log, responses, tables
from .sqltext import strings

AS_OF = datetime(2024, 1, 29, 12, 0, 0)
TTL = 48 * 3600


def _csv_round_trip(spark, sf):
    path = shared_dir(spark, "csv")
    tables.write_csv(load_spread(spark, sf, "customer"), path)
    return tables.read_csv(spark, path)


def _csv_texts(spark, sf):
    """Whole texts with quotes, commas and line breaks, and a map flattened by its keys."""
    path = shared_dir(spark, "csv")
    marked = F.concat(F.lit('"'), "text", F.lit('", he said:\n\\ '), "lang")
    tables.write_csv(
        load_spread(spark, sf, "documents").select("doc_id", marked.alias("text"), F.create_map(
            F.lit("lang"), "lang", F.lit("from"), "source").alias("origin")),
        path, map_keys={"origin": ["lang", "from"]})
    return tables.read_csv(spark, path, schema="doc_id long, text string, origin_lang string, origin_from string")


def _csv_nested_round_trip(spark, sf):
    path = shared_dir(spark, "csv")
    tables.write_csv(_nested(spark, sf), path)
    return tables.read_csv(spark, path, schema="order_id long, customer_key long, customer_rank string, marks string")


def _json_round_trip(spark, sf):
    path = shared_dir(spark, "json")
    source = load_spread(spark, sf, "orders").select(
        "o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("o_orderstatus"), "o_totalprice")
    tables.write_json(source, path)
    return spark.read.schema(source.schema).json(path)


def _responses(spark, sf):
    """Raw responses of every shape, made from the JSON properties of events."""
    props = F.col("props")
    shapes = [
        F.concat(F.lit("```json\n["), props, F.lit(", "), props, F.lit(", 7]\n```")),
        F.concat(F.lit("Here it is: "), props, F.lit(" as asked.")),
        F.concat(F.lit('{"note": 1, "data": 5, "items": ['), props, F.lit('], "jobs": ['), props, F.lit(", "), props, F.lit("]}")),
        F.concat(F.lit("The list [1, "), props, F.lit("] was found")),
        F.concat(F.lit("broken { "), props),
        props,
        F.lit("42"),
    ]
    picked = F.get(F.array(*shapes), (F.col("event_id") % len(shapes)).cast("int"))
    return load_spread(spark, sf, "events").select("event_id", picked.alias("raw"))


def _parsed(spark, sf):
    records = responses.parse_json_records(_responses(spark, sf), key="event_id")
    return records.select(
        "event_id", "pos",
        F.try_variant_get("record", "$.k", "bigint").alias("k"),
        F.try_variant_get("record", "$.note", "bigint").alias("note"),
    )


def _nested(spark, sf):
    return load_spread(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.struct(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("rank")).alias("customer"),
        F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("marks"),
    )


def _log(spark, sf):
    return load_spread(spark, sf, "events").select(
        F.col("user_id").alias("url"), "ts", "event_id", F.col("props").alias("payload"))


def _messy(spark, sf):
    """Orders as uneven records: lists, mappings, booleans, blanks and rare columns."""
    n = F.col("o_orderkey")
    some = lambda k, col: F.when(n % k == 0, col)
    return load_spread(spark, sf, "orders").select(
        some(3, n).alias("id"),
        some(2, F.concat(F.lit("  "), "o_orderpriority", F.lit("\t"))).alias("priority"),
        F.when(n % 5 == 0, "").otherwise(F.expr("nullif(o_orderstatus, 'P')")).alias("status"),
        some(7, n % 2 == 0).alias("even"),
        some(10, F.lit("rare")).alias("rare"),
        F.when(n % 4 == 0, F.array().cast("array<string>"))
        .when(n % 4 == 1, F.array("o_orderstatus", "o_orderpriority")).alias("tags"),
        F.when(n % 4 < 2, F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(
            i.alias("no"), F.col("o_orderstatus").alias("s")))).alias("specs"),
    )


def _gappy(spark, sf):
    n = F.col("c_custkey")
    return load_spread(spark, sf, "customer").select(
        "c_custkey",
        F.when(n % 4 != 0, F.concat(F.lit(" "), "c_name", F.lit("\n"))).alias("name"),
        F.when(n % 3 == 0, F.col("c_nationkey")).alias("nation"),
        F.when(n % 5 == 0, "x").alias("fifth"),
        F.when(n % 6 == 0, "").otherwise("").alias("empty"),
        F.when(n % 7 == 0, F.lit("y")).alias("seventh"),
    )


def _money_text(spark, sf):
    n = F.col("c_custkey")
    amount = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    return load_spread(spark, sf, "customer").select(
        "c_custkey",
        F.when(n % 5 == 3, "n/a").otherwise(F.concat(F.lit("$ "), amount)).alias("mostly"),
        F.when(n % 2 == 0, "n/a").otherwise(F.concat(F.lit("$ "), amount)).alias("half"),
        F.concat(F.lit("+["), F.regexp_replace(amount, r"\.", ",0."), F.lit(" ]")).alias("bracketed"),
        "c_mktsegment",
    )


def _loose_money(spark, sf):
    v, i = F.col("value").cast("string"), F.col("event_id") % 7
    return load_spread(spark, sf, "events").select(
        "event_id",
        X.parse_money(
            F.when(i == 0, F.concat(F.lit("$"), v)).when(i == 1, F.concat(F.lit(" ₹1,"), v, F.lit("% ")))
            .when(i == 2, F.concat(v, F.lit("d"))).when(i == 3, F.concat(F.lit("€"), v))
            .when(i == 4, F.concat(v, F.lit("e1"))).when(i == 5, "n/a").otherwise(F.concat(F.lit("-£"), v))
        ).alias("number"),
    )


def _event_maps(spark, sf):
    return load_spread(spark, sf, "events").select(
        "event_id",
        F.map_concat(
            F.from_json("props", "map<string,string>"),
            F.create_map("event_type", F.col("value").cast("decimal(18,2)").cast("string")),
        ).alias("fields"),
    )


def _key_records(spark, sf):
    """Records where the key fields are absent, null or present."""
    n = F.col("event_id")
    user = F.create_map(F.lit("user"), F.col("user_id").cast("string"))
    fields = F.when(n % 3 == 0, user).when(n % 3 == 1, F.create_map(F.lit("user"), F.lit(None).cast("string")))
    return load_spread(spark, sf, "events").select(
        "event_id",
        F.map_concat(F.coalesce(fields, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))),
                     F.create_map(F.lit("type"), "event_type")).alias("fields"),
    )


def _html_folder(spark, sf):
    """The pages written by Spark as a folder of files, a page each, and read back from it."""
    path = shared_dir(spark, "html-folder")
    tables.write_pages(load_spread(spark, sf, "pages"), path)
    # Spark reads few files a task, as it adds a cost to each; the pages are read by as many tasks as wrote them.
    pages = tables.read_pages(spark, f"{path}/part=*", format="html", nested=True).coalesce(
        spread_tasks(load(spark, sf, "pages")) or spark.sparkContext.defaultParallelism)
    return pages.select(F.regexp_extract("url", r"page_id=(-?\d+)", 1).try_cast("long").alias("page_id"),
                        F.length("html").cast("long").alias("chars"), F.md5(F.col("html").cast("binary")).alias("html_md5"))


QUERIES = {
    "html_folder": _html_folder,
    "read_pages": lambda spark, sf: tables.read_pages(spark, f"{sf}/pages.parquet").select(
        "page_id", "url", F.length("html").cast("long").alias("chars")),
    "read_csv": _csv_round_trip,
    "write_csv": _csv_nested_round_trip,
    "csv_texts": _csv_texts,
    "write_json": _json_round_trip,
    "parse_json_records": _parsed,
    "records_to_df": lambda spark, sf: reshape.records_to_df(_nested(spark, sf)),
    "fresh_rows": lambda spark, sf: crawl_log.fresh_rows(_log(spark, sf), AS_OF, TTL),
    "freshness_stats": lambda spark, sf: crawl_log.freshness_stats(_log(spark, sf), AS_OF, TTL),
    "flatten": lambda spark, sf: reshape.flatten(_nested(spark, sf)),
    "flatten_maps": lambda spark, sf: reshape.flatten(_event_maps(spark, sf), map_keys={"fields": ["k", "view"]}),
    "clean_records": lambda spark, sf: clean.clean_records(_messy(spark, sf)),
    "clean_record_maps": lambda spark, sf: clean.clean_record_maps(load(spark, sf, "orders").select("o_orderkey", F.create_map(
        F.lit("status"), F.expr("nullif(o_orderstatus, 'P')"), F.lit("priority"), F.concat(F.lit(" "), "o_orderpriority"),
        F.concat(F.lit("note "), (F.col("o_orderkey") % 50).cast("string")), F.lit("rare")).alias("fields"))).select(
            "o_orderkey", F.explode("fields").alias("name", "value")),
    "clean_dataframe": lambda spark, sf: clean.clean_dataframe(_gappy(spark, sf)),
    "coerce_numeric": lambda spark, sf: clean.coerce_numeric(_money_text(spark, sf)),
    "parse_money": _loose_money,
    "drop_duplicate_columns": lambda spark, sf: reshape.drop_duplicate_columns(
        load(spark, sf, "nation").select("n_name", "n_nationkey", F.lower("n_name").alias("n_name"))),
    "normalize_column_names": lambda spark, sf: reshape.normalize_column_names(
        load_spread(spark, sf, "customer").select(
            F.col("c_custkey").alias("Customer Key"), F.col("c_name").alias("_NAME_"),
            F.col("c_acctbal").alias("Balance ($)"), F.col("c_mktsegment").alias("name"))),
    "normalize_names": lambda spark, sf: load(spark, sf, "part").select(
        "p_partkey", X.normalize_name(F.concat(F.lit(" "), "p_brand", F.lit(" / "), "p_name", F.lit("?"))).alias("name")),
    "conform": lambda spark, sf: reshape.conform(
        load(spark, sf, "part").select(
            F.col("p_name").alias("name"), F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
            F.col("p_type").alias("description"), "p_size"), "product"),
    "valid_url": lambda spark, sf: load_spread(spark, sf, "pages").select(
        "page_id", X.valid_url(F.col("url")).alias("plain"), X.valid_url(F.upper("url")).alias("upper"),
        X.valid_url(F.concat(F.lit(" "), "url")).alias("padded")),
    "widen": lambda spark, sf: reshape.widen(
        _event_maps(spark, sf), keys=["k", "click", "error", "purchase", "signup", "view"]),
    "domain": lambda spark, sf: load_spread(spark, sf, "pages").select(
        "page_id", X.domain(F.col("url")).alias("domain"),
        X.domain(F.replace("url", F.lit("://"), F.lit("://WWW.we."))).alias("www"),
        X.domain(F.replace("url", F.lit(".com"), F.lit(".com:8080"))).alias("port")),
    "deduplicate": lambda spark, sf: dedup.deduplicate(
        load_spread(spark, sf, "documents").select("text", "lang")).select(F.md5("text").alias("digest"), "lang"),
    "deduplicate_by_key": lambda spark, sf: dedup.deduplicate(
        load_spread(spark, sf, "documents").select("doc_id", "text", "source"), ["text"], ["doc_id"]
    ).select("doc_id", "source"),
    "deduplicate_records": lambda spark, sf: dedup.deduplicate_records(
        _key_records(spark, sf), "fields", ["user", "id"], ["event_id"]).select("event_id"),
    "merge_and_deduplicate": lambda spark, sf: dedup.merge_and_deduplicate(
        load_spread(spark, sf, "customer").where("c_custkey % 2 = 0").select("c_nationkey", "c_mktsegment", "c_custkey"),
        load_spread(spark, sf, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_name"),
        key_fields=["c_nationkey", "c_mktsegment"], order_by=["c_custkey"]),
    "find_duplicates": lambda spark, sf: dedup.find_duplicates(
        load_spread(spark, sf, "documents"), ["text"]).select(F.md5("text").alias("digest"), "copies"),
    "duplicate_rows": lambda spark, sf: dedup.duplicate_rows(
        load_spread(spark, sf, "documents"), ["text"]).select("doc_id", "copies"),
    "fingerprint": lambda spark, sf: dedup.fingerprint(load_spread(spark, sf, "orders").drop("o_orderdate")),
}

_KINDS = strings(["array", "object"])
_BARE = r"regexp_replace({0}, '[\$£€₹¥,\[\]\(\)\+]', '', 'g')"
_WS = strings([WHITESPACE])


def _number(column: str) -> str:
    return rf"try_cast(nullif(regexp_extract(trim({_BARE.format(column)}), '(-?\d+\.?\d*)', 1), '') AS DOUBLE)"


_WRAPPED = ", ".join(
    f"CASE WHEN json_type(v, '$.{k}') = 'ARRAY' THEN json_extract(v, '$.{k}[*]') END" for k in WRAPPER_KEYS)

ORACLES = {
    # A file of text ends in a line break.
    "html_folder": """SELECT page_id, length(coalesce(html, '')) + 1 AS chars, md5(coalesce(html, '') || chr(10)) AS html_md5
      FROM pages""",
    "read_pages": "SELECT page_id, url, length(html) AS chars FROM pages",
    "read_csv": "SELECT c_custkey::INTEGER AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "write_csv": """SELECT o_orderkey AS order_id, o_custkey AS customer_key, o_orderpriority AS customer_rank,
      o_orderstatus || ' | ' || o_orderpriority[1] AS marks FROM orders""",
    "csv_texts": r"""SELECT doc_id, '"' || text || E'", he said:\n\\ ' || lang AS text, lang AS origin_lang, source AS origin_from
      FROM documents""",
    "flatten_maps": """SELECT event_id, props::JSON->>'$.k' AS fields_k,
      CASE WHEN event_type = 'view' THEN (value::DECIMAL(18,2))::VARCHAR END AS fields_view FROM events""",
    "write_json": "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice FROM orders",
    "parse_json_records": rf"""WITH raw AS (SELECT event_id, CASE event_id % 7
        WHEN 0 THEN E'```json\n[' || props || ', ' || props || E', 7]\n```' WHEN 1 THEN 'Here it is: ' || props || ' as asked.'
        WHEN 2 THEN '{{"note": 1, "data": 5, "items": [' || props || '], "jobs": [' || props || ', ' || props || ']}}'
        WHEN 3 THEN 'The list [1, ' || props || '] was found' WHEN 4 THEN 'broken {{ ' || props WHEN 5 THEN props ELSE '42' END AS raw
        FROM events),
      txt AS (SELECT event_id, trim(regexp_replace(regexp_replace(trim(raw), '^```(?:json)?\s*', ''), '\s*```$', '')) AS t FROM raw),
      v AS (SELECT event_id, CASE WHEN json_valid(t) THEN t::JSON
          WHEN json_valid(regexp_extract(t, '(?s)\[.*\]')) THEN regexp_extract(t, '(?s)\[.*\]')::JSON
          WHEN json_valid(regexp_extract(t, '(?s)\{{.*\}}')) THEN regexp_extract(t, '(?s)\{{.*\}}')::JSON END AS v FROM txt),
      items AS (SELECT event_id, CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]')
          WHEN 'OBJECT' THEN coalesce({_WRAPPED}, [v]) END AS l FROM v),
      rows AS (SELECT event_id, unnest(l) AS r, generate_subscripts(l, 1) AS pos FROM items)
      SELECT event_id, pos, (r->>'$.k')::BIGINT AS k, (r->>'$.note')::BIGINT AS note FROM rows WHERE json_type(r) = 'OBJECT'""",
    "records_to_df": """SELECT o_orderkey AS order_id, o_custkey AS customer_key, o_orderpriority AS customer_rank,
      o_orderstatus || ' | ' || o_orderpriority[1] AS marks FROM orders""",
    "fresh_rows": f"""SELECT url, ts, event_id, payload FROM (
        SELECT user_id AS url, ts, event_id, props AS payload, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn
        FROM events) WHERE rn = 1 AND epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) <= {TTL}::BIGINT * 1000000""",
    "freshness_stats": f"""SELECT count(*) AS total_entries,
        count(*) FILTER (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) <= {TTL}::BIGINT * 1000000) AS valid_entries,
        count(*) FILTER (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) > {TTL}::BIGINT * 1000000) AS expired_entries,
        sum(strlen(props))::BIGINT AS size_bytes FROM events""",
    "flatten": """SELECT o_orderkey AS order_id, o_custkey AS customer_key, o_orderpriority AS customer_rank,
      o_orderstatus || ' | ' || o_orderpriority[1] AS marks FROM orders""",
    # Blank shares known from the construction: rare 90 % and even 6/7 go, the others stay.
    "clean_record_maps": """SELECT o_orderkey, 'status' AS name, coalesce(nullif(o_orderstatus, 'P'), 'N/A') AS value FROM orders
      UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders""",
    "clean_records": r"""WITH m AS (SELECT o_orderkey AS n,
        CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS id,
        CASE WHEN o_orderkey % 2 = 0 THEN '  ' || o_orderpriority || E'\t' END AS priority,
        CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE nullif(o_orderstatus, 'P') END AS status,
        CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 2 = 0 END AS even,
        CASE WHEN o_orderkey % 10 = 0 THEN 'rare' END AS rare,
        CASE WHEN o_orderkey % 4 = 0 THEN []::VARCHAR[] WHEN o_orderkey % 4 = 1 THEN [o_orderstatus, o_orderpriority] END AS tags,
        CASE WHEN o_orderkey % 4 < 2 THEN 'no:1, s:' || o_orderstatus || '; no:2, s:' || o_orderstatus || '; no:3, s:' || o_orderstatus || '; no:4, s:' || o_orderstatus END AS specs
        FROM orders),
      kept AS (SELECT * FROM m WHERE (id IS NOT NULL)::INT + (priority IS NOT NULL)::INT + (coalesce(status, '') <> '')::INT
        + (even IS NOT NULL)::INT + (rare IS NOT NULL)::INT + (len(coalesce(tags, [])) > 0)::INT + (specs IS NOT NULL)::INT >= 2)
      SELECT coalesce(id::VARCHAR, 'N/A') AS id, coalesce(trim(priority, E' \t'), 'N/A') AS priority,
        CASE WHEN coalesce(status, '') = '' THEN 'N/A' ELSE status END AS status,
        CASE WHEN len(coalesce(tags, [])) = 0 THEN 'N/A' ELSE array_to_string(tags, ', ') END AS tags,
        coalesce(specs, 'N/A') AS specs FROM kept""",
    # A third and a quarter of the rows stay; a fifth is above int(n * 0.19999999999999996), a seventh below.
    "clean_dataframe": r"""SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_name ELSE 'N/A' END AS name,
        CASE WHEN c_custkey % 3 = 0 THEN c_nationkey::DOUBLE::VARCHAR ELSE 'N/A' END AS nation,
        CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE 'N/A' END AS fifth, '' AS empty FROM customer""",
    "coerce_numeric": rf"""WITH m AS (SELECT c_custkey, c_mktsegment,
        CASE WHEN c_custkey % 5 = 3 THEN 'n/a' ELSE '$ ' || c_acctbal::DECIMAL(12,2) END AS mostly,
        CASE WHEN c_custkey % 2 = 0 THEN 'n/a' ELSE '$ ' || c_acctbal::DECIMAL(12,2) END AS half,
        '+[' || replace((c_acctbal::DECIMAL(12,2))::VARCHAR, '.', ',0.') || ' ]' AS bracketed FROM customer)
      SELECT c_custkey, c_mktsegment, {_number('mostly')} AS mostly, half, {_number('bracketed')} AS bracketed FROM m""",
    "parse_money": r"""SELECT event_id, CASE event_id % 7 WHEN 0 THEN value WHEN 1 THEN ('1' || value)::DOUBLE
        WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN (value::VARCHAR || 'e1')::DOUBLE WHEN 5 THEN NULL ELSE -value END AS number FROM events""",
    "drop_duplicate_columns": "SELECT n_name, n_nationkey FROM nation",
    "normalize_column_names": "SELECT c_custkey AS customer_key, c_acctbal AS balance, c_mktsegment AS name FROM customer",
    "normalize_names": r"""SELECT p_partkey, trim(regexp_replace(lower(' ' || p_brand || ' / ' || p_name || '?'), '[^a-zA-Z0-9_]', '_', 'g'), '_') AS name
      FROM part""",
    "conform": """SELECT p_name AS name, (p_retailprice::DECIMAL(12,2))::VARCHAR AS price, NULL::VARCHAR AS currency,
      p_type AS description, NULL::VARCHAR AS rating, NULL::VARCHAR AS availability FROM part""",
    "valid_url": r"""SELECT page_id, regexp_matches(url, '^https?://') AS plain, regexp_matches(upper(url), '^https?://') AS upper,
      regexp_matches(' ' || url, '^https?://') AS padded FROM pages""",
    "widen": """SELECT event_id, props::JSON->>'$.k' AS k, """ + ", ".join(
        f"CASE WHEN event_type = '{t}' THEN (value::DECIMAL(18,2))::VARCHAR END AS {t}"
        for t in ("click", "error", "purchase", "signup", "view")) + " FROM events",
    "domain": r"""SELECT page_id, ltrim(lower(regexp_extract(url, '://([^/?#]*)', 1)), 'w.') AS domain,
      ltrim('www.we.' || lower(regexp_extract(url, '://([^/?#]*)', 1)), 'w.') AS www,
      ltrim(lower(regexp_extract(replace(url, '.com', '.com:8080'), '://([^/?#]*)', 1)), 'w.') AS port FROM pages""",
    "deduplicate": "SELECT DISTINCT md5(text) AS digest, lang FROM documents",
    "deduplicate_by_key": """SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
      FROM documents) WHERE rn = 1""",
    "deduplicate_records": """SELECT min(event_id) AS event_id FROM (SELECT event_id,
        CASE event_id % 3 WHEN 0 THEN 'user:' || user_id WHEN 1 THEN 'null' ELSE 'none' END AS k FROM events) GROUP BY k""",
    "merge_and_deduplicate": """SELECT c_nationkey, c_mktsegment, c_custkey, c_name FROM (
        SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY t, c_custkey) AS rn FROM (
          SELECT 0 AS t, c_nationkey, c_mktsegment, c_custkey, NULL AS c_name FROM customer WHERE c_custkey % 2 = 0
          UNION ALL SELECT 1, c_nationkey, c_mktsegment, c_custkey, c_name FROM customer)) WHERE rn = 1""",
    "find_duplicates": "SELECT md5(text) AS digest, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1",
    "fingerprint": """SELECT sum(('0x' || substring(md5(concat_ws(chr(31), o_orderkey, o_custkey, o_orderstatus, o_totalprice,
        o_orderpriority)), 1, 15))::BIGINT)::VARCHAR AS fingerprint, count(*) AS rows FROM orders""",
    "duplicate_rows": """SELECT doc_id, copies FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS copies FROM documents)
      WHERE copies > 1""",
}
