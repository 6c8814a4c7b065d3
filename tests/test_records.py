"""Cleaning, reshaping, duplicates and sources on literal rows."""

from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gleanframe.operators import clean, dedup, reshape
from gleanframe.sources import crawl_log, responses, tables


def test_exact_duplicates(spark):
    people = spark.createDataFrame([("Alice", 30), ("Bob", 25), ("Alice", 30)], "name string, age int")
    assert rows(dedup.deduplicate(people)) == [("Alice", 30), ("Bob", 25)]
    assert dedup.deduplicate(people.where("false")).count() == 0
    assert rows(dedup.find_duplicates(people, ["name"])) == [("Alice", 2)]
    assert rows(dedup.duplicate_rows(people, ["name"])) == [("Alice", 30, 2), ("Alice", 30, 2)]


def test_first_row_per_key(spark):
    seen = spark.createDataFrame(
        [(2, "a", "A again"), (0, "a", "A"), (1, "b", "B"), (3, None, "x"), (4, None, "y")], "n int, url string, title string")
    assert rows(dedup.deduplicate(seen, ["url"], ["n"])) == [(0, "a", "A"), (1, "b", "B"), (3, None, "x")]
    with pytest.raises(ValueError):
        dedup.deduplicate(seen, ["url"])


def test_maps_can_be_deduplicated(spark):
    maps = spark.createDataFrame([({"a": "1", "b": "2"},), ({"b": "2", "a": "1"},), ({"a": "1"},)], "m map<string,string>")
    assert dedup.deduplicate(maps).count() == 2


def test_absent_keys_differ_from_null_keys(spark):
    maps = spark.createDataFrame(
        [(0, {"id": None, "x": "1"}), (1, {"x": "2"}), (2, {"x": "3"}), (3, {"id": "7"}), (4, {"id": None})],
        "n int, fields map<string,string>")
    assert rows(dedup.deduplicate_records(maps, "fields", ["id"], ["n"]).select("n")) == [(0,), (1,), (3,)]


def test_merge(spark):
    left = spark.createDataFrame([(1,), (2,)], "id int")
    right = spark.createDataFrame([(2, "late"), (3, "new")], "id int, note string")
    assert rows(dedup.merge_and_deduplicate(left, right, key_fields=["id"])) == [(1, None), (2, None), (3, "new")]
    assert dedup.merge_and_deduplicate(left, left).count() == 2


def test_fingerprint_ignores_order_but_not_copies(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    b = spark.createDataFrame([(2, None), (1, "x")], "i int, s string")
    assert rows(dedup.fingerprint(a)) == rows(dedup.fingerprint(b))
    assert rows(dedup.fingerprint(a)) != rows(dedup.fingerprint(a.unionByName(b)))


MESSY = "name string, tags array<string>, specs array<struct<k:string,v:int>>, ok boolean, meta struct<a:int,b:string>, note string, price double"


def test_clean_records(spark):
    spec = [(f"k{i}", i) for i in range(4)]
    table = spark.createDataFrame([
        (" Ann ", ["x", "y"], spec, True, (1, None), "  ", 1.5),
        ("Bob", [], None, False, None, None, None),
        ("only", None, [], None, None, "", None),
        ("Cy", ["z"], spec[:1], None, (2, "q"), "n", 2.0),
    ], MESSY)
    assert rows(clean.clean_records(table)) == [
        ("Ann", "x, y", "k:k0, v:0; k:k1, v:1; k:k2, v:2; k:k3, v:3",
         "Yes", "a: 1, b: None", "", "1.5"),
        ("Bob", "N/A", "N/A", "No", "N/A", "N/A", "N/A"),
        ("Cy", "z", "k:k0, v:0", "N/A", "a: 2, b: q", "n", "2.0"),
    ]


def test_clean_records_drops_columns_above_four_fifths(spark):
    table = spark.createDataFrame(
        [("a", "b", "x" if i < 2 else "", "y" if i < 1 else None) for i in range(10)], "a string, b string, c string, d string")
    assert clean.clean_records(table).columns == ["a", "b", "c"]
    numbers = spark.createDataFrame([(1, 2.5, "t")], "i int, d double, s string")
    assert clean.clean_records(numbers).dtypes == numbers.dtypes


def test_clean_records_returns_the_input_when_nothing_survives(spark):
    table = spark.createDataFrame([(" a ", None), ("b", "")], "a string, b string")
    assert rows(clean.clean_records(table)) == rows(table)


def test_clean_record_maps(spark):
    table = spark.createDataFrame(
        [(i, {"a": " x ", "b": "" if i else "y", "c": None if i else "z"}) for i in range(6)] + [(9, {"a": "lonely"})],
        "i int, fields map<string,string>")
    cleaned = rows(clean.clean_record_maps(table))
    assert cleaned == [(0, {"a": "x", "b": "y", "c": "z"})]
    table = spark.createDataFrame([(0, {"a": "1", "b": "2"}), (1, {"a": "1", "b": "2", "c": ""})], "i int, fields map<string,string>")
    assert rows(clean.clean_record_maps(table)) == [(0, {"a": "1", "b": "2"}), (1, {"a": "1", "b": "2"})]


@pytest.mark.parametrize("n, filled, kept", [(5, 1, True), (5, 0, False), (10, 1, True), (20, 3, True), (20, 2, False)])
def test_clean_dataframe_limit_in_double_arithmetic(spark, n, filled, kept):
    table = spark.createDataFrame([(1.0, "c" if i < filled else None) for i in range(n)], "a double, c string")
    assert ("c" in clean.clean_dataframe(table).columns) == kept


def test_clean_dataframe_fills_and_strips(spark):
    table = spark.createDataFrame([(1, " x ", True), (None, "", None), (3, None, False)], "i int, s string, b boolean")
    assert rows(clean.clean_dataframe(table)) == [("1.0", "x", "True"), ("3.0", "N/A", "False"), ("N/A", "", "N/A")]


def test_coerce_numeric_needs_sixty_percent(spark):
    table = spark.createDataFrame([
        (i, "$1,200" if i < 12 else "n/a", "$1,200" if i < 11 else "n/a", "(5.50) each" if i % 2 else "-3 +") for i in range(20)
    ] + [(i, "n/a", "$7", "x") for i in range(20, 90)], "n int, yes string, no string, mixed string")
    head = table.where("n < 20")
    found = clean.coerce_numeric(head)
    assert dict(found.dtypes) == {"n": "int", "yes": "double", "no": "string", "mixed": "string"}
    assert rows(found.select("yes").distinct()) == [(1200.0,), (None,)]
    # The whole column decides, whatever its first values are.
    whole = clean.coerce_numeric(table)
    assert dict(whole.dtypes)["no"] == "double" and dict(whole.dtypes)["yes"] == "string"


def test_flatten(spark):
    nested = spark.createDataFrame(
        [("Test", ("A", ["x", "y"], (True,)), [1.0, 1e16], [("q", None)])],
        "name string, meta struct<category:string,tags:array<string>,deep:struct<on:boolean>>, nums array<double>, items array<struct<k:string,v:int>>")
    flat = reshape.flatten(nested)
    assert flat.columns == ["name", "meta_category", "meta_tags", "meta_deep_on", "nums", "items"]
    assert flat.first()[2:] == ("x | y", True, "1.0 | 1e+16", "{'k': 'q', 'v': None}")
    clash = spark.createDataFrame([(("first",), "second")], "a struct<b:string>, a_b string")
    assert rows(reshape.flatten(clash)) == [("second",)]


def test_plain_values_become_one_column(spark):
    assert reshape.records_to_df(spark.createDataFrame([(1,), (2,)], "x int")).columns == ["value"]


def test_widen(spark):
    table = spark.createDataFrame([(1, {"b": "2", "a": "1"}), (2, {"c": None, "id": "9"}), (3, None)], "id int, fields map<string,string>")
    wide = reshape.widen(table)
    assert wide.columns == ["id", "a", "b", "c", "fields_id"]
    assert rows(wide) == [(1, "1", "2", None, None), (2, None, None, None, "9"), (3, None, None, None, None)]
    with pytest.raises(ValueError):
        reshape.widen(table, max_columns=2)
    assert reshape.widen(table, keys=["c", "zz"]).columns == ["id", "c", "zz"]


def test_maps_are_flattened(spark):
    table = spark.createDataFrame([(1, {"b": "2", "a": "1"}), (2, {}), (3, None)], "id int, fields map<string,string>")
    assert rows(reshape.flatten(table, map_keys={"fields": ["a", "c"]})) == [(1, "1", None), (2, None, None), (3, None, None)]
    assert rows(reshape.flatten(table.where("id > 1"))) == [(2, "{}"), (3, None)]
    assert '"b":"2"' in reshape.flatten(table).where("id = 1").first()["fields"]


def test_names(spark):
    table = spark.createDataFrame([(1, 2, 3)], "x int, y int, z int")
    assert reshape.drop_duplicate_columns(table.toDF("a", "b", "a")).columns == ["a", "b"]
    renamed = reshape.normalize_column_names(table.toDF("Net Worth ($)", "_Id_", "net worth"))
    assert renamed.columns == ["net_worth", "id"] and renamed.first()[0] == 3


def test_conform(spark):
    table = spark.createDataFrame([("t", 5)], "title string, salary int")
    assert reshape.conform(table, "job").first().asDict() == {
        "title": "t", "company": None, "location": None, "salary": "5", "description": None}
    assert dict(reshape.conform(table, "article").dtypes)["tags"] == "array<string>"


@pytest.mark.parametrize("raw, expected", [
    ('```json\n[{"a":1},{"a":2},3]\n```', [1, 2]),
    ('Sure: {"a": 5} done', [5]),
    ('{"a": 9, "results": [{"a":1}], "items": [{"a":2}]}', [1]),
    ('{"items": 3, "quotes": [{"a":4}]}', [4]),
    ('{"data": [1, 2]}', []),
    ('{"data": {"a": 1}, "a": 7}', [7]),
    ('text [1, {"a":3}] more', [3]),
    ('broken {"a": ', []), ("42", []), ("null", []), ("", []), ("[]", []),
    ('[bad] then {"a": 6}', [6]),
])
def test_parse_json_records(spark, raw, expected):
    df = spark.createDataFrame([(1, raw)], "id long, raw string")
    found = responses.parse_json_records(df).select(F.try_variant_get("record", "$.a", "int").alias("a"), "pos").orderBy("pos")
    assert [r["a"] for r in found.collect()] == expected


def test_round_trips(spark, tmp_path):
    scores = spark.createDataFrame([("Zoë", 100), ("Bob", None)], "name string, score int")
    tables.write_json(scores, f"{tmp_path}/json")
    assert rows(spark.read.schema(scores.schema).json(f"{tmp_path}/json")) == rows(scores)
    products = spark.createDataFrame([("Widget, \"big\"", 9.99, ["x", "y"])], "product string, price double, tags array<string>")
    tables.write_csv(products, f"{tmp_path}/csv")
    assert rows(tables.read_csv(spark, f"{tmp_path}/csv")) == [("Widget, \"big\"", 9.99, "x | y")]
    texts = ['he said "hi", ok', "two\nlines", "\r\n", '"', " padded\t", "back\\slash", '\\"', ",", "#", "'", None]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    tables.write_csv(table, f"{tmp_path}/texts")
    assert rows(tables.read_csv(spark, f"{tmp_path}/texts", schema="i int, t string")) == rows(table)
    gaps = spark.createDataFrame([(str(i), None if i else "v") for i in range(9)], "a string, b string")
    tables.write_csv(gaps, f"{tmp_path}/gaps")
    cleaned = tables.read_csv(spark, f"{tmp_path}/gaps", clean=True)
    assert ("0", "v") in [tuple(map(str, r)) for r in cleaned.collect()] and ("3", "N/A") in [tuple(map(str, r)) for r in cleaned.collect()]


def test_pages_from_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>one</p>\n<p>two</p>")
    page = tables.read_pages(spark, f"{tmp_path}/*.html", format="html").first()
    assert page["html"] == "<p>one</p>\n<p>two</p>" and page["url"].endswith("a.html")


def test_freshness(spark):
    log = spark.createDataFrame([
        ("a", datetime(2024, 1, 1, 9, 0, 0), "old"), ("a", datetime(2024, 1, 1, 11, 0, 0), "new"),
        ("b", datetime(2024, 1, 1, 9, 59, 59), "just too old"), ("c", datetime(2024, 1, 1, 10, 0, 0), "at the limit"),
        ("d", None, "né")], "url string, ts timestamp_ntz, payload string")
    as_of = datetime(2024, 1, 1, 11, 0, 0)
    assert rows(crawl_log.fresh_rows(log, as_of).select("url", "payload")) == [("a", "new"), ("c", "at the limit")]
    assert crawl_log.freshness_stats(log, as_of).first()[:] == (5, 2, 3, 33)


def test_pages_of_equal_ids_stay_files_of_their_own(spark, tmp_path):
    from gleanframe.queries.records import QUERIES

    spark.createDataFrame([(i % 3, "u", f"page {i}") for i in range(30)], "page_id long, url string, html string").coalesce(1).write.parquet(
        f"{tmp_path}/pages.parquet")
    found = QUERIES["html_folder"](spark, str(tmp_path)).collect()
    assert len(found) == 30 and len({r["html_md5"] for r in found}) == 30 and {r["page_id"] for r in found} == {0, 1, 2}


def test_pages_are_files_of_few_folders(spark, tmp_path, monkeypatch):
    from gleanframe.queries.records import QUERIES

    pages = spark.createDataFrame(
        [(i, "u", f"<p>é {i}</p>\n") for i in range(200)] + [(7, "u", "once more"), (-3, "u", None), (5, "u", ""), (None, "u", "no id")],
        "page_id long, url string, html string").repartition(5)
    tables.write_pages(pages, f"{tmp_path}/folder")
    parts = list((tmp_path / "folder").iterdir())
    assert 1 <= len(parts) <= 5 and all(f.is_file() for part in parts for f in part.iterdir())
    assert sum(len(list(part.iterdir())) for part in parts) == 204
    read = tables.read_pages(spark, f"{tmp_path}/folder/part=*", format="html", nested=True)
    assert sorted(r["html"] for r in read.collect()) == sorted((r["html"] or "") + "\n" for r in pages.collect())
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = rows(QUERIES["html_folder"](spark, str(tmp_path)))
    assert len(found) == 204 and {r[0] for r in found} == {None, -3, *range(200)} and (-3, 1) in [r[:2] for r in found]
    monkeypatch.setattr(tables, "_is_local", lambda spark, path: False)
    assert rows(QUERIES["html_folder"](spark, str(tmp_path))) == found
