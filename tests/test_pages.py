"""HTML pages on literal rows."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gleanframe.operators import pages as P


def page(spark, html, url="https://x.org/"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def text(spark, html, **kw):
    return P.pages_to_text(page(spark, html), **kw).first()["text"]


def test_text_without_code_and_comments(spark):
    html = "<h1>Head</h1><script>var a</script><style>p{}</style><!-- no --><p>One &amp; two<br>three</p><svg><text>x</text></svg>"
    assert text(spark, html) == "Head\nOne & two\nthree"
    assert text(spark, "") == "" and P.pages_to_text(page(spark, None)).first()["text"] == ""


def test_frames_go_only_when_marked_as_noise(spark):
    html = "<nav class='top-menu'>a</nav><nav>b</nav><footer id=share>c</footer><aside class=menuitem>d</aside><p>e</p>"
    assert text(spark, html) == "b\nd\ne"


def test_main_region_order(spark):
    assert text(spark, "<div id=maincol>by id</div><article>art</article>") == "art"
    assert text(spark, "<article>art</article><main>m</main>") == "m"
    assert text(spark, "<div class='x blog-post'>cls</div><div id=the-body>id</div><p>rest</p>") == "id"
    assert text(spark, "<div class='x blog-post'>cls</div><p>rest</p>") == "cls"
    assert text(spark, "<div id=maincol>by id</div><article>art</article>", region="all") == "by id\nart"


def test_white_space(spark):
    assert text(spark, "<p>  a \t b\n\n\n\n c  </p><p> </p><p>d</p>") == "a b\n\nc\nd"


def test_reader_view(spark):
    read = lambda html, url="https://x.org": P.main_content(page(spark, html, url)).first()["text"]
    long, middle = "word " * 120, "text " * 50
    assert read(f"<head><title>t</title></head><nav>n</nav><article>{long}</article>") == long.strip()
    assert read(f"<article>short</article><div class=Sidebar>{long}</div><section>{middle}</section>") == middle.strip()
    assert read("<body><article>short</article><div>few</div><p>last</p></body>") == "short\nfew\nlast"
    wiki = "<div id=mw-content-text><p>Fact[1] here[23]</p><div class='big navbox'>links</div></div><p>out</p>"
    assert read(wiki, "https://en.wikipedia.org/wiki/X") == "Fact here"
    assert read(wiki) == "Fact[1] here[23]\nout"


def test_short_pages_fall_back_to_all_text(spark):
    html = "<title>T</title><header>H</header><script>s</script><p>p</p>"
    assert P.page_content(page(spark, html)).first()["text"] == "T\nH\np"
    assert P.page_content(page(spark, html), min_length=20).count() == 0


def test_metadata(spark):
    html = ("<title> A &lt; B </title><meta name=Description content=one><meta name=description content=two>"
            "<meta property='OG:title' content=og><link rel='alternate' href=no><link rel='CANONICAL canonical' href=/c>")
    assert P.page_metadata(page(spark, html)).first()[2:] == ("A < B", "two", "", "/c", "og", "")
    assert P.page_titles(page(spark, "<TITLE lang=x> a &amp; b</title>")).first()[1] == "a &amp; b"


def test_tables(spark):
    html = """<table><tr><th>Name</th><th></th><th>Net Worth ($)</th></tr>
      <tr><td>Ann</td><td>x</td><td>5</td></tr><tr><td>Bob</td></tr><tr><td></td><td></td></tr><tr><td></td><td>y</td></tr>
      <tr><td>Cy</td><td></td><td>7</td></tr></table>
      <table><tr><td> </td></tr><tr><td>a</td><td>b</td></tr></table>
      <table><tr><td>outer</td><td>k</td></tr><tr><td>v<table><tr><th>in</th></tr><tr><td>1</td><td>2</td></tr></table></td><td>w</td></tr></table>"""
    found = [(r["table_no"], r["fields"]) for r in P.extract_tables(page(spark, html)).orderBy("table_no", "row_no").collect()]
    assert found == [
        # The blank heading shifts the names of the columns after it.
        (0, {"name": "Ann", "net_worth": "x"}), (0, {"net_worth": "y"}), (0, {"name": "Cy"}),
        (2, {"outer": "vin12", "k": "in"}), (2, {"outer": "1", "k": "2"}),
        (3, {"in": "1"}),
    ]


def test_lists(spark):
    html = f"""<header class=item><h2>no</h2><p>no</p></header>
      <div class="Product"><h3>Lamp</h3><b class=cost>9 EUR</b><i class="star-5">5/5</i><p>{'d' * 300}</p><a>no</a><a href=/2>x</a></div>
      <div class=card><span class=headingline>Desk</span> only <i>$ 1</i>,200.50 now</div>
      <div class=result><h1>alone</h1></div>"""
    found = [r["fields"] for r in P.extract_lists(page(spark, html)).orderBy("row_no").collect()]
    assert found == [
        {"title": "Lamp", "price": "9 EUR", "rating": "5/5", "description": "d" * 300},
        {"title": "Desk", "price": "$ 1,200.50"},
    ]


def test_containers_are_limited_on_request(spark):
    html = "".join(f"<div class=item><h2>t{i}</h2><p>d</p></div>" for i in range(60))
    assert P.extract_lists(page(spark, html)).count() == 60
    assert P.extract_lists(page(spark, html), P.R.Limits(items=50)).count() == 50


INFO = """<table class="infobox vcard"><tr><th>Born</th><td>1815 <b>London</b></td></tr><tr><td>one</td></tr>
  <tr><th></th><td>x</td></tr><tr><th>{k}</th><td>long key</td></tr><tr><th>Note</th><td>{v}</td></tr></table>"""


def test_infobox_and_priority(spark):
    html = INFO.format(k="k" * 50, v="v" * 250) + "<div class=card><h2>a</h2><p>b</p></div>"
    fields = P.extract_infobox(page(spark, html)).first()["fields"]
    assert fields == {"born": "1815London", "k" * 50: "long key", "note": "v" * 250}
    fields = P.extract_infobox(page(spark, html), P.R.Limits(label=49, value=200)).first()["fields"]
    assert fields == {"born": "1815London", "note": "v" * 200}
    pick = lambda h, url: {r["strategy"] for r in P.extract_records(page(spark, h, url)).collect()}
    assert pick(html, "https://en.wikipedia.org/wiki/A") == {"infobox"}
    assert pick(html, "https://x.org") == {"tables"}
    assert pick("<div class=card><h2>a</h2><p>b</p></div>", "https://en.wikipedia.org/wiki/A") == {"lists"}
    assert pick("<p>nothing</p>", "https://x.org") == set()


def test_page_records_are_cleaned_per_page(spark):
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    rare = "<table>" + row("a", "b", "rare") + "".join(row(f"{i // 2}", "x", "r" if i == 0 else "") for i in range(12)) + "</table>"
    lone = "<table>" + row("a", "b") + row("", "only") + "</table>"
    table = spark.createDataFrame([(1, "u", rare), (2, "u", lone), (3, "u", "<p>x</p>")], "page_id long, url string, html string")
    found = P.page_records(table)
    assert found.columns == ["page_id", "url", "row_no", "field", "value"]
    found = found.groupBy("page_id", "url", "row_no").pivot("field", ["a", "b"]).agg(F.first("value"))
    # Page 1 drops its rare column and its duplicate rows; page 2 has no row with two values and stays as it is.
    assert rows(found) == sorted([(1, "u", i + 1, str(i), "x") for i in range(6)] + [(2, "u", 1, None, "only")], key=repr)


def test_cleaned_arrays_follow_the_share_of_blanks(spark):
    from gleanframe.operators.clean import FILL, MISSING_SHARE

    table = []
    for size in (1, 2, 4, 5, 6, 9, 10, 11, 15, 30, 35):
        for filled in range(0, 9):
            records = [{"a": str(i // 2), "b": "x", "c": "y" if i < filled else (None if i % 2 else "")} for i in range(size)]
            table.append((len(table), records + [{"a": "lone"}]))
    table += [(900, []), (901, [{"a": "1"}, {"b": ""}, {"a": "1"}])]
    out = dict(P._cleaned_array(spark.createDataFrame(table, "id long, m array<map<string,string>>"), "m").collect())
    for key, records in table:
        kept = [r for r in records if sum(v not in (None, "") for v in r.values()) >= 2]
        names = {k for r in kept for k in r}
        gone = {k for k in names if sum(r.get(k) in (None, "") for r in kept) / len(kept) > MISSING_SHARE}
        clean = [{k: v or FILL for k, v in r.items() if k not in gone} for r in kept] if kept else records
        want = [r for i, r in enumerate(clean) if r not in clean[:i]]
        assert out[key] == want, key


@pytest.mark.parametrize("url, html, kind", [
    ("https://en.wikipedia.org/wiki/A", "window.__STORE__", "static"),
    ("https://www.reddit.com/r/x", "", "dynamic"),
    ("https://netflix.com/", "", "dynamic"),
    ("https://app.org/", "<div class=x id=\"APP\">", "dynamic"),
    ("https://app.org/", "<script src='react.js'>", "dynamic"),
    ("https://blog.org/", "<p>plain</p>", "static"),
    ("https://x.com.evil.org/", None, "static"),
])
def test_page_types(spark, url, html, kind):
    assert P.classify_pages(page(spark, html, url)).first()["page_type"] == kind


def test_content_type_decides_last(spark):
    served = page(spark, "").withColumn("ct", F.lit("Application/JSON"))
    assert P.classify_pages(served, "ct").first()["page_type"] == "dynamic"


def test_no_page_ends_the_job(spark):
    table = spark.createDataFrame(
        [(1, "u", "<p>a<![foo[x]]>b</p>"), (2, "u", "<p>good</p>"), (3, "u", "<p>x<![if IE"), (4, "u", None)],
        "page_id long, url string, html string")
    found = {r["page_id"]: (r["text"], r["error"]) for r in P.parse_pages(table, "text", "records").collect()}
    assert found[1] == ("a\nb", "malformed declaration") and found[2] == ("good", None) and found[4] == ("", None)
    assert found[3][0].startswith("x")
    # Whatever the rules stumble over, the page stays and says so.
    values, error = P._read_page(["text", "records"], None, "u", P.R.Limits())
    assert values == ["", []] and error.startswith("TypeError")
    assert 1 in {r["page_id"] for r in P.page_errors(table).collect()}


def test_tolerant_parsing(spark):
    assert text(spark, "<p>a<b>b</p>c</b>d<br/>e</i>f < g") == "a\nb\nc\nd\ne\nf < g"
    assert text(spark, "<div/>x<ruby>k<rt>hidden</rt></ruby><template><p>t</p></template>") == "x\nk"


def _tree(node):
    return node if isinstance(node, str) else (node.name, node.attrs, [_tree(c) for c in node.children])


def test_plain_markup_gives_the_parsers_tree():
    from gleanframe.functions import html as H

    plain = [
        "", "text &amp; more", "<!DOCTYPE html><p CLASS=a id='b c'>x<br>y<br/> \n <b/>z</p> t",
        "<table><tr><td>1<td>2</table>a</b>", "<pre> \n</pre> \n <!-- a - b --><i disabled>é</i >",
        "<script>var t = '</p>' < 1</script><style> </style><a href='?a=1' B=2 b=\"3\">&lt;</a>",
    ]
    other = ["a < b", "<![x]>", "<a href='?a&amp;b'>x</a>", "<script>never closed", "<p", "<!--a--b-->", "<a b='<'>", "<?x?>"]
    for html in plain + other:
        builder = H._Builder()
        builder.feed(html)
        builder.close()
        assert (H._plain(html) is not None) == (html in plain), html
        assert _tree(H.parse(html)[0]) == _tree(builder.root), html


def test_cells_of_nested_tables_belong_to_all_rows_around_them():
    from gleanframe.functions import html as H
    from gleanframe.functions import page_rules as R

    html = "<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td><table><tr><th>c</th></tr><tr><td>2</td><td>3</td></tr></table></td></tr></table>"
    assert R.table_records(H.parse(html)[0]) == [(0, 0, {"a": "1", "b": "c23"}), (0, 2, {"a": "2", "b": "3"}), (1, 0, {"c": "2"})]


def test_cleaned_records_of_a_page_follow_the_table_rule(spark):
    from gleanframe.functions import page_rules as R

    cases = [
        [{"a": "x", "b": " y "}, {"b": "y", "a": "x"}], [{"a": ""}, {"a": ""}, {"b": "x"}], [],
        [{"a": "x", "b": "y", "c": ""}, {"c": "", "a": "x", "b": "z"}, {"a": "1"}],
        [{"a": str(i), "b": "y", **({"rare": "1"} if i < 2 else {}), **({"one": "1"} if i == 5 else {})} for i in range(10)],
    ]
    table = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id long, m array<map<string,string>>")
    native = dict(P._cleaned_array(table, "m").collect())
    for i, case in enumerate(cases):
        assert R.clean_records(case, P.MISSING_SHARE, P.FILL) == native[i]


def test_pages_are_parsed_a_bounded_slice_at_a_time(monkeypatch):
    monkeypatch.setattr(P, "SLICE_BYTES", 10)
    monkeypatch.setattr(P, "SLICE_ROWS", 3)
    batch = P.pa.RecordBatch.from_pydict({"html": ["x" * n for n in (4, 4, 4, 50, 1, 0, 0, 0, 0, 9)]})
    found = [part.column(0).to_pylist() for part in P._slices(batch, 0)]
    assert [len(f) for f in found] == [2, 1, 1, 3, 3] and sum(found, []) == batch.column(0).to_pylist()
    assert list(P._slices(batch.slice(0, 0), 0)) == []


def test_spread_tables_get_more_tasks_with_their_size(spark, tmp_path, monkeypatch):
    from gleanframe import session

    spark.range(100000).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    monkeypatch.setattr(session, "SPREAD_BYTES", 20000)
    spread = session.load_spread(spark, str(tmp_path), "t")
    sizes = [r["count"] for r in spread.groupBy(P.F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 1.5 * 100000 / len(sizes) and spread.distinct().count() == 100000
