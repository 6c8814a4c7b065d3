"""Texts, metadata and records out of a table of HTML pages.

Pages are parsed in Arrow batches inside the tasks that read them, a bounded
slice at a time and each page once for all parts asked for. A page's records are
cleaned right after its parse; what follows is native, and only column discovery
looks across pages.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import page_rules as R
from ..functions import patterns as P
from ..functions.html import Node
from ..functions.html import parse as parse_html
from ..functions.numeric import pinned
from ..functions.text import domain, strip
from .clean import FILL, MISSING_SHARE, min_length_filter

# The page rules travel with the task; workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])

_METADATA = ("title", "description", "keywords", "canonical_url", "og_title", "og_description")
_RECORD = "array<struct<strategy:string,table_no:bigint,row_no:bigint,fields:map<string,string>>>"
_ARROW_RECORD = pa.list_(pa.struct([
    ("strategy", pa.string()), ("table_no", pa.int64()), ("row_no", pa.int64()),
    ("fields", pa.map_(pa.string(), pa.string())),
]))
_CLEANED = "array<struct<row_no:bigint,field:string,value:string>>"
_ARROW_CLEANED = pa.list_(pa.struct([("row_no", pa.int64()), ("field", pa.string()), ("value", pa.string())]))
# What a task parses before it hands the rows on: pages, and bytes of their HTML (a longer page is alone).
SLICE_ROWS = 1000
SLICE_BYTES = 4 * 1024 * 1024
_TYPES = {
    "text": ("string", pa.string()),
    "all_text": ("string", pa.string()),
    "main_content": ("string", pa.string()),
    "content": ("string", pa.string()),
    "metadata": (
        "struct<" + ",".join(f"{n}:string" for n in _METADATA) + ">",
        pa.struct([(n, pa.string()) for n in _METADATA]),
    ),
    "records": (_RECORD, _ARROW_RECORD),
    "tables": (_RECORD, _ARROW_RECORD),
    "lists": (_RECORD, _ARROW_RECORD),
    "infobox": (_RECORD, _ARROW_RECORD),
    "cleaned": (_CLEANED, _ARROW_CLEANED),
}


def _read(part: str, root: Node, url: str, limits: R.Limits):
    if part == "text":
        return R.clean_text(root)
    if part == "all_text":
        return R.clean_text(root, main_only=False)
    if part == "main_content":
        return R.main_content(root, url)
    if part == "content":
        return R.page_content(root, url)
    if part == "metadata":
        return R.metadata(root)
    if part == "cleaned":
        maps = [fields for *_, fields in R.page_records(root, url, limits)]
        return [{"row_no": i, "field": field, "value": value}
                for i, fields in enumerate(R.clean_records(maps, MISSING_SHARE, FILL), 1) for field, value in fields.items()]
    if part == "records":
        found = R.page_records(root, url, limits)
    else:
        found = [(part, *record) for record in R.RECORD_RULES[part](root, limits)]
    return [
        {"strategy": s, "table_no": t, "row_no": r, "fields": list(fields.items())} for s, t, r, fields in found
    ]


def _read_page(parts: Sequence[str], html: str, url: str, limits: R.Limits) -> tuple[list, str | None]:
    """The parts of a page, and what was wrong with it; an unreadable page has empty parts."""
    try:
        root, fault = parse_html(html)
        return [_read(part, root, url, limits) for part in parts], fault
    except Exception as error:
        root = Node("[document]", {})
        return [_read(part, root, url, limits) for part in parts], f"{type(error).__name__}: {error}"[:200]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most ``SLICE_ROWS`` rows and about ``SLICE_BYTES`` of the column."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        done = int(ends[start - 1]) if start else 0
        end = int(np.searchsorted(ends, done + SLICE_BYTES, "right"))
        end = min(max(end, start + 1), start + SLICE_ROWS)
        yield batch.slice(start, end - start)
        start = end


def parse_pages(pages: DataFrame, *parts: str, limits: R.Limits = R.Limits()) -> DataFrame:
    """``page_id, url``, the parts asked for and ``error``, one row per page.

    Parts are ``text`` (main region), ``all_text``, ``main_content`` (reader's
    view), ``content`` (the same with a fallback for short pages), ``metadata``,
    the record arrays ``records``, ``tables``, ``lists`` and ``infobox``, and
    ``cleaned``, the fields of the clean, distinct ``records``.
    No page ends the job: ``error`` tells what had to be skipped, or why the
    parts of a page are empty; it is null for a sound page.
    """
    unknown = set(parts) - set(_TYPES)
    if unknown or not parts:
        raise ValueError(f"parts are {', '.join(_TYPES)}")
    source = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"),
                          F.coalesce("html", F.lit("")).alias("html"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, 2)):
            rows: list[list] = [[] for _ in parts]
            errors = []
            for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                values, error = _read_page(parts, html, url, limits)
                for held, value in zip(rows, values):
                    held.append(value)
                errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(held, _TYPES[p][1]) for held, p in zip(rows, parts)],
                 pa.array(errors, pa.string())],
                ["page_id", "url", *parts, "error"],
            )

    schema = ", ".join(["page_id long", "url string", *[f"{p} {_TYPES[p][0]}" for p in parts], "error string"])
    return source.mapInArrow(parse, schema)


def pages_to_text(pages: DataFrame, region: str = "main") -> DataFrame:
    """``page_id, url, text`` of the main region, or of the whole page with ``region='all'``."""
    part = "all_text" if region == "all" else "text"
    return parse_pages(pages, part).select("page_id", "url", F.col(part).alias("text"))


def page_errors(pages: DataFrame) -> DataFrame:
    """``page_id, url, error`` of the pages that were read in part or not at all."""
    return parse_pages(pages, "text").where("error is not null").select("page_id", "url", "error")


def main_content(pages: DataFrame) -> DataFrame:
    return parse_pages(pages, "main_content").select("page_id", "url", F.col("main_content").alias("text"))


def page_content(pages: DataFrame, min_length: int = 0) -> DataFrame:
    """``page_id, url, text``; pages with fewer than ``min_length`` stripped characters are left out."""
    texts = parse_pages(pages, "content").select("page_id", "url", F.col("content").alias("text"))
    return min_length_filter(texts, min_length=min_length) if min_length else texts


def page_metadata(pages: DataFrame) -> DataFrame:
    return parse_pages(pages, "metadata").select("page_id", "url", "metadata.*")


def page_titles(pages: DataFrame) -> DataFrame:
    """``page_id, raw_title`` as written in the page, entities kept: no parse, no Python."""
    raw = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1)
    return pages.select("page_id", strip(raw).alias("raw_title"))


def _exploded(parsed: DataFrame, part: str) -> DataFrame:
    return parsed.select("page_id", "url", F.inline(part))


def extract_tables(pages: DataFrame) -> DataFrame:
    """``page_id, url, table_no, row_no, fields`` of every table row."""
    return _exploded(parse_pages(pages, "tables"), "tables").drop("strategy")


def extract_lists(pages: DataFrame, limits: R.Limits = R.Limits()) -> DataFrame:
    """``page_id, url, row_no, fields`` of product-like elements."""
    return _exploded(parse_pages(pages, "lists", limits=limits), "lists").drop("strategy", "table_no")


def extract_infobox(pages: DataFrame, limits: R.Limits = R.Limits()) -> DataFrame:
    """``page_id, url, fields`` of each page's first infobox."""
    return _exploded(parse_pages(pages, "infobox", limits=limits), "infobox").drop("strategy", "table_no", "row_no")


def extract_records(pages: DataFrame, limits: R.Limits = R.Limits()) -> DataFrame:
    """``page_id, url, strategy, table_no, row_no, fields`` by the first rule that finds records."""
    return _exploded(parse_pages(pages, "records", limits=limits), "records")


def _cleaned_array(df: DataFrame, column: str) -> DataFrame:
    """Clean and deduplicate each row's array of maps in place, by the record-cleaning rules.

    For records that are in a table already; ``R.clean_records`` does the same for a page just parsed.

    One sort tells the keys that enough records fill, another one the records that came before.
    """
    keep = [c for c in df.columns if c != column]
    filled = lambda m: F.map_filter(m, lambda _, v: v.isNotNull() & (v != ""))
    kept = pinned(df, *keep, raw=F.col(column), kept=F.filter(column, lambda m: F.size(filled(m)) >= 2))
    # The least number of records a key must be filled in; rounding decides as for the share itself.
    rows = F.greatest(F.lit(1), F.size("kept"))
    about = F.greatest(F.lit(1), F.floor(rows * (1 - MISSING_SHARE)).cast("int"))
    needed = F.when((rows - about) / rows <= MISSING_SHARE, about).otherwise(about + 1)
    names = pinned(kept, *keep, "raw", "kept", needed=needed, names=F.array_sort(
        F.flatten(F.transform("kept", lambda m: F.map_keys(filled(m))))))
    # In sorted order the same name stands that many places further on.
    shares = pinned(names, *keep, "raw", "kept", common=F.array_distinct(F.filter(
        "names", lambda k, i: F.get("names", i + F.col("needed") - 1) == k)))
    tidy = lambda m: F.transform_values(
        F.map_filter(m, lambda k, _: F.array_contains("common", k)),
        lambda _, v: F.when(v.isNull() | (v == ""), FILL).otherwise(strip(v)))
    chosen = F.when(F.size("kept") == 0, F.col("raw")).otherwise(
        F.filter(F.transform("kept", tidy), lambda m: F.size(m) > 0))
    entries = pinned(shares, *keep, entries=F.transform(chosen, lambda m: F.array_sort(F.map_entries(m))))
    placed = pinned(entries, *keep, "entries", placed=F.array_sort(F.transform(
        "entries", lambda e, i: F.struct(F.to_json(e, {"ignoreNullFields": "false"}).alias("text"), i.alias("i")))))
    first = F.filter("placed", lambda x, j: (j == 0) | (F.get("placed", j - 1)["text"] != x["text"]))
    return pinned(placed, *keep, **{column: F.transform(
        F.array_sort(F.transform(first, lambda x: x["i"])), lambda i: F.map_from_entries(F.get("entries", i)))})


def page_records(pages: DataFrame) -> DataFrame:
    """Clean, distinct records of every page in long form: ``page_id, url, row_no, field, value``.

    Pages name their fields as they like, so fields are rows and not columns,
    and one pass over the pages is enough.
    """
    return _exploded(parse_pages(pages, "cleaned"), "cleaned")


def _ends_with(col: Column, suffixes: Sequence[str]) -> Column:
    found = F.lit(False)
    for suffix in suffixes:
        found = found | col.endswith(suffix)
    return found


def classify_pages(pages: DataFrame, content_type: str | None = None) -> DataFrame:
    """``page_id, url, domain, page_type``: static, or dynamic where a page needs a browser.

    A domain that ends with a known name decides; then script fingerprints in
    the page; then a JSON or script content type, where a column holds it.
    """
    host = pinned(pages, "page_id", "url", "html", *([content_type] if content_type else []), domain=domain(F.col("url")))
    scripted = F.coalesce(F.col("html").rlike("(?i)" + "|".join(P.SCRIPT_FINGERPRINTS)), F.lit(False))
    kind = (
        F.when(_ends_with(F.col("domain"), P.DYNAMIC_DOMAINS), "dynamic")
        .when(_ends_with(F.col("domain"), P.STATIC_DOMAINS), "static")
        .when(scripted, "dynamic")
    )
    if content_type:
        served = F.lower(content_type)
        kind = kind.when(served.contains("javascript") | served.contains("json"), "dynamic")
    return host.select("page_id", "url", "domain", kind.otherwise("static").alias("page_type"))
