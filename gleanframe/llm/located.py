"""Places of pattern matches in texts, by built-in functions only.

A match's place follows from the lengths of the matches and of the pieces
between them, so each text is scanned by a pattern once, and a second time only
if it has matches. Places count code points; ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pinned

SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int,found:string>>"
# Lengths are added up in blocks, so that a text of many matches takes no quadratic time.
_BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """A pattern (linear in the text) and what its matches must meet."""

    name: str
    pattern: str
    holds: Callable[[Column], Column]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def locate(docs: DataFrame, keep: list[str], text: str, kinds: list[Kind],
           holds: Callable[[Kind, Column], Column] | None = None) -> DataFrame:
    """``keep`` columns and ``spans``, in the order of start and kind; null text has none.

    ``holds`` replaces the kinds' own test where that needs other columns.
    """
    test = holds or (lambda kind, found: kind.holds(found))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = pinned(docs, *keep, **({} if text in keep else {text: F.col(text)}), **{
        f"_m{i}": F.regexp_extract_all(body, F.lit(k.pattern), F.lit(0)) for i, k in enumerate(kinds)})
    own = list(dict.fromkeys([*keep, text]))
    matches = [f"_m{i}" for i in range(len(kinds))]
    rows = pinned(rows, *own, *matches, **{
        f"_s{i}": F.when(F.size(f"_m{i}") > 0, F.zip_with(
            F.transform(F.slice(F.split(F.col(text), k.pattern, -1), F.lit(1), F.size(f"_m{i}")), F.length),
            F.transform(f"_m{i}", F.length), lambda a, b: a + b)).otherwise(F.array().cast("array<int>"))
        for i, k in enumerate(kinds)})
    steps = [f"_s{i}" for i in range(len(kinds))]

    def sums(i: int) -> Column:
        blocks = F.sequence(F.lit(0), ((F.size(f"_s{i}") - 1) / _BLOCK).cast("int"))
        return F.transform(blocks, lambda b: _total(F.slice(F.col(f"_s{i}"), b * _BLOCK + 1, F.lit(_BLOCK))))

    rows = pinned(rows, *own, *matches, *steps, **{f"_b{i}": sums(i) for i in range(len(kinds))})

    def before(i: int) -> Column:
        return F.transform(F.col(f"_b{i}"), lambda _, b: _total(F.slice(F.col(f"_b{i}"), F.lit(1), b)))

    rows = pinned(rows, *own, *matches, *steps, **{f"_c{i}": before(i) for i in range(len(kinds))})

    def spans(i: int, kind: Kind) -> Column:
        def span(found: Column, at: Column) -> Column:
            block = F.floor(at / _BLOCK).cast("int")
            end = F.element_at(F.col(f"_c{i}"), block + 1) + _total(
                F.slice(F.col(f"_s{i}"), block * _BLOCK + 1, at - block * _BLOCK + 1))
            return F.struct((end - F.length(found)).alias("start"), F.lit(i).alias("kind_no"), F.lit(kind.name).alias("kind"),
                            end.alias("end"), found.alias("found"))

        # Places are added up only for the matches that hold.
        held = F.filter(F.transform(F.col(f"_m{i}"), lambda found, at: F.struct(found.alias("found"), at.alias("at"))),
                        lambda m: test(kind, m["found"]))
        return F.transform(held, lambda m: span(m["found"], m["at"])).cast(SPAN)

    found = F.array_sort(F.concat(*[spans(i, k) for i, k in enumerate(kinds)]))
    return rows.select(*keep, found.alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def outside(spans: Column, others: Column) -> Column:
    """The spans that touch none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))


def replaced(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """The text with every span cut out and its label put in its place; of overlapping spans the first gives the label."""
    def reach(i: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(F.slice(spans, F.lit(1), i), lambda s: s["end"])), F.lit(0))

    def piece(span: Column, i: Column) -> Column:
        done = reach(i)
        return F.concat(F.when(span["start"] > done, F.substring(text, done + 1, span["start"] - done)).otherwise(""),
                        F.when(span["start"] >= done, label(span)).otherwise(""))

    rest = F.substring(text, reach(F.size(spans)) + 1, F.length(text))
    return F.concat(F.array_join(F.transform(spans, piece), ""), rest)
