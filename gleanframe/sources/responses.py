"""Records out of raw text responses that hold JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pinned
from ..functions.patterns import WRAPPER_KEYS
from ..functions.text import strip


def _unfenced(raw: Column) -> Column:
    """The text without a Markdown code fence around it."""
    opened = F.regexp_replace(strip(raw), r"^```(?:json)?\s*", "")
    return strip(F.regexp_replace(strip(opened), r"\s*```$", ""))


def _widest(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def parse_json_records(df: DataFrame, column: str = "raw", key: str = "id") -> DataFrame:
    """``key, pos, record`` for every JSON object a response holds; records are variants.

    The whole text is tried first, then the widest bracketed and the widest
    braced part. A list gives its objects. An object gives the objects of the
    first list found under a wrapper key, or itself. Anything else gives none.
    """
    text = pinned(df, key, text=_unfenced(F.col(column)))
    parsed = pinned(text, key, v=F.coalesce(
        F.try_parse_json("text"),
        F.try_parse_json(_widest(F.col("text"), r"\[[\s\S]*\]")),
        F.try_parse_json(_widest(F.col("text"), r"\{[\s\S]*\}")),
    ))
    read = pinned(
        parsed, key, "v",
        as_list=F.try_variant_get("v", "$", "array<variant>"),
        as_object=F.try_variant_get("v", "$", "map<string,variant>"),
    )
    # Most objects hold none of the wrapper keys and need no further look.
    wrapped = F.coalesce(*[
        F.try_variant_get(F.try_element_at("as_object", F.lit(k)), "$", "array<variant>") for k in WRAPPER_KEYS
    ])
    holds_key = F.arrays_overlap(F.map_keys("as_object"), F.array(*[F.lit(k) for k in WRAPPER_KEYS]))
    own = F.array("v")
    items = F.coalesce("as_list", F.when(holds_key, F.coalesce(wrapped, own)).when(~holds_key, own))
    return (
        pinned(read, key, items=items)
        .select(key, F.posexplode("items").alias("i", "record"))
        .where(F.try_variant_get("record", "$", "map<string,variant>").isNotNull())
        .select(key, (F.col("i") + 1).cast("long").alias("pos"), "record")
    )
