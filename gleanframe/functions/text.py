"""String expressions; each takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import WHITESPACE

_FLOAT = r"(?i)^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity|nan)$"


def strip(col: Column) -> Column:
    """Remove white space at both ends, Unicode spaces included."""
    return F.btrim(col, F.lit(WHITESPACE))


def parse_money(col: Column) -> Column:
    """Number behind ``, $ £ ₹ %``; null where the rest is no number.

    The pattern guard keeps out what a cast alone accepts (``12.5d``).
    """
    bare = strip(F.translate(col.cast("string"), ",$£₹%", ""))
    return F.when(bare.rlike(_FLOAT), bare.try_cast("double"))


def domain(url: Column) -> Column:
    """Lower-case network location with leading ``w`` and ``.`` characters removed."""
    location = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.coalesce(F.ltrim(F.lower(location), F.lit("w.")), F.lit(""))


def valid_url(url: Column) -> Column:
    """True for text starting with an http or https scheme."""
    return F.coalesce(url.startswith("http://") | url.startswith("https://"), F.lit(False))


def trim_content(col: Column, max_chars: int = 4000) -> Column:
    """Cut at ``max_chars``, backing up to the last line break past 70 % of it."""
    head = F.substring(col, 1, max_chars)
    from_end = F.locate("\n", F.reverse(head))
    last_break = F.lit(max_chars) - from_end
    backed_up = (from_end > 0) & (last_break > max_chars * 0.7)
    return (
        F.when(F.length(col) <= max_chars, col)
        .when(backed_up, F.substring(head, F.lit(1), last_break))
        .otherwise(head)
    )


def estimate_tokens(col: Column) -> Column:
    """A quarter of the character count, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(col) / 4)).cast("long")


def humanize(col: Column) -> Column:
    """Underscores to spaces and a capital at the start of every run of letters."""
    runs = F.regexp_extract_all(F.replace(col, F.lit("_"), F.lit(" ")), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(
        F.transform(
            runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))
        ),
        "",
    )


def normalize_name(col: Column) -> Column:
    """Lower case, anything but letters, digits and ``_`` to ``_``, outer ``_`` removed."""
    return F.btrim(F.regexp_replace(F.lower(col), r"[^a-zA-Z0-9_]", "_"), F.lit("_"))


def extract_all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def _float_text(col: Column) -> Column:
    """Shortest decimal text with Python's switch to exponents (1e16 up, below 1e-4)."""
    text = col.cast("string")
    plain = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(.*)E", 1), r"\.0$", "")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    sign = F.when(power < 0, "-").otherwise("+")
    digits = F.abs(power).cast("string")
    exponent = F.concat(F.lit("e"), sign, F.when(F.length(digits) < 2, "0").otherwise(""), digits)
    size = F.abs(col)
    return (
        F.when(F.isnan(col), "nan")
        .when(size == float("inf"), F.when(col > 0, "inf").otherwise("-inf"))
        .when(~text.contains("E"), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, exponent))
    )


def value_text(col: Column, dtype: T.DataType, quote: bool = False) -> Column:
    """Text of a value as a Python program prints it, nested values included.

    ``quote`` marks strings inside a list or mapping, which print quoted.
    """
    if isinstance(dtype, T.BooleanType):
        text = F.when(col, "True").otherwise("False")
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = _float_text(col.cast("double") if isinstance(dtype, T.DoubleType) else col)
    elif isinstance(dtype, T.StringType):
        text = _quoted(col) if quote else col
    elif isinstance(dtype, T.ArrayType):
        items = F.transform(col, lambda x: value_text(x, dtype.elementType, quote=True))
        text = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(dtype, T.StructType):
        parts = [
            F.concat(F.lit(f"'{f.name}': "), value_text(col[f.name], f.dataType, quote=True))
            for f in dtype.fields
        ]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(dtype, T.MapType):
        items = F.transform(
            F.map_entries(col),
            lambda e: F.concat(
                value_text(e["key"], dtype.keyType, quote=True),
                F.lit(": "),
                value_text(e["value"], dtype.valueType, quote=True),
            ),
        )
        text = F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))
    else:
        text = col.cast("string")
    return F.when(col.isNull(), "None").otherwise(text)


def _quoted(col: Column) -> Column:
    body = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    body = F.replace(F.replace(F.replace(body, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")),
                     F.lit("\t"), F.lit("\\t"))
    double = F.concat(F.lit('"'), body, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(col.contains("'") & ~col.contains('"'), double).otherwise(single)


def money_name(name: str, words: tuple[str, ...]) -> bool:
    return any(word in name.lower() for word in words)
