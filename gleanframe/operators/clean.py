"""Record and table cleaning.

Which columns stay is decided from one aggregate over the table; everything
after that is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import quoted, string_columns
from ..functions.text import strip, value_text
from .profile import one_row

# Share of missing values above which a column is dropped, and the
# text put in place of a missing value.
MISSING_SHARE = 0.8
FILL = "N/A"

# What may surround a number in text, and the number itself.
MONEY_SIGNS = r"[\$£€₹¥,\[\]\(\)\+]"
WHOLE_NUMBER = r"^-?\d+\.?\d*$"
FIRST_NUMBER = r"(-?\d+\.?\d*)"
NUMERIC_SHARE = 0.6


def _is_real(col: Column, dtype: T.DataType) -> Column:
    real = col.isNotNull()
    if isinstance(dtype, T.StringType):
        real = real & (col != "")
    elif isinstance(dtype, (T.ArrayType, T.MapType)):
        real = real & (F.size(col) > 0)
    return real


def _is_blank(col: Column, dtype: T.DataType) -> Column:
    return (col.isNull() | (col == "")) if isinstance(dtype, T.StringType) else col.isNull()


def _pairs(col: Column, dtype: T.StructType, colon: str) -> Column:
    return F.concat_ws(", ", *[
        F.concat(F.lit(f"{f.name}{colon}"), value_text(col[f.name], f.dataType)) for f in dtype.fields
    ])


def _map_pairs(col: Column, dtype: T.MapType, colon: str) -> Column:
    return F.array_join(
        F.transform(F.map_entries(col), lambda e: F.concat(
            value_text(e["key"], dtype.keyType), F.lit(colon), value_text(e["value"], dtype.valueType))),
        ", ",
    )


def _flat_text(col: Column, dtype: T.DataType, has_gaps: bool, nested_records: int | None) -> Column:
    """The cleaned value: nested values as text, gaps filled, text stripped."""
    if isinstance(dtype, T.ArrayType):
        item = dtype.elementType
        whole = value_text(col, dtype)
        if isinstance(item, T.StringType):
            flat = F.when(F.exists(col, lambda x: x.isNull()), whole).otherwise(F.array_join(col, ", "))
        elif isinstance(item, (T.StructType, T.MapType)):
            pairs = _pairs if isinstance(item, T.StructType) else _map_pairs
            shown = F.transform(
                col if nested_records is None else F.slice(col, 1, nested_records), lambda x: pairs(x, item, ":"))
            flat = F.when(F.exists(col, lambda x: x.isNull()), whole).otherwise(F.array_join(shown, "; "))
        else:
            flat = whole
        return F.when(F.size(col) > 0, flat).otherwise(FILL)
    if isinstance(dtype, T.StructType):
        return F.when(col.isNotNull(), _pairs(col, dtype, ": ")).otherwise(FILL)
    if isinstance(dtype, T.MapType):
        return F.when(col.isNotNull(), _map_pairs(col, dtype, ": ")).otherwise(FILL)
    if isinstance(dtype, T.BooleanType):
        return F.when(col, "Yes").when(~col, "No").otherwise(FILL)
    if isinstance(dtype, T.StringType):
        return F.when(col.isNull() | (col == ""), FILL).otherwise(strip(col))
    if has_gaps:
        return F.when(col.isNull(), FILL).otherwise(value_text(col, dtype))
    return col


def clean_records(df: DataFrame, nested_records: int | None = None) -> DataFrame:
    """Rows with two or more real values, without columns that are mostly blank.

    A value is real unless it is null, an empty string, list or map. If no row
    has two, the table comes back unchanged. A column goes when more than 80 %
    of the remaining rows hold null or an empty string in it. Lists and
    mappings become text, booleans Yes or No, gaps ``N/A``, and text is
    stripped; numbers stay numbers unless their column has gaps to fill. Of a list
    of records the first ``nested_records`` are shown, all without it.
    """
    fields = df.schema.fields
    cols = {f.name: F.col(quoted(f.name)) for f in fields}
    real = sum((_is_real(cols[f.name], f.dataType).cast("int") for f in fields), F.lit(0))
    kept = df.where(real >= 2)
    counts = one_row(kept, [F.count("*"), *[F.count_if(_is_blank(cols[f.name], f.dataType)) for f in fields]])
    rows, blanks = counts[0], counts[1:]
    if rows == 0:
        return df
    chosen = [(f, blank) for f, blank in zip(fields, blanks) if blank / rows <= MISSING_SHARE]
    if not chosen:
        return kept.where(F.lit(False)).select()
    return kept.select(*[_flat_text(cols[f.name], f.dataType, blank > 0, nested_records).alias(f.name) for f, blank in chosen])


def clean_record_maps(df: DataFrame, column: str = "fields") -> DataFrame:
    """The same rules where a record is a map of texts with its own set of keys.

    Keys a record lacks stay absent. Key shares come from one job over the
    exploded keys, combined on the map side; only the keys that stay reach the driver. Each is in a fifth
    of the records or more, so there are at most five times as many as a record has on average.
    """
    col = F.col(quoted(column))
    real = F.size(F.map_filter(col, lambda _, v: v.isNotNull() & (v != "")))
    kept = df.where(real >= 2)
    rows = kept.count()
    if rows == 0:
        return df
    names = F.map_keys(F.map_filter(col, lambda _, v: v.isNotNull() & (v != "")))
    shares = kept.select(F.explode(names).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    common = [r["k"] for r in shares.where((F.lit(rows) - F.col("n")) / F.lit(rows) <= MISSING_SHARE).select("k").collect()]
    cleaned = F.transform_values(
        F.map_filter(col, lambda k, _: k.isin(common) if common else F.lit(False)),
        lambda _, v: F.when(v.isNull() | (v == ""), FILL).otherwise(strip(v)),
    )
    return kept.withColumn(column, cleaned).where(F.size(quoted(column)) > 0)


def clean_dataframe(df: DataFrame) -> DataFrame:
    """Drop columns that are mostly null, fill the rest with ``N/A``, strip text.

    A column stays with at least ``max(1, int(n * (1 - 0.8)))`` values, in
    double arithmetic. An empty string is a value here. A numeric column with
    gaps turns into text, whole numbers then showing a decimal point.
    """
    fields = df.schema.fields
    counts = one_row(df, [F.count("*"), *[F.count(quoted(f.name)) for f in fields]])
    rows, filled = counts[0], counts[1:]
    if rows == 0:
        return df
    needed = max(1, int(rows * (1 - MISSING_SHARE)))
    columns = []
    for field, count in zip(fields, filled):
        col = F.col(quoted(field.name))
        if count < needed:
            continue
        if isinstance(field.dataType, T.StringType):
            col = strip(F.coalesce(col, F.lit(FILL)))
        elif count < rows:
            if isinstance(field.dataType, T.NumericType):
                text = value_text(col.cast("double"), T.DoubleType())
            else:
                text = value_text(col, field.dataType)
            col = F.when(col.isNull(), FILL).otherwise(strip(text))
        columns.append(col.alias(field.name))
    return df.select(*columns)


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Turn string columns that mostly hold numbers into doubles.

    Judged by the whole column: 60 % of its values must be a number once currency signs,
    brackets, commas, plus signs and spaces are gone. A converted value is the
    first number left in its text, else null.
    """
    names = string_columns(df)
    if not names:
        return df
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(quoted(c)).alias("v")) for i, c in enumerate(names)])
    values = df.select(F.inline(pairs)).where(F.col("v").isNotNull())
    bare = F.regexp_replace("v", MONEY_SIGNS + r"|\s", "")
    judged = values.groupBy("i").agg(F.count("*").alias("n"), F.count_if(bare.rlike(WHOLE_NUMBER)).alias("hits"))
    numeric = {names[r["i"]] for r in judged.collect() if r["hits"] >= r["n"] * NUMERIC_SHARE}
    return df.select(*[
        _first_number(F.col(quoted(c))).alias(c) if c in numeric else F.col(quoted(c)) for c in df.columns
    ])


def min_length_filter(df: DataFrame, text: str = "text", min_length: int = 20) -> DataFrame:
    """Rows whose stripped text has at least ``min_length`` characters; null has none."""
    return df.where(F.length(strip(F.coalesce(F.col(quoted(text)), F.lit("")))) >= min_length)


def _first_number(col: Column) -> Column:
    bare = strip(F.regexp_replace(col, MONEY_SIGNS, ""))
    return F.regexp_extract(bare, FIRST_NUMBER, 1).try_cast("double")
