"""Conservative type inference of text columns: one aggregation for all columns of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what counts as a number or a date, and which integers look like identifiers
INTEGER = r"^[+-]?[0-9]+\z"
DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
DATE = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}\z"
DATETIME = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}[ T][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2}(\.[0-9]+)?)?\z"
ZERO_LED = r"^[+-]?0[0-9]+\z"
LONG_INTEGER, LONG_DECIMAL = 7, 32
#: Layouts of a column of points in time, tried in this order; all values must have one. A fraction may be missing.
LAYOUTS = {"yyyy-M-d H:m:s[.SSSSSS]": r":[0-9]{1,2}:[0-9]{1,2}(\.[0-9]+)?\z", "yyyy-M-d H:m": r" [0-9]{1,2}:[0-9]{1,2}\z"}


def _all(condition: Column, value: Column) -> Column:
    """Every non-null value fulfils the condition."""
    return F.count_if(value.isNotNull() & ~F.coalesce(condition, F.lit(False))) == 0


def dashed(value: Column) -> Column:
    return F.replace(value, F.lit("/"), F.lit("-"))


def stamp(value: Column) -> Column:
    """A point in time with a space between and six places of its fraction at most."""
    return F.regexp_replace(F.replace(dashed(value), F.lit("T"), F.lit(" ")), r"(\.[0-9]{6})[0-9]+\z", "$1")


def in_layout(value: Column, layout: str) -> Column:
    """The value as a point in time, null if it isn't written in the layout."""
    text = F.regexp_replace(stamp(value), r"(\.[0-9]{1,6})\z", "$100000")
    text = F.regexp_replace(text, r"(\.[0-9]{6})[0-9]*\z", "$1")
    return F.when(text.rlike(LAYOUTS[layout]), F.try_to_timestamp(text, F.lit(layout)))


def inferred(value: Column) -> Column:
    """An aggregate: the type of a text column, and its layout after a colon for points in time."""
    is_date = value.rlike(DATE) & F.try_to_date(dashed(value), "yyyy-M-d").isNotNull()
    out = F.when(F.count(value) == 0, "string").when(_all(F.lower(value).isin("true", "false"), value), "boolean_candidate").when(_all(is_date, value), "date")
    for layout in LAYOUTS:
        out = out.when(_all(value.rlike(DATETIME) & in_layout(value, layout).isNotNull(), value), f"datetime:{layout}")
    risky = F.size(risks(value)) > 0
    return (
        out.when(_all(value.rlike(INTEGER), value) & ~risky, "integer")
        .when(_all(value.rlike(DECIMAL) & (F.length(value) <= LONG_DECIMAL), value) & ~risky, "float_candidate")
        .otherwise("string")
    )


def risks(value: Column) -> Column:
    """An aggregate: why a column's numbers look like identifiers."""
    zero = F.count_if(value.rlike(ZERO_LED)) > 0
    long = F.count_if(value.rlike(INTEGER) & (F.length(value) > LONG_INTEGER)) > 0
    return F.array_compact(F.array(F.when(zero, "leading_zero_numeric_text"), F.when(long, "long_numeric_identifier_shape")))


def cast_to(value: Column, kind: str) -> Column:
    """The value as a type that ``inferred`` names."""
    if kind == "boolean_candidate":
        return F.lower(value).try_cast("boolean")
    if kind == "date":
        return F.try_to_date(dashed(value), "yyyy-M-d")
    if kind.startswith("datetime:"):
        return in_layout(value, kind.split(":", 1)[1])
    return value.try_cast({"integer": "bigint", "float_candidate": "double"}.get(kind, "string"))


def infer_types(df: DataFrame) -> DataFrame:
    """(column_name, inferred) for every column, in one pass."""
    one = df.agg(*[F.split(inferred(F.col(f"`{c}`").cast("string")), ":")[0].alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return one.selectExpr(f"stack({len(df.columns)}, {pairs}) as (column_name, inferred)")


def typed(df: DataFrame) -> DataFrame:
    """The table with its columns cast to what their values allow. The driver gets one row."""
    kinds = df.agg(*[inferred(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns]).first().asDict() if df.columns else {}
    return df.select(*[cast_to(F.col(f"`{c}`"), kinds[c]).alias(c) for c in df.columns])
