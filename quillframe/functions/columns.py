"""Column classes, coercion, binning and small shared expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# Values fixed by the result contract: which texts count as the positive class of an outcome.
POSITIVE_RATE_VALUES = ("yes", "true", "1", "1.0", "survived", "subscribed")
POSITIVE_TARGET_VALUES = ("yes", "true", "1", "1.0", "survived", "subscribed", "positive")


# Date texts read besides ISO ones, months before days; the shape says which format is tried.
DATE_FORMATS = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d\d$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d\d:\d\d$", "M/d/yyyy H:mm:ss"),
    (r"(?i)^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d\d [ap]m$", "M/d/yyyy h:mm a"),
    (r"(?i)^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d\d [ap]m$", "yyyy-M-d h:mm a"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d\d$", "yyyy/M/d H:mm"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
)


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_datetime(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_nested(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f)]


def text_columns(df: DataFrame) -> list[str]:
    """Everything that is neither numeric nor nested; booleans and dates are categories too."""
    return [f.name for f in df.schema.fields if not is_numeric(f) and not is_nested(f)]


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"Unknown column(s): {', '.join(sorted(missing))}")


def col(name: str) -> Column:
    """A column by exact name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite_or_null(value: Column) -> Column:
    """NaN sorts above infinity in Spark, so one comparison rules out both."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def with_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column; other columns pass untouched."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floating:
        return df
    return df.select(*[finite_or_null(col(c)).alias(c) if c in floating else col(c) for c in df.columns])


def as_number(value: Column) -> Column:
    """Unparseable text becomes null; so do NaN, infinities, and literals of other languages such as ``1d`` or ``0x1``."""
    foreign = value.cast("string").rlike(r"(?i)[0-9.][df]\s*$|0x")
    return finite_or_null(F.when(~foreign, value.try_cast("double")))


def measure(df: DataFrame, name: str) -> Column:
    """A numeric column as it is (decimals keep exact sums), any other column coerced."""
    field = df.schema[name]
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return finite_or_null(col(name).cast("double"))
    return col(name) if is_numeric(field) else as_number(col(name))


def as_timestamp(df: DataFrame, name: str) -> Column:
    """Dates as they are; texts by ISO rules or one of ``DATE_FORMATS``.  A text without a date part is null."""
    field = df.schema[name]
    if is_datetime(field):
        return col(name).cast("timestamp_ntz")
    text = F.btrim(col(name).cast("string"))
    iso = F.when(text.rlike(r"^\d{4}(-\d{1,2})?(-\d{1,2}([ T].*)?)?$"), F.try_to_timestamp(text))
    other = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form))) for shape, form in DATE_FORMATS]
    return F.coalesce(iso, *other).cast("timestamp_ntz")


def date_usability(df: DataFrame, name: str) -> DataFrame:
    """One row: how many values parse as dates, and whether that is enough to use the column."""
    parsed = F.count(as_timestamp(df, name))
    rows = F.count(F.lit(1))
    needed = F.greatest(F.lit(3), F.floor(rows * F.lit(0.7)))
    return df.agg(parsed.alias("parsed"), rows.alias("rows"), (parsed >= needed).alias("usable"))


def total(value: Column) -> Column:
    """Sum as double; decimal input is summed exactly before the cast."""
    return F.sum(value).cast("double")


def mean(value: Column) -> Column:
    return F.try_divide(total(value), F.count(value))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * 100, whole)


def strip(value: Column) -> Column:
    """Remove every kind of leading and trailing white space, not only spaces."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def number_label(value: float) -> str:
    return repr(float(value))


def interval_labels(edges: Sequence[float], include_lowest: bool) -> list[str]:
    """Right-closed interval labels; an included lowest edge is shown moved down by 0.001."""
    floats = [float(e) for e in edges]
    integral = all(e.is_integer() for e in floats)
    shown = [number_label(e) for e in floats]
    if include_lowest:
        shown[0] = number_label(round(floats[0] - 0.001, 3))
    elif integral:
        shown = [str(int(e)) for e in floats]
    return [f"({shown[i]}, {shown[i + 1]}]" for i in range(len(floats) - 1)]


def bin_by_edges(
    value: Column, edges: Sequence[float], include_lowest: bool = False, labels: Sequence[str] | None = None
) -> Column:
    """Text label of the right-closed interval a value falls in; null when in none of them."""
    if len(edges) < 2 or list(edges) != sorted(set(edges)):
        raise ValueError("bin edges must increase and number at least two")
    names = list(labels) if labels is not None else interval_labels(edges, include_lowest)
    if len(names) != len(edges) - 1:
        raise ValueError("one label per bin is needed")
    result = F.when(value < F.lit(edges[0]) if include_lowest else value <= F.lit(edges[0]), None)
    for upper, label in zip(edges[1:], names):
        result = result.when(value <= F.lit(upper), F.lit(str(label)))
    return result.otherwise(None)


# Fixed value: what a header slug may not hold.
NOT_IN_SLUG = re.compile("[^a-z0-9_]+")


def normalize_header(raw: str) -> str:
    """Lower case, each run of other characters one underscore, none at the ends; never empty."""
    parts = [part for part in NOT_IN_SLUG.split(str(raw).lower()) if part]
    return "_".join(parts).strip("_") or "column"


def normalize_headers(names: Iterable[str]) -> list[str]:
    """Lower-case slugs; a repeated name gets the first free numbered suffix."""
    taken: set[str] = set()
    result = []
    for raw in names:
        base = normalize_header(raw)
        name, number = base, 1
        while name in taken:
            number += 1
            name = f"{base}_{number}"
        taken.add(name)
        result.append(name)
    return result


def filter_rows(df: DataFrame, filters: Sequence[dict]) -> DataFrame:
    """AND of ``{"column", "op", "value"}`` with op eq / gt / lt; nulls, NaN and infinities never match.

    Bounds against infinity are comparisons of their own, so a scan can use all of them.
    """
    require_columns(df, [f["column"] for f in filters])
    for item in filters:
        value = col(item["column"])
        if isinstance(df.schema[item["column"]].dataType, (T.FloatType, T.DoubleType)) and item["op"] in ("gt", "lt"):
            df = df.filter(value < F.lit(float("inf")) if item["op"] == "gt" else value > F.lit(float("-inf")))
        if item["op"] == "eq":
            df = df.filter(value == F.lit(item["value"]))
        elif item["op"] == "gt":
            df = df.filter(value > F.lit(item["value"]))
        elif item["op"] == "lt":
            df = df.filter(value < F.lit(item["value"]))
        else:
            raise ValueError(f"Unsupported filter: {item['op']}")
    return df
