"""Cleaning operations: recommend, preview, apply.

An operation is a dict such as ``{"operation": "impute_numeric", "column": "age"}``.  Operations run in
order; each *fits* its few scalars on the table as the earlier ones left it and then transforms
lazily with literals.  ``fit`` returns the operations with their fitted scalars, so a version can be
replayed without looking at the data again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.columns import col, finite_or_null, is_numeric, measure, require_columns, strip
from ..functions.columns import total as total_of
from ..session import local_table
from .profile import Profile, iqr_bounds
from .ranks import exact_quantiles
from .rows import distinct_rows

# Dtype names a conversion may ask for, with their Spark types.
DTYPES = {
    "int": "long", "int64": "long", "Int64": "long", "int32": "int", "Int32": "int",
    "float": "double", "float64": "double", "float32": "float",
    "str": "string", "string": "string", "object": "string", "category": "string",
    "bool": "boolean", "boolean": "boolean",
    "datetime64[ns]": "timestamp_ntz", "datetime64": "timestamp_ntz",
}


def _fit_impute_numeric(df: DataFrame, op: dict) -> dict:
    name = op["column"]
    value = measure(df, name)
    if op.get("strategy", "median") == "median":
        fitted = exact_quantiles(df, {name: value}, [0.5])[name][0.5]
    else:
        row = df.agg(total_of(value).alias("s"), F.count(value).alias("n")).first()
        fitted = row["s"] / row["n"] if row["n"] else None
    return {**op, "value": fitted}


def _apply_impute_numeric(df: DataFrame, op: dict) -> DataFrame:
    name, fitted = op["column"], op["value"]
    if fitted is None:
        return df
    field = df.schema[name]
    whole = isinstance(field.dataType, T.IntegralType) and float(fitted).is_integer()
    present = finite_or_null(col(name)) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else col(name)
    kept = present if whole else present.cast("double")
    return _replace(df, name, F.coalesce(kept, F.lit(int(fitted) if whole else float(fitted)).cast(
        field.dataType if whole else "double")))


def _fit_impute_categorical(df: DataFrame, op: dict) -> dict:
    name = op["column"]
    counts = df.where(col(name).isNotNull()).groupBy(col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc("v")).limit(1).collect()
    return {**op, "value": top[0]["v"] if top else "Unknown"}


def _apply_impute_categorical(df: DataFrame, op: dict) -> DataFrame:
    name = op["column"]
    kind = df.schema[name].dataType.simpleString()
    if op["value"] == "Unknown":
        kind = "string"
    return _replace(df, name, F.coalesce(col(name).cast(kind), F.lit(op["value"]).cast(kind)))


def _apply_standardize(df: DataFrame, op: dict) -> DataFrame:
    return _replace(df, op["column"], F.lower(strip(col(op["column"]).cast("string"))))


def _apply_convert(df: DataFrame, op: dict) -> DataFrame:
    target = DTYPES.get(op["dtype"], op["dtype"])
    value = col(op["column"])
    # cast() follows the session's ANSI mode; assert_true makes a bad value fail in either mode.
    checked = F.when(value.isNotNull() & value.try_cast(target).isNull(), F.raise_error(
        F.concat(F.lit(f"cannot convert {op['column']} to {op['dtype']}: "), value.cast("string"))
    )).otherwise(value.try_cast(target))
    return _replace(df, op["column"], checked)


def _fit_cap(df: DataFrame, op: dict) -> dict:
    name = op["column"]
    quartiles = exact_quantiles(df, {name: measure(df, name)}, [0.25, 0.75])[name]
    bounds = iqr_bounds(quartiles[0.25], quartiles[0.75])
    return {**op, "low": bounds[0] if bounds else None, "high": bounds[1] if bounds else None}


def _apply_cap(df: DataFrame, op: dict) -> DataFrame:
    if op["low"] is None:
        return df
    value = col(op["column"]).cast("double")
    capped = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(op["low"])), F.lit(op["high"])))
    return _replace(df, op["column"], capped)


def _replace(df: DataFrame, name: str, value) -> DataFrame:
    return df.select(*[value.alias(c) if c == name else col(c) for c in df.columns])


def _unchanged(df: DataFrame, op: dict) -> dict:
    return dict(op)


# operation -> (fit scalars on the data, transform with them)
OPERATIONS = {
    "drop_duplicates": (_unchanged, lambda df, op: distinct_rows(df)),
    "impute_numeric": (_fit_impute_numeric, _apply_impute_numeric),
    "impute_categorical": (_fit_impute_categorical, _apply_impute_categorical),
    "standardize_categories": (_unchanged, _apply_standardize),
    "convert_type": (_unchanged, _apply_convert),
    "cap_outliers": (_fit_cap, _apply_cap),
    "drop_columns": (_unchanged, lambda df, op: df.drop(*op["columns"])),
}


def _check(df: DataFrame, op: dict) -> None:
    if op.get("operation") not in OPERATIONS:
        raise ValueError(f"Unsupported cleaning operation: {op.get('operation')}")
    if "column" in op:
        require_columns(df, [op["column"]])


def clean(df: DataFrame, operations: Sequence[dict]) -> tuple[DataFrame, list[dict]]:
    """The cleaned table (lazy) and the operations with their fitted scalars."""
    fitted = []
    for op in operations:
        _check(df, op)
        fit, transform = OPERATIONS[op["operation"]]
        fitted.append(fit(df, op))
        df = transform(df, fitted[-1])
    return df, fitted


def replay(df: DataFrame, fitted: Sequence[dict]) -> DataFrame:
    """Apply operations that already carry their scalars."""
    for op in fitted:
        _check(df, op)
        df = OPERATIONS[op["operation"]][1](df, op)
    return df


def _size(df: DataFrame) -> tuple[int, int]:
    missing = sum((F.count_if(col(c).isNull()) for c in df.columns), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("rows"), missing.alias("missing")).first()
    return row["rows"], row["missing"]


def preview_cleaning(df: DataFrame, operations: Sequence[dict]) -> DataFrame:
    """Effect of each step on rows, columns and missing cells; nothing is written."""
    rows, missing = _size(df)
    effects = []
    for step, op in enumerate(operations, start=1):
        before = (rows, len(df.columns), missing)
        df, _ = clean(df, [op])
        rows, missing = _size(df)
        effects.append((step, op["operation"], before[0], rows, before[1], len(df.columns), before[2], missing))
    return local_table(df.sparkSession, effects,
        "step int, operation string, rows_before long, rows_after long, columns_before int, "
        "columns_after int, missing_before long, missing_after long",
    )


def recommend_cleaning(df: DataFrame) -> list[dict]:
    """Operations the profile suggests, in the order they should run."""
    profile = Profile(df)
    operations: list[dict] = []
    if profile.duplicates:
        operations.append({"operation": "drop_duplicates"})
    for fact in profile._column_facts():
        name = fact["column_name"]
        if fact["missing"]:
            if is_numeric(df.schema[name]):
                operations.append({"operation": "impute_numeric", "column": name, "strategy": "median"})
            elif fact["missing_pct"] <= 70:
                operations.append({"operation": "impute_categorical", "column": name, "strategy": "mode"})
        if fact["constant"]:
            operations.append({"operation": "drop_columns", "columns": [name], "reason": "constant"})
    return operations
