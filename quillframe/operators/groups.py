"""Grouped aggregation and calendar trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import Period
from ..functions.columns import (
    POSITIVE_RATE_VALUES,
    as_timestamp,
    bin_by_edges,
    col,
    filter_rows,
    mean,
    measure,
    require_columns,
    total,
)
from .ranks import grouped_quantiles

AGGREGATIONS = ("count", "mean", "sum", "median", "min", "max", "positive_rate")


def _positive(df: DataFrame, metric: str) -> Column:
    return F.lower(col(metric).cast("string")).isin(*POSITIVE_RATE_VALUES)


def grouped_analysis(
    df: DataFrame,
    group_by: str | Sequence[str],
    metric: str | None = None,
    aggregation: str = "count",
    filters: Sequence[dict] = (),
    bins: Sequence[float] | None = None,
    approx: bool = False,
) -> DataFrame:
    """One row per group, the null group included.

    ``bins`` replaces a single numeric group column by right-closed interval labels.
    ``approx`` lets a median come from a sketch instead of exact ranks.
    """
    keys = [group_by] if isinstance(group_by, str) else list(group_by)
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"Unsupported aggregation: {aggregation}")
    if aggregation != "count" and metric is None:
        raise ValueError(f"{aggregation} needs a metric column")
    require_columns(df, keys + ([metric] if metric else []))
    df = filter_rows(df, filters)
    if bins is not None and isinstance(group_by, str):
        keys = [f"{group_by}_group"]
        df = df.withColumn(keys[0], bin_by_edges(col(group_by), bins, include_lowest=True))

    groups = df.groupBy(*[col(k) for k in keys])
    rows = F.count(F.lit(1)).alias("sample_size")
    if aggregation == "count":
        return groups.agg(F.count(F.lit(1)).alias("count"))
    if aggregation == "positive_rate":
        rate = F.avg(F.when(_positive(df, metric), 1.0).otherwise(0.0)) * 100
        return groups.agg(F.round(rate, 3).alias("positive_rate"), rows)

    value = measure(df, metric)
    name = f"{aggregation}_{metric}"
    if aggregation == "mean":
        return groups.agg(mean(value).alias(name), rows)
    if aggregation == "sum":
        return groups.agg(F.coalesce(total(value), F.lit(0.0)).alias(name))
    if aggregation == "min":
        return groups.agg(F.min(value).alias(name))
    if aggregation == "max":
        return groups.agg(F.max(value).alias(name))
    if approx:
        return groups.agg(F.percentile_approx(value.cast("double"), 0.5, 10_000).alias(name))
    return _medians(df, keys, value, name)


def _medians(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Exact medians; groups without a value keep their row with a null median."""
    medians = grouped_quantiles(df, keys, value, {name: 0.5}).select(*keys, name)
    empty = (
        df.groupBy(*[col(k) for k in keys])
        .agg(F.count(value).alias("_n"))
        .where("_n = 0")
        .select(*keys, F.lit(None).cast("double").alias(name))
    )
    return medians.unionByName(empty)


def trend_analysis(
    df: DataFrame, date: str, metric: str | None = None, frequency: str = "M", aggregation: str = "count", spans: bool = False
) -> DataFrame:
    """(period, value): a count or aggregate per calendar period; rows without a date are dropped.

    ``frequency`` is any code that ``Period`` reads: Y-JUN, Q-MAR, M, W-WED, B, D, h, 15min, 1D12h, ...  A multiple names periods by their
    length but, as in the workflow this follows, each row still counts in its own base unit (2M by months, 15min by minutes); ``spans``
    groups by whole multiples instead, counted from 1970-01-01 (months and longer: from year 0).
    """
    period = Period.of(frequency)
    require_columns(df, [date] + ([metric] if metric else []))
    if aggregation not in {"count", "sum", "mean", "median", "min", "max", "std", "nunique"}:
        raise ValueError(f"Unsupported aggregation: {aggregation}")
    if aggregation != "count" and metric is None:
        raise ValueError(f"{aggregation} needs a metric column")
    number = period.number(as_timestamp(df, date), spans)
    value = measure(df, metric) if metric and aggregation != "count" else F.lit(1)
    work = df.select(number.alias("_number"), value.alias("_metric")).where("_number IS NOT NULL")
    if aggregation == "median":
        result = _medians(work, ["_number"], col("_metric"), "value")
    else:
        metric_value = col("_metric")
        result = work.groupBy("_number").agg(
            {
                "count": F.count(F.lit(1)).cast("double"),
                "sum": F.coalesce(total(metric_value), F.lit(0.0)),
                "mean": mean(metric_value),
                "min": F.min(metric_value).cast("double"),
                "max": F.max(metric_value).cast("double"),
                "std": F.stddev_samp(metric_value.cast("double")),
                "nunique": F.count_distinct(metric_value).cast("double"),
            }[aggregation].alias("value")
        )
    return result.select(period.label(col("_number"), spans).alias("period"), "value")


def multi_group_mean(df: DataFrame, dimensions: Sequence[str], metric: str) -> DataFrame:
    """Means of one measure for several groupings, from a single scan and a single shuffle."""
    require_columns(df, [*dimensions, metric])
    pairs = F.array(*[
        F.struct(F.lit(d).alias("dimension"), col(d).cast("string").alias("group_value")) for d in dimensions
    ])
    long = df.select(F.explode(pairs).alias("g"), measure(df, metric).alias("_metric"))
    return long.groupBy(F.col("g.dimension").alias("dimension"), F.col("g.group_value").alias("group_value")).agg(
        mean(col("_metric")).alias(f"mean_{metric}"), F.count(F.lit(1)).alias("sample_size")
    )


def group_extremes(groups: DataFrame, value: str, group: str, within: Sequence[str] = ()) -> DataFrame:
    """Highest and lowest group of a grouped result, one row each (per value of ``within``).

    Where the result carries sample sizes, groups below max(10, 0.5 % of all rows) do not compete.
    Ties go to the group that sorts first.
    """
    require_columns(groups, [value, group, *within])
    usable = groups.where(col(value).isNotNull())
    extra = []
    if "sample_size" in groups.columns:
        extra = ["sample_size"]
        sizes = usable.groupBy(*within).agg(F.sum("sample_size").alias("_all"))
        least = F.greatest(F.lit(10), F.floor(col("_all") * F.lit(0.005)))
        if within:
            usable = usable.join(sizes, list(within))
        else:
            usable = usable.withColumn("_all", F.lit(sizes.first()["_all"]))
        usable = usable.where(col("sample_size") >= least)
    row = F.struct(*[col(c) for c in [group, value, *extra]])
    # max_by/min_by keep one row per group in memory; the text key settles ties.
    order = F.struct(col(value), col(group).cast("string"))
    ends = usable.groupBy(*within).agg(
        F.min_by(row, F.struct(-col(value).cast("double"), col(group).cast("string"))).alias("highest"),
        F.min_by(row, order).alias("lowest"),
    )
    both = ends.select(
        *within,
        F.explode(F.array(
            F.struct(F.lit("highest").alias("which"), col("highest").alias("r")),
            F.struct(F.lit("lowest").alias("which"), col("lowest").alias("r")),
        )).alias("e"),
    )
    return both.where("e.r IS NOT NULL").select(*within, "e.which", "e.r.*")

