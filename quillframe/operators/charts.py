"""Chart-ready tables: aggregated or sampled on Spark, small enough to draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, measure, numeric_columns, require_columns
from ..session import local_table
from .correlation import correlations
from .groups import grouped_analysis
from .lookup import lookup_join
from .ranks import _quantiles_of_ranked, _ranked_values

CHART_TYPES = ("bar", "line", "scatter", "histogram", "box", "heatmap", "donut")
SAMPLE_POINTS = 5000
HISTOGRAM_BINS = 30


def check_spec(df: DataFrame, spec: dict) -> None:
    if spec.get("chart_type") not in CHART_TYPES:
        raise ValueError("unknown chart type")
    require_columns(df, [spec[k] for k in ("x", "y", "color") if spec.get(k)])


def chart_data(df: DataFrame, spec: dict) -> DataFrame:
    """Data for a chart spec: chart_type, x, y, color, aggregation; scatter also key.

    An aggregation by x comes first whatever the type; histograms and boxes are then drawn of the aggregated table.
    """
    check_spec(df, spec)
    kind, x, y = spec["chart_type"], spec.get("x"), spec.get("y")
    if kind == "heatmap":
        return heatmap(df)
    if spec.get("aggregation") and x:
        df, x, y = aggregated(df, x, y, spec["aggregation"]), "x", "y"
        if kind not in {"histogram", "box"}:
            return df
    if kind == "histogram":
        return histogram(df, x, spec.get("bins", HISTOGRAM_BINS))
    if kind == "box":
        return box(df, x, y)
    wanted = list(dict.fromkeys(c for c in (x, y, spec.get("color")) if c))
    return sample_points(df, wanted, spec.get("key") or df.columns)


def aggregated(df: DataFrame, x: str, y: str | None, aggregation: str) -> DataFrame:
    """(x, y): count, mean, sum or median per value of x, the null value included."""
    if aggregation not in {"count", "mean", "sum", "median"}:
        raise ValueError(f"unknown aggregation: {aggregation}")
    table = grouped_analysis(df, x, y, aggregation)
    value = "count" if aggregation == "count" else f"{aggregation}_{y}"
    return table.select(col(x).alias("x"), col(value).cast("double").alias("y"))


def sample_points(
    df: DataFrame, columns: Sequence[str], key: Sequence[str], limit: int = SAMPLE_POINTS, seed: int = 42
) -> DataFrame:
    """At most ``limit`` rows in a seeded random order of ``key``; the same rows on every run.

    Plans as a top-k: each task keeps ``limit`` rows.
    """
    digest = F.md5(F.concat_ws(":", *[col(k).cast("string") for k in key], F.lit(str(seed))))
    return df.orderBy(digest, *[col(k) for k in key]).limit(limit).select(*[col(c) for c in columns])


def histogram(df: DataFrame, x: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, lo, hi, count) over all rows: equal widths, the last bin closed, empty bins kept."""
    value = measure(df, x).cast("double")
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    spark = df.sparkSession
    if ends["lo"] is None:
        return local_table(spark, [], "bin int, lo double, hi double, count long")
    low, high = ends["lo"], ends["hi"]
    width = (high - low) / bins
    position = F.lit(0) if width == 0 else F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    counted = df.where(value.isNotNull()).groupBy(position.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    used = bins if width else 1
    frame = local_table(spark, [(i, low + i * width, low + (i + 1) * width if i < used - 1 else high) for i in range(used)],
        "bin int, lo double, hi double",
    )
    return frame.join(counted, "bin", "left").select("bin", "lo", "hi", F.coalesce("count", F.lit(0)).alias("count"))


def box(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, q1, median, q3, lo_whisker, hi_whisker) over all rows of each group.

    Whiskers end at the outermost values within 1.5 interquartile ranges of the quartiles.
    """
    ranked = _ranked_values(df.select(col(x).alias("x"), measure(df, y).alias("y")), ["x"], F.col("y"))
    boxes = _quantiles_of_ranked(ranked, ["x"], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    spread = (F.col("q3") - F.col("q1")) * 1.5
    limits = boxes.select(
        F.col("x"), (F.col("q1") - spread).alias("_low"), (F.col("q3") + spread).alias("_high")
    )
    # The null group has its own marker, because a lookup never matches null keys.
    tag = F.coalesce(F.concat(F.lit("v"), F.col("x").cast("string")), F.lit("n"))
    keyed = ranked.select("x", "_value", tag.alias("_tag"))
    inside = lookup_join(keyed, limits.select(tag.alias("_tag"), "_low", "_high"), "_tag").where(
        F.col("_value").between(F.col("_low"), F.col("_high"))
    )
    whiskers = inside.groupBy("_tag").agg(
        F.min("_value").alias("lo_whisker"), F.max("_value").alias("hi_whisker")
    )
    return boxes.withColumn("_tag", tag).join(whiskers, "_tag").select(
        "x", "q1", "median", "q3", "lo_whisker", "hi_whisker"
    )


def heatmap(df: DataFrame) -> DataFrame:
    """(a, b, r) for every pair of numeric columns."""
    return correlations(df, "pearson", numeric_columns(df))
