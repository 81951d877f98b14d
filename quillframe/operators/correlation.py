"""Pairwise-complete correlations: Pearson, Spearman and Kendall."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate, combinations

import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.columns import col, measure, numeric_columns, require_columns
from ..session import checkpointed, local_table, shuffle_partitions
from .inversions import discordant
from .lookup import BROADCAST_ROWS
from .ranks import sketches_of

SUMS_PER_AGGREGATE = 120
#: Most ranges that the values of a column are dealt by, bound by bound from a sketch, and rows that are not worth dividing.
RANGES, ROWS_PER_RANGE = 512, 100_000


@dataclass(frozen=True)
class ColumnStats:
    n: int
    mean: float | None
    std: float | None
    constant: bool


def _doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require_columns(df, columns)
    return df.select(*[measure(df, c).cast("double").alias(c) for c in columns])


def correlations(df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None) -> DataFrame:
    """Long-form matrix (a, b, r), r rounded to 4 digits, for every ordered pair of columns."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    if method not in {"pearson", "spearman", "kendall"}:
        raise ValueError(f"Unsupported correlation method: {method}")
    pairs = list(combinations(columns, 2))
    values = _doubles(df, columns)
    rows_in_all, stats = column_stats(values, columns)
    if method == "pearson":
        result = pearson_pairs(values, pairs, (rows_in_all, stats))
    elif method == "spearman":
        result = spearman_pairs(values, pairs, (rows_in_all, stats))
    else:
        result = {pair: kendall(values, *pair) for pair in pairs}
    rows = [(c, c, None if stats[c].constant else 1.0) for c in columns]
    for (a, b), r in result.items():
        rounded = None if r is None else round(r, 4)
        rows += [(a, b, rounded), (b, a, rounded)]
    return local_table(df.sparkSession, rows, "a string, b string, r double")


def _aggregate(values: DataFrame, wanted: dict) -> dict:
    """Evaluate many aggregates, in as few scans as keep the generated code compilable."""
    result = {}
    keys = list(wanted)
    for start in range(0, len(keys), SUMS_PER_AGGREGATE):
        chunk = keys[start : start + SUMS_PER_AGGREGATE]
        row = values.agg(*[wanted[k].alias(f"e{i}") for i, k in enumerate(chunk)]).first()
        result.update({k: row[i] for i, k in enumerate(chunk)})
    return result


def column_stats(values: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, ColumnStats]]:
    """Row count, and per column the facts that decide how it can be correlated."""
    wanted = {"rows": F.count(F.lit(1))}
    for c in columns:
        wanted[(c, "n")] = F.count(col(c))
        wanted[(c, "mean")] = F.avg(col(c))
        wanted[(c, "std")] = F.stddev_pop(col(c))
        wanted[(c, "varies")] = F.max(col(c)) > F.min(col(c))
    found = _aggregate(values, wanted)
    return found["rows"], {
        c: ColumnStats(found[(c, "n")], found[(c, "mean")], found[(c, "std")], not found[(c, "varies")])
        for c in columns
    }


def pearson_pairs(
    values: DataFrame,
    pairs: Sequence[tuple[str, str]],
    known: tuple[int, dict[str, ColumnStats]] | None = None,
) -> dict[tuple[str, str], float | None]:
    """Correlation of each pair over its complete rows, from plain sums of standardised values.

    Columns are shifted and scaled by their own mean and deviation first (correlation does not change,
    cancellation disappears).  A pair of columns without nulls then needs one product sum; a pair with
    nulls also needs the sums restricted to its complete rows.
    """
    if not pairs:
        return {}
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    rows, stats = known or column_stats(values, columns)
    usable = {c for c in columns if not stats[c].constant and stats[c].std}
    centred = values.select(*[
        ((col(c) - F.lit(stats[c].mean)) / F.lit(stats[c].std)).alias(c) for c in columns if c in usable
    ])
    wanted = {}
    for c in usable:
        wanted[(c, "sum")] = F.sum(col(c))
        wanted[(c, "square")] = F.sum(col(c) * col(c))
    partial = {}
    for a, b in pairs:
        if a not in usable or b not in usable:
            continue
        wanted[(a, b)] = F.sum(col(a) * col(b))
        partial[(a, b)] = stats[a].n < rows or stats[b].n < rows
        if partial[(a, b)]:
            a_too, b_too = F.when(col(b).isNotNull(), col(a)), F.when(col(a).isNotNull(), col(b))
            wanted[(a, b, "n")] = F.count(a_too)
            for side, value in (("a", a_too), ("b", b_too)):
                wanted[(a, b, side, "sum")] = F.sum(value)
                wanted[(a, b, side, "square")] = F.sum(value * value)
                wanted[(a, b, side, "varies")] = F.max(value) > F.min(value)
    sums = _aggregate(centred, wanted) if wanted else {}

    result: dict[tuple[str, str], float | None] = {}
    for a, b in pairs:
        if (a, b) not in partial:
            result[(a, b)] = None
            continue
        if partial[(a, b)]:
            n, sides = sums[(a, b, "n")], [(a, b, "a"), (a, b, "b")]
            varies = all(sums[(*s, "varies")] for s in sides)
        else:
            n, sides, varies = rows, [(a,), (b,)], True
        if not varies:
            result[(a, b)] = None
            continue
        (sa, qa), (sb, qb) = ((sums[(*s, "sum")], sums[(*s, "square")]) for s in sides)
        spread = (qa - sa * sa / n) * (qb - sb * sb / n)
        r = (sums[(a, b)] - sa * sb / n) / math.sqrt(spread) if spread > 0 else None
        result[(a, b)] = None if r is None else max(-1.0, min(1.0, r))
    return result


def spearman_pairs(
    values: DataFrame,
    pairs: Sequence[tuple[str, str]],
    known: tuple[int, dict[str, ColumnStats]] | None = None,
) -> dict[tuple[str, str], float | None]:
    """Pearson over average ranks.

    Columns without nulls share one ranking each; a pair with nulls is ranked on its own
    complete rows, because removing rows changes the ranks.
    """
    if not pairs:
        return {}
    columns = sorted({c for pair in pairs for c in pair})
    rows, stats = known or column_stats(values, columns)
    shared = [(a, b) for a, b in pairs if stats[a].n == rows and stats[b].n == rows]
    result: dict[tuple[str, str], float | None] = {}
    if shared:
        used = sorted({c for pair in shared for c in pair})
        result.update(_rank_pairs(values.select(*[col(c) for c in used]), shared, rows, stats))
    for a, b in pairs:
        if (a, b) not in result:
            complete = values.select(a, b).where(col(a).isNotNull() & col(b).isNotNull())
            result.update(_rank_pairs(complete, [(a, b)], *column_stats(complete, [a, b])))
    return result


def _rank_pairs(values, pairs, rows: int, stats: dict[str, ColumnStats]) -> dict:
    """Complete columns only: the mean of average ranks is (n+1)/2, and n serves as the scale."""
    columns = values.columns
    known = {c: ColumnStats(rows, (rows + 1) / 2, float(max(rows, 1)), stats[c].constant) for c in columns}
    return pearson_pairs(with_ranks(values, columns), pairs, (rows, known))


def with_ranks(values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace every value by its average rank within its column; nulls stay null.

    Columns with few values, ``BROADCAST_ROWS`` of them in all, get their ranks by broadcasts.  For each of the others the rows are dealt by
    ranges of the value and numbered within them: one shuffle of the rows for a column, and no join.  ``values`` is read several times.
    """
    values = values.select(*[(col(c) + 0.0).alias(c) for c in values.columns])  # -0.0 and 0.0 are one value
    sizes = _aggregate(values, {c: F.approx_count_distinct(col(c)) for c in columns})
    small, held = [], 0
    for c in sorted(columns, key=lambda c: (sizes[c], c)):
        held += sizes[c]
        if held <= BROADCAST_ROWS:
            small.append(c)
    large = [c for c in columns if c not in small]
    ranks = _ranks_by_ranges(values, large) if large else values
    if small:
        counted = values.unpivot([], [col(c) for c in small], "column", "value").where("value IS NOT NULL").groupBy(
            "column", "value").agg(F.count(F.lit(1)).alias("n"))
        earlier = Window.partitionBy("column").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
        copies = counted.select("column", "value", (before + (col("n") + 1) / F.lit(2.0)).alias("_rank")).toArrow()
        for c in small:
            mine = copies.filter(pc.equal(copies["column"], c)).select(["value", "_rank"]).rename_columns([c, "_rank"])
            joined = ranks.join(F.broadcast(values.sparkSession.createDataFrame(mine, schema_of(c))), c, "left")
            ranks = joined.select(*[col("_rank").alias(c) if x == c else col(x) for x in values.columns])
    return ranks


def _ranks_by_ranges(values: DataFrame, large: list[str]) -> DataFrame:
    """Replace the values of ``large`` columns by their average ranks.

    Quantiles of a sketch bound the ranges, and one exact count says how many rows lie before each range and on each bound.  So the rank of a
    value that is a bound, such as any value of a large share of the rows, is known at once, and only what lies between two bounds is
    ordered.  Rows that need no ordering pass through the same shuffle, spread by a hash.
    """
    names = [f"v{i}" for i in range(len(values.columns))]
    ranks = values.toDF(*names)
    wanted = {values.columns.index(c): f"v{values.columns.index(c)}" for c in large}
    sketches = sketches_of(ranks, [F.col(v) for v in wanted.values()])
    ranges = max(1, min(RANGES, max(sketches.counts) // ROWS_PER_RANGE))
    cuts = sketches.many({i: [k / ranges for k in range(1, ranges)] for i in range(len(wanted))}) if ranges > 1 else {}
    bounds = {v: sorted({x for x in cuts.get(i, []) if x is not None}) for i, v in enumerate(wanted.values())}
    placed = ranks
    for v in bounds:
        placed = _with_place(placed, v, bounds[v], f"_{v}")
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col(f"_{v}").alias("place")) for v in bounds]))
    counted = placed.select(pairs.alias("c")).groupBy("c.v", "c.place").agg(F.count(F.lit(1)).alias("n"))
    sizes = {(r["v"], r["place"]): r["n"] for r in counted.collect()}
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), *names), F.lit(4 * shuffle_partitions(values.sparkSession))).cast("int")
    for v in bounds:
        here = [sizes.get((v, k), 0) for k in range(2 * len(bounds[v]) + 1)]
        before = [float(x) for x in accumulate(here[:-1], initial=0)]
        middle = [x + (n + 1) / 2 for x, n in zip(before, here)]
        ordered = F.col("_place") % 2 == 0
        dealt = _with_place(ranks, v, bounds[v], "_place").withColumn("_range", F.when(ordered, F.col("_place")).otherwise(-1 - spread))
        dealt = dealt.withColumn("_rank", F.rank().over(Window.partitionBy("_range").orderBy(v)))
        dealt = dealt.withColumn("_ties", F.count(F.lit(1)).over(Window.partitionBy("_range", v)))
        inside = F.get(F.lit(before), "_place") + F.col("_rank") + (F.col("_ties") - 1) / F.lit(2.0)
        rank = F.when(ordered, inside).otherwise(F.get(F.lit(middle), "_place"))
        ranks = dealt.select(*[rank.alias(x) if x == v else x for x in names])
    return ranks.toDF(*values.columns)


def _with_place(df: DataFrame, value: str, bounds: list[float], place: str) -> DataFrame:
    """Add ``place``: 0 below the first bound, 1 on it, 2 between it and the second one, and so on; null for null."""
    if not bounds:
        return df.withColumn(place, F.when(F.col(value).isNotNull(), F.lit(0)))
    splits = [float("-inf"), *bounds, float("inf")]
    found = Bucketizer(splits=splits, inputCol=value, outputCol=place, handleInvalid="keep").transform(df)
    number = F.col(place).cast("int")
    return found.withColumn(place, 2 * number - (F.col(value) == F.get(F.lit(splits), number)).cast("int"))


def schema_of(name: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.DoubleType()), T.StructField("_rank", T.DoubleType())])


def kendall(values: DataFrame, a: str, b: str) -> float | None:
    """Kendall's tau-b, exact, without ever pairing rows: discordant pairs are counted (see ``discordant``), ties are sums over groups."""
    complete = values.select(
        (col(a).cast("double") + 0.0).alias("x"), (col(b).cast("double") + 0.0).alias("y")
    ).where("x IS NOT NULL AND y IS NOT NULL")
    pairs = checkpointed(complete.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    n = pairs.agg(F.sum("n").alias("n")).first()["n"]
    if not n:
        return None

    def tied(*columns: str) -> float:
        counts = pairs.groupBy(*columns).agg(F.sum("n").cast("double").alias("n"))
        return counts.agg(F.sum(col("n") * (col("n") - 1) / 2).alias("t")).first()["t"]

    everything, x, y = n * (n - 1) / 2, tied("x"), tied("y")
    scale = (everything - x) * (everything - y)
    if scale <= 0:
        return None
    differ = discordant(pairs)
    agree = everything - x - y + tied("x", "y") - differ
    return (agree - differ) / scale**0.5
