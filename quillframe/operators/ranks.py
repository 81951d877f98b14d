"""Exact ranks, running totals and quantiles without a global sort in one task.

* ``running_totals`` range-partitions pre-aggregated rows by (group, order value), so a group of
  any size is spread over many tasks, and adds each earlier partition's total as an offset.
* ``exact_quantiles`` hardly shuffles: a mergeable sketch brackets each wanted order statistic, a
  counting scan proves the bracket right, brackets that still hold many values are sketched again from
  inside, and only what is left in them is ranked.  Sketches save work but decide nothing: a
  bracket that fails its count is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col
from ..session import checkpointed, local_table, shuffle_partitions

SKETCH_SIZE = 4096
# About twice the rank error of a sketch of that size.
BRACKET_SLACK = 0.002
# Sketches of all tasks are merged in this many tasks before the last one.
MERGE_TASKS = 256
COLUMNS_PER_SKETCH = 25
ROUNDS = 3
SMALL_INPUT = 20_000
ONE_TASK_VALUES = 1_000_000


def running_totals(
    rows: DataFrame, by: Sequence[str], order: str, weights: Sequence[str], descending: bool = False
) -> DataFrame:
    """Add, for each weight, its sum over strictly earlier rows of the group and its group total.

    ``rows`` must hold one row per (group, order value): aggregate first, which also collapses
    any value that a large share of the raw rows has in common.  New columns are
    ``before_<weight>`` and ``total_<weight>``.
    """
    by = list(by)
    key = col(order).desc() if descending else col(order).asc()
    parts = shuffle_partitions(rows.sparkSession)
    spread = rows.repartitionByRange(parts, *[col(b).asc() for b in by], key)
    # Partition ids must be the same in both uses below, hence the checkpoint.
    spread = checkpointed(spread.withColumn("_part", F.spark_partition_id()))

    per_part = spread.groupBy(*by, "_part").agg(*[F.sum(w).alias(w) for w in weights])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_part.select(
        *[col(b).alias(f"_by_{b}") for b in by],
        col("_part").alias("_offset_part"),
        *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"_offset_{w}") for w in weights],
        *[F.sum(w).over(whole).alias(f"total_{w}") for w in weights],
    )
    within = Window.partitionBy(*by, "_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = spread.select(
        "*", *[F.coalesce(F.sum(w).over(within), F.lit(0)).alias(f"_local_{w}") for w in weights]
    )
    matched = col("_part") == col("_offset_part")
    for b in by:
        matched = matched & col(b).eqNullSafe(col(f"_by_{b}"))
    joined = local.join(offsets, matched)
    return joined.select(
        *rows.columns,
        *[(col(f"_local_{w}") + col(f"_offset_{w}")).alias(f"before_{w}") for w in weights],
        *[col(f"total_{w}") for w in weights],
    )


@dataclass
class _Target:
    """Two neighbouring 0-based ranks of one column, and the values they are known to lie between."""

    column: int
    low: int
    high: int
    below: int = 0
    inside: int = 0
    bracket: tuple[float, float] | None = None
    stuck: bool = False

    def holds(self, value: Column) -> Column:
        if self.bracket is None:
            return value.isNotNull()
        return value.between(F.lit(self.bracket[0]), F.lit(self.bracket[1]))

    @property
    def solved(self) -> bool:
        return self.bracket is not None and self.bracket[0] == self.bracket[1]


def exact_quantiles(
    df: DataFrame, columns: dict[str, Column], probs: Sequence[float], approx: bool = False
) -> dict[str, dict[float, float | None]]:
    """Linearly interpolated quantiles of several numeric expressions: name -> {prob: value}.

    Values must be free of NaN (see ``measure``).  Only ``len(columns) * len(probs)`` numbers reach
    the driver.  ``approx=True`` answers from the sketch alone.
    """
    names = list(columns)
    result: dict[str, dict[float, float | None]] = {name: {p: None for p in probs} for name in names}
    for start in range(0, len(names), COLUMNS_PER_SKETCH):
        chunk = names[start : start + COLUMNS_PER_SKETCH]
        narrow = df.select(*[columns[name].cast("double").alias(f"v{i}") for i, name in enumerate(chunk)])
        sketches = sketches_of(narrow, [F.col(f"v{i}") for i in range(len(chunk))])
        if approx:
            for i, name in enumerate(chunk):
                result[name] = dict(zip(probs, sketches.quantiles(i, probs)))
            continue
        targets, places = [], []
        for i, name in enumerate(chunk):
            n = sketches.counts[i]
            for p in probs if n else []:
                position = p * (n - 1)
                targets.append(_Target(i, math.floor(position), math.ceil(position), inside=n))
                places.append((name, p, position - math.floor(position)))
        for (name, p, share), (low, high) in zip(places, _values_of(narrow, targets, sketches)):
            result[name][p] = low + (high - low) * share if high != low else low
    return result


def values_at_ranks(df: DataFrame, value: Column, ranks: Sequence[int]) -> dict[int, float | None]:
    """Values at the given 0-based ranks of the sorted non-null values; None beyond the last."""
    narrow = df.select(value.cast("double").alias("v0"))
    sketches = sketches_of(narrow, [F.col("v0")])
    n = sketches.counts[0]
    inside = sorted({r for r in ranks if 0 <= r < n})
    found = _values_of(narrow, [_Target(0, r, r, inside=n) for r in inside], sketches)
    return {**{r: None for r in ranks}, **{r: low for r, (low, _) in zip(inside, found)}}


class _Sketches:
    """Value counts and sketches of a few columns, all in one driver-side row."""

    def __init__(self, row: DataFrame, counts: list[int]):
        self.row = row
        self.counts = counts

    def quantiles(self, i: int, fractions: Sequence[float]) -> list[float | None]:
        return self.many({i: fractions})[i]

    def many(self, wanted: dict[int, Sequence[float]]) -> dict[int, list[float | None]]:
        asked = {i: f for i, f in wanted.items() if self.counts[i]}
        result: dict[int, list[float | None]] = {i: [None] * len(f) for i, f in wanted.items()}
        if asked:
            answer = self.row.select(*[
                F.kll_sketch_get_quantile_double(f"s{i}", F.array(*[F.lit(float(x)) for x in f])).alias(f"q{i}")
                for i, f in asked.items()
            ]).first()
            result.update({i: list(answer[f"q{i}"]) for i in asked})
        return result


def sketches_of(narrow: DataFrame, values: Sequence[Column]) -> _Sketches:
    """Sketch several expressions in one scan.

    Every task makes one sketch per expression; they are merged by task number first, so that the final
    task merges ``MERGE_TASKS`` sketches however many tasks there are.
    """
    merged = narrow.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_TASKS)).alias("_task")).agg(*[
        e for i, v in enumerate(values)
        for e in (F.count(v).alias(f"n{i}"), F.kll_sketch_agg_double(v, SKETCH_SIZE).alias(f"s{i}"))
    ])
    final = merged.agg(*[
        e for i in range(len(values))
        for e in (F.sum(f"n{i}").alias(f"n{i}"), F.kll_merge_agg_double(f"s{i}", SKETCH_SIZE).alias(f"s{i}"))
    ]).first()
    counts = [final[f"n{i}"] or 0 for i in range(len(values))]
    kept = local_table(narrow.sparkSession, [tuple(final[f"s{i}"] for i in range(len(values)))], ", ".join(f"s{i} binary" for i in range(len(values)))
    )
    return _Sketches(kept, counts)


def _values_of(narrow: DataFrame, targets: list[_Target], sketches: _Sketches) -> list[tuple[float, float]]:
    """Exact values at the two ranks of every target."""
    for attempt in range(ROUNDS):
        wide = [t for t in targets if t.inside > SMALL_INPUT and not t.solved and not t.stuck]
        if not wide:
            break
        if attempt == 0:
            sources = {id(t): t.column for t in wide}
        else:
            keys = list(dict.fromkeys((t.column, t.bracket) for t in wide))
            sources = {id(t): keys.index((t.column, t.bracket)) for t in wide}
            holders = {(t.column, t.bracket): t for t in wide}
            sketches = sketches_of(
                narrow, [F.when(holders[k].holds(F.col(f"v{k[0]}")), F.col(f"v{k[0]}")) for k in keys]
            )
        _shrink(narrow, wide, sketches, sources)
    open_targets = [t for t in targets if not t.solved]
    ranked = _rank_inside(narrow, open_targets)
    return [t.bracket if t.solved else (ranked[(id(t), t.low)], ranked[(id(t), t.high)]) for t in targets]


def _shrink(narrow: DataFrame, wide: list[_Target], sketches: _Sketches, sources: dict[int, int]) -> None:
    """Propose a narrower bracket for each target and keep it only if counting confirms it."""
    fractions: dict[int, list[float]] = {}
    for t in wide:
        low = (t.low - t.below) / t.inside - BRACKET_SLACK
        high = (t.high - t.below + 1) / t.inside + BRACKET_SLACK
        fractions.setdefault(sources[id(t)], []).extend(min(1.0, max(0.0, x)) for x in (low, high))
    answers = {i: iter(values) for i, values in sketches.many(fractions).items()}
    proposed = [(t, (next(answers[sources[id(t)]]), next(answers[sources[id(t)]]))) for t in wide]
    counted = narrow.agg(*[
        e for i, (t, (low, high)) in enumerate(proposed)
        for e in (
            F.count_if(F.col(f"v{t.column}") < F.lit(low)).alias(f"b{i}"),
            F.count_if(F.col(f"v{t.column}").between(F.lit(low), F.lit(high))).alias(f"i{i}"),
        )
    ]).first()
    for i, (t, bracket) in enumerate(proposed):
        below, inside = counted[f"b{i}"], counted[f"i{i}"]
        if below <= t.low and t.high < below + inside and (inside < t.inside or bracket[0] == bracket[1]):
            t.below, t.inside, t.bracket = below, inside, bracket
        else:
            t.stuck = True


def _rank_inside(narrow: DataFrame, targets: list[_Target]) -> dict[tuple[int, int], float]:
    """Values at the wanted ranks, as {(target id, rank): value}, by ranking what the brackets hold."""
    if not targets:
        return {}
    # Targets with the same bracket on the same column share one set of candidate values.
    sets: dict[tuple, list[_Target]] = {}
    for t in targets:
        sets.setdefault((t.column, t.bracket), []).append(t)
    groups = list(sets.values())
    # No filter before the explode: it would repeat every input expression once per bracket, while the
    # array evaluates each of them once a row and is empty for almost all rows.
    candidates = F.array_compact(F.array(*[
        F.when(g[0].holds(F.col(f"v{g[0].column}")), F.struct(F.lit(s).alias("s"), F.col(f"v{g[0].column}").alias("v")))
        for s, g in enumerate(groups)
    ]))
    counted = (
        narrow.select(F.explode(candidates).alias("c"))
        .groupBy(F.col("c.s").alias("s"), F.col("c.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if sum(g[0].inside for g in groups) <= ONE_TASK_VALUES:
        earlier = Window.partitionBy("s").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        ranked = counted.withColumn("before_n", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    else:
        ranked = running_totals(counted, ["s"], "v", ["n"])

    wanted = F.lit(False)
    for s, g in enumerate(groups):
        start = col("before_n") + F.lit(g[0].below)
        for rank in sorted({r for t in g for r in (t.low, t.high)}):
            wanted = wanted | ((col("s") == s) & (start <= rank) & (start + col("n") > rank))
    found = {}
    for row in ranked.where(wanted).collect():
        group = groups[row["s"]]
        start = row["before_n"] + group[0].below
        for t in group:
            for rank in (t.low, t.high):
                if start <= rank < start + row["n"]:
                    found[(id(t), rank)] = row["v"]
    return found


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: Column, probs: dict[str, float]) -> DataFrame:
    """Per group, one column per entry of ``probs`` (name -> probability); null group kept.

    Groups without any value are absent.  A group that holds most of the rows is split over
    many tasks by ``running_totals``.
    """
    ranked = _ranked_values(df, by, value)
    return _quantiles_of_ranked(ranked, by, probs)


def _ranked_values(df: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    counted = (
        df.select(*[col(b) for b in by], value.cast("double").alias("_value"))
        .where("_value IS NOT NULL")
        .groupBy(*by, "_value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return running_totals(counted, by, "_value", ["n"])


def _quantiles_of_ranked(ranked: DataFrame, by: Sequence[str], probs: dict[str, float]) -> DataFrame:
    picks = []
    for name, p in probs.items():
        position = (col("total_n") - 1) * F.lit(float(p))
        for end, rank in (("low", F.floor(position)), ("high", F.ceil(position))):
            here = (col("before_n") <= rank) & (col("before_n") + col("n") > rank)
            picks.append(F.max(F.when(here, col("_value"))).alias(f"_{name}_{end}"))
        picks.append(F.max(position - F.floor(position)).alias(f"_{name}_share"))
    ends = ranked.groupBy(*by).agg(*picks, F.max("total_n").alias("_n"))
    return ends.select(
        *by,
        *[
            (col(f"_{name}_low") + (col(f"_{name}_high") - col(f"_{name}_low")) * col(f"_{name}_share")).alias(name)
            for name in probs
        ],
        col("_n").alias("n_values"),
    )
