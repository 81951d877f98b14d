"""Discordant pairs of (x, y) rows: inversions counted inside range partitions, and between them by a small matrix of totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed, shuffle_partitions

#: Range partitions of x, and of y, at most; the driver gets one total for each pair of them that has rows.
MOST_PARTS = 1000


def weighted_inversions(values: np.ndarray, weights: np.ndarray) -> float:
    """Sum of ``weights[i] * weights[j]`` over all i < j with ``values[i] > values[j]``.

    Values become dense ranks.  Two ranks agree down to one binary digit and differ there; rows are kept in groups that share the digits above,
    in their first order, so every digit is one pass of sums: what is 1 before a 0 in a group is an inversion there.
    """
    if len(values) < 2:
        return 0.0
    _, rank = np.unique(values, return_inverse=True)
    weight, found = weights.astype(float), 0.0
    for digit in reversed(range(int(rank.max()).bit_length())):
        group, bit = rank >> (digit + 1), (rank >> digit) & 1
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rank))))
        ones = np.cumsum(weight * bit)
        before = ones - (ones - weight * bit)[first][of]
        found += float((weight * (1 - bit) * before).sum())
        # Stable: zeros of each group first, then its ones.
        zeros = np.cumsum(1 - bit)
        held = (zeros - (1 - bit))[first]
        mine = zeros - held[of]
        all_zeros = np.append(held[1:], zeros[-1]) - held
        inside = np.arange(len(rank)) - first[of]
        place = first[of] + np.where(bit == 0, mine - 1, all_zeros[of] + inside - mine)
        order = np.empty(len(rank), np.int64)
        order[place] = np.arange(len(rank))
        rank, weight = rank[order], weight[order]
    return found


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The inversions of ``value``, weighted by ``n``, in the order of a task's rows."""
    values, weights = [], []
    for batch in batches:
        values.append(batch.column("value").to_numpy(zero_copy_only=False))
        weights.append(batch.column("n").to_numpy(zero_copy_only=False))
    found = weighted_inversions(np.concatenate(values), np.concatenate(weights)) if values else 0.0
    yield pa.RecordBatch.from_arrays([pa.array([found])], names=["found"])


def _sorted_parts(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Rows in range partitions by (first, second), in order, with ``_at``, the partition's number; fixed by a checkpoint."""
    parts = min(MOST_PARTS, shuffle_partitions(rows.sparkSession))
    spread = rows.repartitionByRange(parts, first, second).sortWithinPartitions(first, second)
    return checkpointed(spread.withColumn("_at", F.spark_partition_id()))


def discordant(pairs: DataFrame) -> float:
    """How many pairs of rows of ``pairs(x, y, n)`` - one row for each distinct (x, y), n the rows that have it - differ in opposite ways.

    In the order of (x, y) these are the strict inversions of y; rows equal in x come with rising y, so they add none.  Inversions inside
    a range partition are counted there.  For those between partitions, rows are sorted once more by (y, partition): there they are the strict
    inversions of the partition's number, again inside range partitions, or between two of them, which their totals by (y's partition, x's partition)
    tell.  Each of the two sorts shuffles every distinct pair once; a value that many rows have is split over partitions like any others.
    """
    by_x = _sorted_parts(pairs.select("x", "y", "n"), "x", "y")
    inside = by_x.select(F.col("y").alias("value"), "n").mapInArrow(_inside, "found double")
    by_y = by_x.groupBy("y", F.col("_at").alias("part")).agg(F.sum("n").alias("n"))
    by_y = _sorted_parts(by_y, "y", "part")
    between = by_y.select(F.col("part").alias("value"), "n").mapInArrow(_inside, "found double")
    # At most MOST_PARTS squared numbers.
    cells = by_y.groupBy("_at", "part").agg(F.sum("n").cast("double").alias("n")).toArrow()
    side = 1 + max([0, *cells.column("_at").to_pylist(), *cells.column("part").to_pylist()])
    totals = np.zeros((side, side))
    totals[cells.column("_at").to_numpy(), cells.column("part").to_numpy()] = cells.column("n").to_numpy()
    # Earlier partitions of y against later partitions of x, and the other way round.
    later = np.cumsum(totals[:, ::-1], axis=1)[:, ::-1] - totals
    earlier = np.cumsum(later, axis=0) - later
    return sum(r["found"] for r in inside.collect()) + sum(r["found"] for r in between.collect()) + float((earlier * totals).sum())
