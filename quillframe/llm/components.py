"""Connected components of a link table, by alternating star contractions on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed


#: Rows for which one task is enough; small link tables are not spread over more.
TASK_ROWS = 20_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first())


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One contraction.  ``edges`` hold a > b; each node's larger (or smaller) neighbours move to its least neighbour."""
    edges = edges.coalesce(tasks)
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        least = least.coalesce(tasks)
        moved = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m").coalesce(tasks)
        moved = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a != b").coalesce(tasks).distinct().coalesce(tasks)


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links(a, b)``: the least id that can be reached.

    Any order of a and b, repeated links and self-links are allowed; an empty table gives an empty result.  Each
    round is two aggregations and two joins over the links; rounds grow with the logarithm of the longest path.
    """
    edges = checkpointed(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _state(edges)
    while before[0]:
        tasks = -(-before[0] // TASK_ROWS)
        edges = checkpointed(_star(_star(edges, True, tasks), False, tasks))
        after = _state(edges)
        if after == before:
            break
        before = after
    members = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)
