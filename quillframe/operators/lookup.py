"""Joins of many rows to a table with one row per key, safe for hot keys and for large tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.columns import col

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20
HOT_SHARE = 1000


def small_table(table: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame | None:
    """A driver-held copy of ``table`` if it has at most ``limit`` rows and ``most_bytes`` bytes, else None.

    Texts and binaries are measured on Spark before anything is fetched; other columns have a fixed width.
    """
    head = table.limit(limit + 1)
    wide = [f.name for f in table.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    if wide:
        size = head.agg(F.sum(sum((F.coalesce(F.octet_length(col(c)), F.lit(0)).cast("long") for c in wide), F.lit(0)))).first()[0]
        if (size or 0) > most_bytes:
            return None
    held = head.toArrow()
    if held.num_rows > limit or held.nbytes > most_bytes:
        return None
    return table.sparkSession.createDataFrame(held, table.schema)


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    weight: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join of ``rows`` to ``table`` (one row per key) on ``key``; null keys match nothing.

    A table of checked small size is broadcast.  Beyond that, keys held by more than one row in
    ``HOT_SHARE`` - at most ``HOT_SHARE`` of them, by arithmetic - are answered by a broadcast first.  Those
    rows, and rows with a null key, still pass through the join of the others, but spread by task
    number instead of by key, so no key brings more than 1/``HOT_SHARE`` of the rows to one task.
    ``weight`` names the column of ``table`` that says how many rows hold the key; without it they are counted.
    """
    small = small_table(table.drop(weight) if weight else table, broadcast_rows)
    if small is not None:
        return rows.join(F.broadcast(small), key, "left")
    return spread_join(rows, table, key, weight)


def spread_join(rows: DataFrame, table: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """``lookup_join`` for a table known to be too large to broadcast."""
    if weight is None:
        weight = "_n"
        counts = rows.where(col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        table = table.join(counts, key)
    rows_in_all = table.agg(F.sum(weight).alias("n")).first()["n"] or 0
    payload = [c for c in table.columns if c not in (key, weight)]
    hot = table.where(col(weight) * HOT_SHARE > F.lit(rows_in_all)).select(
        key, F.lit(True).alias("_hot"), *[col(c).alias(f"_hot_{c}") for c in payload]
    )
    cold = table.select(
        col(key).alias("_cold_key"), F.lit(0).alias("_cold_spread"), *[col(c).alias(f"_cold_{c}") for c in payload]
    )
    done = col(key).isNull() | col("_hot")
    placed = rows.join(F.broadcast(hot), key, "left").select(
        "*",
        F.when(~F.coalesce(done, F.lit(False)), col(key)).alias("_open_key"),
        F.when(F.coalesce(done, F.lit(False)), F.spark_partition_id() + 1).otherwise(0).alias("_spread"),
    )
    joined = placed.join(
        cold, (col("_open_key") == col("_cold_key")) & (col("_spread") == col("_cold_spread")), "left"
    )
    return joined.select(
        *[col(c) for c in rows.columns],
        *[F.when(col("_hot"), col(f"_hot_{c}")).otherwise(col(f"_cold_{c}")).alias(c) for c in payload],
    )


def remap_ids(df: DataFrame, column: str, mapping: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Replace ids that appear in ``mapping``; others stay as they are."""
    pairs = mapping.select(col(old).alias(column), col(new).alias("_new"))
    joined = lookup_join(df, pairs, column)
    return joined.select(
        *[F.coalesce("_new", col(c)).alias(c) if c == column else col(c) for c in df.columns]
    )
