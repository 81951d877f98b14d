"""Whole-row equality by digest first: rows cross a shuffle as 16 bytes, and whole only where a digest occurs twice.

Digests only choose the rows that are compared; two rows with one digest by chance are told apart by their values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..session import checkpointed
from .lookup import small_table

#: Digests that are broadcast as they are, and 64-bit words of the bitmap that stands for more of them.
BROADCAST_DIGESTS, BITMAP_WORDS = 500_000, 1 << 19

_KEY = ["_da", "_db"]


def is_wide(df: DataFrame) -> bool:
    """Is there a column whose values have no fixed width?  Rows without one are hardly longer than a digest."""
    return any(not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) for f in df.schema.fields)


def digest(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of the row; a null counts with its place."""
    parts = [x for c in df.columns for x in (col(c), col(c).isNull())]
    return [F.xxhash64(*parts).alias("_da"), F.xxhash64(F.lit("second"), *parts).alias("_db")]


def repeated_digests(df: DataFrame) -> DataFrame:
    """The digests that two rows or more have; fixed by a checkpoint."""
    counts = df.select(*digest(df)).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_n"))
    return checkpointed(counts.where("_n > 1").select(*_KEY))


def split_by_digest(df: DataFrame, digests: DataFrame, names: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose digest (of the columns ``names``, of all by default) is in ``digests``, and the others.

    Few digests are broadcast.  Of more, a bitmap of fixed size is: rows that it rules out never move, the others are
    joined by a shuffle.
    """
    marked = df.select("*", *digest(df.select(*[col(c) for c in names or df.columns])))
    small = small_table(digests, BROADCAST_DIGESTS)
    if small is not None:
        kept = F.broadcast(small)
        return (marked.join(kept, _KEY, "left_semi").drop(*_KEY), marked.join(kept, _KEY, "left_anti").drop(*_KEY))
    place = F.pmod(F.col("_da"), F.lit(64 * BITMAP_WORDS))
    word = F.shiftright(place, 6)
    bits = F.bit_or(F.expr("shiftleft(1L, CAST(pmod(_da, 64) AS INT))")).alias("_bits")
    bitmap = checkpointed(digests.groupBy(word.alias("_word")).agg(bits))
    tested = marked.withColumn("_word", word).join(F.broadcast(bitmap), "_word", "left").withColumn(
        "_maybe", F.coalesce(F.expr("(shiftrightunsigned(_bits, CAST(pmod(_da, 64) AS INT)) & 1L) = 1L"), F.lit(False))
    ).drop("_word", "_bits")
    maybe, surely_not = tested.where("_maybe").drop("_maybe"), tested.where("NOT _maybe").drop("_maybe", *_KEY)
    return (
        maybe.join(digests, _KEY, "left_semi").drop(*_KEY),
        surely_not.unionByName(maybe.join(digests, _KEY, "left_anti").drop(*_KEY)),
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    """One of each row.  Of tables with texts only rows that share a digest are shuffled whole."""
    if not is_wide(df):
        return df.dropDuplicates()
    repeated, single = split_by_digest(df, repeated_digests(df))
    return single.unionByName(repeated.dropDuplicates())


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier identical row."""
    if is_wide(df):
        df = split_by_digest(df, repeated_digests(df))[0]
    copies = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))
