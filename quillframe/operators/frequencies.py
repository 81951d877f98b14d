"""Frequencies of the values of many columns at once: counts, distinct values and the most frequent ones.

Values of fixed width are counted as they are.  Texts are counted by digests of 16 bytes, and only texts that can be among
the most frequent ones leave their task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.columns import col, finite_or_null, is_nested, require_columns
from ..session import checkpointed
from .rows import digest, is_wide, split_by_digest


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN and infinities turned into null."""
    field = df.schema[name]
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return finite_or_null(col(name))
    return col(name)


def as_text(df: DataFrame, name: str) -> Column:
    field = df.schema[name]
    value = present(df, name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        value = value + F.lit(0.0).cast(field.dataType)  # -0.0 and 0.0 are one value
    return value.cast("string")


def plain_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not is_nested(f)]


def _long(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column_name, value): every value of the columns as text."""
    text = df.select(*[as_text(df, c).alias(c) for c in names])
    return text.unpivot([], [col(c) for c in names], "column_name", "value")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, n): frequency of every value of every column, null included."""
    names = plain_columns(df) if columns is None else list(columns)
    require_columns(df, names)
    return _long(df, names).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


class Frequencies:
    """Frequencies of the columns of one table; texts by (column, digest), computed once and fixed by a checkpoint."""

    def __init__(self, df: DataFrame, columns: Sequence[str] | None = None):
        names = plain_columns(df) if columns is None else list(columns)
        require_columns(df, names)
        self.df = df
        self.texts = [c for c in names if is_wide(df.select(col(c)))]
        self.others = [c for c in names if c not in self.texts]
        self._counts: DataFrame | None = None

    def _rows(self) -> DataFrame:
        """(column_name, value, _da, _db) of every text."""
        long = _long(self.df, self.texts)
        return long.select("*", *digest(long))

    @property
    def counts(self) -> DataFrame:
        """(column_name, known, _da, _db, n): how many rows hold each text; null is not ``known``."""
        if self._counts is None:
            rows = self._rows().select("column_name", F.col("value").isNotNull().alias("known"), "_da", "_db")
            self._counts = checkpointed(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")))
        return self._counts

    def distinct(self) -> dict[str, int]:
        """Distinct values that are not null, by column."""
        parts = []
        if self.others:
            parts.append(value_counts(self.df, self.others).where("value IS NOT NULL").select("column_name"))
        if self.texts:
            parts.append(self.counts.where("known").select("column_name"))
        found: dict[str, int] = {}
        for part in parts:
            found.update({r["column_name"]: r["u"] for r in part.groupBy("column_name").agg(F.count(F.lit(1)).alias("u")).collect()})
        return {c: found.get(c, 0) for c in [*self.others, *self.texts]}

    def top(self, k: int) -> DataFrame:
        """(column_name, position, value, count): the ``k`` most frequent values of each column; ties in text order, null last.

        The k-th largest count of a column, found among digests, says which texts matter: those that occur more often, and
        those that occur as often.  They are counted again as texts.  Where that count is 1, only the first ``k`` texts of every task do.
        """
        parts = [value_counts(self.df, self.others)] if self.others else []
        if self.texts:
            parts += self._candidates(k)
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return top_values(result, k)

    def _candidates(self, k: int) -> list[DataFrame]:
        order = Window.partitionBy("column_name").orderBy(F.desc("n"))
        best = self.counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        # One number for each column.
        least = best.groupBy("column_name").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("held")).collect()
        bounds = {r["column_name"]: r["least"] if r["held"] == k else 0 for r in least}
        edge = F.lit(None)
        for c, n in bounds.items():
            edge = F.when(F.col("column_name") == c, F.lit(n)).otherwise(edge)
        nulls = self.counts.where("NOT known").select("column_name", F.lit(None).cast("string").alias("value"), "n")
        often = self.counts.where(F.col("known") & (F.col("n") >= F.greatest(edge, F.lit(2))))
        long = _long(self.df, self.texts).where("value IS NOT NULL")
        repeated, rest = split_by_digest(long, checkpointed(often.select("_da", "_db")))
        parts = [nulls, repeated.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))]
        single = [c for c, n in bounds.items() if n <= 1]
        if single:
            # Every text left of these columns occurs once.
            first = Window.partitionBy("column_name").orderBy("value")
            once = rest.where(F.col("column_name").isin(*single)).withColumn("place", F.row_number().over(first))
            parts.append(once.where(F.col("place") <= k).select("column_name", "value", F.lit(1).cast("long").alias("n")))
        return parts


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """Top ``k`` values per column of a frequency table.

    ``row_number <= k`` lets Spark cut every task's share to k rows per column before the shuffle.
    """
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    ranked = counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
    return ranked.select("column_name", "position", "value", F.col("n").alias("count"))
