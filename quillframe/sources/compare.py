"""Multiset equality of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..operators.rows import digest, split_by_digest
from ..session import checkpointed


def _comparable(df: DataFrame, booleans: set[str]) -> DataFrame:
    columns = []
    for f in df.schema.fields:
        value = col(f.name)
        if f.name in booleans:
            value = value.cast("boolean")
        columns.append((value if isinstance(f.dataType, T.StringType) else value.cast("string")).alias(f.name))
    return df.select(*columns)


def table_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (as text) whose number of copies differs, with the surplus on the left.

    Copies collapse before the shuffle, and rows cross it as digests: 16 bytes, and the SHA-256 of the row's texts.  Whole rows are
    only compared where a digest has a surplus, or two different SHA-256.
    """
    booleans = {
        f.name for df in (left, right) for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)
    }
    both = _comparable(left, booleans).withColumn("_copies", F.lit(1)).union(
        _comparable(right, booleans).withColumn("_copies", F.lit(-1))
    )
    names = [c for c in both.columns if c != "_copies"]
    rows = both.select(*[col(c) for c in names])
    encoded = F.concat(*[F.coalesce(F.concat(F.length(col(c)).cast("string"), F.lit(":"), col(c)), F.lit("-")) for c in names])
    proof = F.unhex(F.sha2(encoded, 256))
    digests = both.select(*digest(rows), proof.alias("_proof"), "_copies").groupBy("_da", "_db").agg(
        F.sum("_copies").alias("_surplus"), F.min("_proof").alias("_least"), F.max("_proof").alias("_most")
    )
    open_ones = checkpointed(digests.where("_surplus != 0 OR _least != _most").select("_da", "_db"))
    both = split_by_digest(both, open_ones, names)[0]
    counted = both.groupBy(*[col(c) for c in left.columns]).agg(F.sum("_copies").alias("surplus"))
    return counted.where("surplus != 0")


def tables_equal(left: DataFrame, right: DataFrame) -> bool:
    """Same columns in the same order and the same bag of rows; nulls equal, booleans equal 0/1."""
    return left.columns == right.columns and table_difference(left, right).isEmpty()
