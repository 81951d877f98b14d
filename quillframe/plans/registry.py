"""Named queries over a folder of tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.columns import filter_rows, with_finite
from .views import VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __call__(self, name: str, filters: Sequence[dict] = ()) -> DataFrame:
        """A table or view; ``filters`` (see ``filter_rows``) are applied to a table's own columns and reach its scan."""
        if name in VIEWS:
            text, uses = VIEWS[name]
            return self.spark.sql(text, **{t: self(t) for t in uses})
        return with_finite(filter_rows(self.spark.read.parquet(f"{self.folder}/{name}.parquet"), filters))


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame``; ``oracle`` may refer to the listed views."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_views(oracle, views)
        return fn

    return add


def with_views(body: str, views: tuple[str, ...]) -> str:
    """Prefix the SQL with the views it needs as common table expressions."""
    if not views:
        return body.strip()
    parts = []
    for name in views:
        text, uses = VIEWS[name]
        parts.append(f"{name} AS ({text.format(**{t: t for t in uses})})")
    body = body.strip()
    recursive = body.upper().startswith("WITH RECURSIVE ")
    if recursive:
        return f"WITH RECURSIVE {', '.join(parts)}, {body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[len('WITH '):]}"
    return f"WITH {', '.join(parts)} {body}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns, so that summation order does not show in comparisons."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])
