"""Run logs and keyed tables: rates, keyword retrieval, upsert and delete."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, require_columns, strip
from .lookup import small_table


def run_rates(log: DataFrame, status: str = "status") -> DataFrame:
    """One row: runs, share completed (status text starting ``completed``) and share failed; null without runs."""
    require_columns(log, [status])
    runs = F.count(F.lit(1))
    completed = F.count_if(col(status).startswith("completed"))
    failed = F.count_if(col(status) == "failed")
    return log.agg(
        runs.alias("runs"),
        F.try_divide(completed.cast("double"), runs).alias("completion_rate"),
        F.try_divide(failed.cast("double"), runs).alias("failure_rate"),
    )


def keyword_topk(df: DataFrame, text: str, key: str, query: str, limit: int = 20) -> DataFrame:
    """Rows sharing most distinct lower-case words with ``query``; ties by key."""
    require_columns(df, [text, key])
    terms = sorted(set(query.lower().split()))
    words = F.split(F.lower(strip(col(text))), r"(?U)\s+")
    overlap = F.size(F.array_intersect(words, F.array(*[F.lit(t) for t in terms]).cast("array<string>")))
    scored = df.select(col(key), F.coalesce(overlap, F.lit(0)).alias("overlap"))
    return scored.orderBy(F.desc("overlap"), col(key)).limit(limit)


def upsert_latest(tables: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key over all tables.  One aggregate with map-side combine: a hot key costs one row a task."""
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table)
    require_columns(union, [*keys, *order])
    rest = [c for c in union.columns if c not in keys]
    newest = F.max_by(F.struct(*[col(c) for c in rest]), F.struct(*[col(c) for c in order])).alias("_row")
    return union.groupBy(*[col(k) for k in keys]).agg(newest).select(*keys, "_row.*").select(*union.columns)


@dataclass(frozen=True)
class Removal:
    """What is left of a table (lazy), and how many rows went."""

    kept: DataFrame
    removed: int

    @property
    def found(self) -> bool:
        return self.removed > 0


def remove_keys(df: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> Removal:
    """``delete_by_key``, told how many rows had a listed key."""
    kept = delete_by_key(df, doomed, keys)
    return Removal(kept, df.count() - kept.count())


def clear(df: DataFrame) -> Removal:
    """No row is left."""
    return Removal(df.where(F.lit(False)), df.count())


def delete_by_key(df: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table without the rows whose key is listed in ``doomed`` (null keys are never listed)."""
    require_columns(df, keys)
    listed = doomed.select(*[col(k) for k in keys]).distinct()
    small = small_table(listed)
    return df.join(F.broadcast(small) if small is not None else listed, list(keys), "left_anti")
