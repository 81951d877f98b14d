"""Read-only SQL over registered tables.

The text is placed inside ``SELECT * FROM ( ... ) LIMIT n``, so only a query can parse there, and Spark's
analyzer rejects unknown tables and columns.  Left to check are reading files by path, and expressions that run
arbitrary code; those are looked for in the analysed plan, whatever the text called them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from ..session import temporary_conf

MAX_ROWS = 1000
# Expressions by which Spark SQL calls arbitrary JVM methods.
BLOCKED_EXPRESSIONS = ("CallMethodViaReflection", "TryReflect")


class SQLGuardError(ValueError):
    """The text is not an allowed read-only query."""


@dataclass(frozen=True)
class GuardedResult:
    """The capped rows (lazy) and a way to learn whether more rows existed."""

    rows: DataFrame
    uncapped: DataFrame
    cap: int

    @property
    def truncated(self) -> bool:
        return self.uncapped.limit(self.cap + 1).count() > self.cap


def _without_text(query: str) -> str:
    """The query with comments and string literals blanked, for looking at names only."""
    return re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", " ", query, flags=re.S)


@contextmanager
def _views(spark: SparkSession, tables: dict[str, DataFrame]):
    """Views of the tables for as long as a text is analysed; views of the same names come back afterwards."""
    present = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    hidden = {name: spark.table(f"`{name}`") for name in tables if name.lower() in present}
    try:
        for name, table in tables.items():
            table.createOrReplaceTempView(name)
        yield
    finally:
        for name in tables:
            if name in hidden:
                hidden[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.length())]


def _expression_names(df: DataFrame) -> Iterator[str]:
    """Class names of all expressions of the analysed plan, those in subqueries and common tables included."""
    waiting = [df._jdf.queryExecution().analyzed()]
    while waiting:
        node = waiting.pop()
        yield node.getClass().getSimpleName()
        for part in ("children", "expressions", "innerChildren"):
            if hasattr(node, part):
                try:
                    waiting += _items(getattr(node, part)().toSeq())
                except (Py4JError, TypeError):  # an expression has no expressions
                    continue
        if node.getClass().getSimpleName().endswith("Subquery") or "SubqueryExpression" in str(node.getClass().getSuperclass()):
            waiting.append(node.plan())


def guarded_sql(
    spark: SparkSession, query: str, tables: dict[str, DataFrame] | None = None, max_rows: int = MAX_ROWS
) -> GuardedResult:
    """Analyse one SELECT; at most ``max_rows`` rows come back, whatever limit the text has."""
    text = query.strip()
    while text.endswith(";"):
        text = text[:-1].rstrip()
    if not text:
        raise SQLGuardError("no text")
    bare = _without_text(text)
    if ";" in bare:
        raise SQLGuardError("one statement at a time")
    try:
        with temporary_conf(spark, spark__sql__runSQLOnFiles="false"), _views(spark, tables or {}):
            everything = spark.sql(f"SELECT * FROM (\n{text}\n)")
    except ParseException as error:
        raise SQLGuardError(f"not a query: {error.getMessage().splitlines()[0]}") from error
    except AnalysisException as error:
        raise SQLGuardError(error.getMessage().splitlines()[0]) from error
    for name in _expression_names(everything):
        if name in BLOCKED_EXPRESSIONS:
            raise SQLGuardError("Calls of JVM methods are blocked")
    return GuardedResult(everything.limit(max_rows), everything, max_rows)
