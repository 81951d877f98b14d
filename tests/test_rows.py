"""Row equality by digest against counting whole rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillframe.operators import rows as R
from quillframe.operators.cleaning import clean
from quillframe.session import local_table
from quillframe.sources import compare
from quillframe.sources.compare import table_difference, tables_equal

SCHEMA = "a string, b string, n int, x double"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(8)
    pool = [None, "", "x", "12", "1", "2", "long " * 50]
    out = [(rng.choice(pool), rng.choice(pool), rng.choice([None, 1, 2]), rng.choice([None, 0.0, -0.0, 1.5])) for _ in range(400)]
    out += [(f"single{k}", None, k, 0.5) for k in range(100)]
    # A third of the rows are one row; nulls in another place are another row.
    return out + [("hot", "row", 1, 1.0)] * 250 + [(None, "p", 1, None), ("p", None, 1, None)]


def bag(rows):
    return Counter(tuple(0.0 if v == 0.0 and isinstance(v, float) else v for v in r) for r in rows)


@pytest.fixture(params=["broadcast", "bitmap", "collisions"])
def way(request, monkeypatch):
    if request.param != "broadcast":
        monkeypatch.setattr(R, "BROADCAST_DIGESTS", 3)
        monkeypatch.setattr(R, "BITMAP_WORDS", 4)
    if request.param == "collisions":
        few = lambda df: [F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(7)).alias("_da"), F.lit(1).cast("long").alias("_db")]
        monkeypatch.setattr(R, "digest", few)
        monkeypatch.setattr(compare, "digest", few)
    return request.param


def test_duplicates_and_distinct_rows(spark, data, way):
    df = local_table(spark, data, SCHEMA).repartition(4)
    want = bag(data)
    assert R.duplicate_rows(df).first()[0] == sum(n - 1 for n in want.values())
    cleaned, _ = clean(df, [{"operation": "drop_duplicates"}])
    assert bag(cleaned.collect()) == Counter(set(want))


def test_table_difference(spark, data, way):
    right = data[3:] + [("hot", "row", 1, 1.0), ("new", None, None, None)]
    df, other = local_table(spark, data, SCHEMA), local_table(spark, right, SCHEMA)
    text = lambda r: tuple(None if v is None else str(v) for v in r)
    want = Counter(map(text, data))
    want.subtract(map(text, right))
    got = {tuple(r)[:4]: r["surplus"] for r in table_difference(df, other).collect()}
    assert got == {k: n for k, n in want.items() if n}
    assert tables_equal(df, local_table(spark, data[::-1], SCHEMA)) and not tables_equal(df, other)


def test_single_rows_do_not_move_whole(spark):
    """The only exchange of a table without repeats is that of digests."""
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.repeat(F.lit("z"), 5000).alias("wide"))
    plan = R.distinct_rows(df)._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert R.distinct_rows(df).count() == 1000
    assert R.split_by_digest(df, R.repeated_digests(df))[0].isEmpty()
    assert len(exchanged) <= 1  # that of the (empty) repeated part


def test_empty_tables(spark):
    none = local_table(spark, [], SCHEMA)
    assert R.duplicate_rows(none).first()[0] == 0 and R.distinct_rows(none).count() == 0 and tables_equal(none, none)
