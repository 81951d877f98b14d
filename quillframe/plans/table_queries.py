"""Sources, guarded SQL, coercion, groups, trends and keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import groups as G
from ..operators import keyed as K
from ..operators.lookup import remap_ids
from ..session import local_table, scratch_folder
from ..sources.catalog import Catalog, DatasetMeta, lineage_closure, sample_rows, schema_table
from ..sources.compare import tables_equal
from ..sources.sqlguard import guarded_sql
from .registry import query, rounded

# -- scans, sources, sinks, catalog ---------------------------------------------------------------


@query("scan_orders", "SELECT * FROM orders")
def scan_orders(t):
    return t("orders")


@query("csv_roundtrip", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_roundtrip(t):
    folder = scratch_folder(t.spark)
    t("part").write.csv(f"{folder}/part", header=True)
    catalog = Catalog(t.spark, f"{folder}/catalog")
    return catalog.dataframe(catalog.ingest_csv(f"{folder}/part", "Part list"))


@query(
    "normalize_headers",
    "SELECT n_nationkey AS nation_key, n_name AS nation_key_2, n_regionkey AS \"column\" FROM nation",
)
def normalize_headers(t):
    raw = t("nation").toDF(" Nation Key", "nation-key ", "!?")
    return raw.toDF(*C.normalize_headers(raw.columns))


@query(
    "apply_version",
    """
WITH n AS (SELECT count(*) AS n_all FROM dirty), d AS (SELECT count(*) AS n_distinct FROM (SELECT DISTINCT * FROM dirty) x)
SELECT 'raw' AS version, 'dirty_raw' AS table_name, n_all AS row_count, 7 AS column_count, NULL AS parent_version FROM n
UNION ALL SELECT 'clean_v1', 'dirty_clean_v1', n_distinct, 6, 'raw' FROM d
UNION ALL SELECT 'clean_v2', 'dirty_clean_v2', n_all, 7, 'raw' FROM n
UNION ALL SELECT 'features_v1', 'dirty_features_v1', n_distinct, 7, 'clean_v1' FROM d
""",
    ("dirty",),
)
def apply_version(t):
    catalog = Catalog(t.spark, scratch_folder(t.spark))
    dirty = t("dirty")
    dirty.write.parquet(catalog.path("dirty_raw"))
    raw = catalog.register(DatasetMeta("dirty", "dirty_raw", rows=dirty.count(), columns=len(dirty.columns)))
    first = catalog.apply_cleaning(
        raw, [{"operation": "drop_duplicates"}, {"operation": "drop_columns", "columns": ["constant_col"]}]
    )
    catalog.apply_cleaning(raw, [{"operation": "impute_numeric", "column": "price"}])
    catalog.apply_features(first, [{"operation": "log1p", "column": "price"}])
    r = catalog.registry()
    parents = r.select(F.col("id").alias("parent_id"), F.col("version").alias("parent_version"))
    return r.join(parents, "parent_id", "left").select(
        "version", F.col("table").alias("table_name"), F.col("rows").alias("row_count"),
        F.col("columns").alias("column_count"), "parent_version",
    )


@query("sample_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def first_rows(t):
    return sample_rows(t("orders"), ["o_orderkey"], 10)


@query(
    "schema_table",
    "SELECT column_name, column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') AS is_numeric FROM (DESCRIBE lineitem)",
)
def lineitem_schema(t):
    return schema_table(t("lineitem")).select("column_name", "is_numeric")


@query(
    "lineage_closure",
    """
WITH RECURSIVE c AS (SELECT id, 0 AS depth FROM tree WHERE id = 1
                     UNION ALL SELECT tree.id, depth + 1 FROM tree JOIN c ON tree.parent_id = c.id)
SELECT id, depth FROM c
""",
    ("tree",),
)
def closure(t):
    return lineage_closure(t("tree"), 1)


@query(
    "finite_or_null",
    """
SELECT id, CASE WHEN id % 5 = 0 OR id % 19 = 0 THEN NULL ELSE price END AS value FROM dirty
""",
    ("dirty",),
)
def finite(t):
    injected = (
        F.when(F.col("id") % 5 == 0, F.lit(float("nan")))
        .when(F.col("id") % 19 == 0, F.lit(float("-inf")))
        .otherwise(F.col("price"))
    )
    return C.with_finite(t("dirty").select("id", injected.alias("value")))


@query(
    "tables_equal",
    """
WITH less AS (SELECT * FROM orders WHERE o_orderkey <> (SELECT max(o_orderkey) FROM orders)),
once AS (SELECT DISTINCT * FROM dirty)
SELECT 'same' AS case_name, NOT EXISTS (SELECT * FROM orders EXCEPT ALL SELECT * FROM orders) AS equal
UNION ALL SELECT 'one row less', NOT EXISTS (SELECT * FROM orders EXCEPT ALL SELECT * FROM less)
UNION ALL SELECT 'one copy less', NOT EXISTS (SELECT * FROM dirty EXCEPT ALL SELECT * FROM once)
UNION ALL SELECT 'other order', NOT EXISTS (SELECT * FROM orders EXCEPT ALL SELECT * FROM orders)
""",
    ("dirty",),
)
def equality(t):
    orders, dirty = t("orders"), t("dirty")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    cases = [
        ("same", tables_equal(orders, orders)),
        ("one row less", tables_equal(orders, orders.where(F.col("o_orderkey") != last))),
        ("one copy less", tables_equal(dirty, dirty.distinct())),
        ("other order", tables_equal(orders, orders.repartition(3, "o_custkey"))),
    ]
    return local_table(t.spark, cases, "case_name string, equal boolean")


@query(
    "remap_ids",
    """
SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND c_custkey IS NOT NULL THEN o_custkey + 1000000
                        ELSE o_custkey END AS o_custkey
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""",
)
def remapped(t):
    pairs = t("customer").where("c_custkey % 2 = 0").selectExpr("c_custkey AS old", "c_custkey + 1000000 AS new")
    return remap_ids(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", pairs)


# -- guarded SQL ------------------------------------------------------------------------------------

_SQL = {
    "sql_guarded": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey",
    "sql_join": """
SELECT c_mktsegment, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderpriority""",
    "sql_cte": """
WITH per_order AS (SELECT l_orderkey, count(*) AS items, sum(l_quantity) AS units FROM lineitem GROUP BY l_orderkey)
SELECT o_orderstatus, count(*) AS orders_n, sum(items) AS items_n, sum(units) AS units_n
FROM per_order JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus""",
    "sql_window": """
SELECT o_orderpriority, o_orderstatus, n, rank() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_orderstatus) AS place
FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus) g""",
    "sql_union": """
SELECT 'customer' AS side, c_nationkey AS nationkey, count(*) AS n FROM customer GROUP BY c_nationkey
UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY s_nationkey""",
}
_SQL_ORACLES = {
    **_SQL,
    "sql_guarded": _SQL["sql_guarded"] + " LIMIT 1000",
    "sql_cte": _SQL["sql_cte"].replace("sum(items) AS", "CAST(sum(items) AS BIGINT) AS"),
}


def _guarded(name: str):
    @query(name, _SQL_ORACLES[name])
    def run(t):
        used = [x for x in ("orders", "customer", "supplier", "lineitem") if x in _SQL[name]]
        return guarded_sql(t.spark, _SQL[name], {x: t(x) for x in used}).rows


for _name in _SQL:
    _guarded(_name)


# -- filters and coercion -----------------------------------------------------------------------------


@query(
    "filter_eq_gt_lt",
    """
SELECT count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price
FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 10 AND l_discount < 0.05
""",
)
def filtered(t):
    rows = t("lineitem", [
        {"column": "l_returnflag", "op": "eq", "value": "R"},
        {"column": "l_quantity", "op": "gt", "value": 10},
        {"column": "l_discount", "op": "lt", "value": 0.05},
    ])
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(price).cast("double").alias("sum_price"))


@query("coerce_numeric", "SELECT id, TRY_CAST(number_text AS DOUBLE) AS value FROM dirty", ("dirty",))
def coerced(t):
    return t("dirty").select("id", C.as_number(F.col("number_text")).alias("value"))


@query(
    "date_usable",
    """
SELECT count(TRY_CAST(date_text AS TIMESTAMP)) AS parsed, count(*) AS "rows",
       count(TRY_CAST(date_text AS TIMESTAMP)) >= greatest(3, CAST(floor(count(*) * 0.7) AS BIGINT)) AS usable
FROM dirty
""",
    ("dirty",),
)
def usable_dates(t):
    return C.date_usability(t("dirty"), "date_text")


_BINS = [0, 10, 20, 30, 40, 50]


@query(
    "group_binned",
    """
SELECT CASE WHEN l_quantity < 0 THEN NULL WHEN l_quantity <= 10 THEN '(-0.001, 10.0]'
            WHEN l_quantity <= 20 THEN '(10.0, 20.0]' WHEN l_quantity <= 30 THEN '(20.0, 30.0]'
            WHEN l_quantity <= 40 THEN '(30.0, 40.0]' WHEN l_quantity <= 50 THEN '(40.0, 50.0]' END AS l_quantity_group,
       count(*) AS "count"
FROM lineitem GROUP BY 1
""",
)
def binned_groups(t):
    return G.grouped_analysis(t("lineitem"), "l_quantity", bins=_BINS)


# -- groups and trends --------------------------------------------------------------------------------


@query("group_count", "SELECT priority, count(*) AS \"count\" FROM dirty GROUP BY priority", ("dirty",))
def group_count(t):
    return G.grouped_analysis(t("dirty"), "priority")


@query(
    "group_mean",
    """
SELECT priority, round(CAST(sum(price) AS DOUBLE) / nullif(count(price), 0), 6) AS mean_price, count(*) AS sample_size
FROM dirty_money GROUP BY priority
""",
    ("dirty_money",),
)
def group_mean(t):
    return rounded(G.grouped_analysis(t("dirty_money"), "priority", "price", "mean"))


@query(
    "group_sum",
    "SELECT priority, coalesce(CAST(sum(price) AS DOUBLE), 0) AS sum_price FROM dirty_money GROUP BY priority",
    ("dirty_money",),
)
def group_sum(t):
    return G.grouped_analysis(t("dirty_money"), "priority", "price", "sum")


@query(
    "group_median",
    "SELECT priority, round(quantile_cont(price, 0.5), 6) AS median_price FROM dirty GROUP BY priority",
    ("dirty",),
)
def group_median(t):
    return rounded(G.grouped_analysis(t("dirty"), "priority", "price", "median"))


@query(
    "group_min_max",
    """
SELECT 'min' AS aggregation, priority, min(price) AS value FROM dirty GROUP BY priority
UNION ALL SELECT 'max', priority, max(price) FROM dirty GROUP BY priority
""",
    ("dirty",),
)
def group_min_max(t):
    dirty = t("dirty")
    low, high = (
        G.grouped_analysis(dirty, "priority", "price", a).select(
            F.lit(a).alias("aggregation"), "priority", F.col(f"{a}_price").alias("value"))
        for a in ("min", "max")
    )
    return low.unionByName(high)


@query(
    "group_positive_rate",
    """
SELECT source, round(avg(CASE WHEN lower(outcome) IN ('yes', 'true', '1', '1.0', 'survived', 'subscribed')
                              THEN 1.0 ELSE 0.0 END) * 100, 3) AS positive_rate, count(*) AS sample_size
FROM outcomes GROUP BY source
""",
    ("outcomes",),
)
def group_positive_rate(t):
    return G.grouped_analysis(t("outcomes"), "source", "outcome", "positive_rate")


@query(
    "trend_month_sum",
    """
SELECT strftime(order_date, '%Y-%m') AS period, CAST(sum(revenue) AS DOUBLE) AS value FROM sales GROUP BY 1
""",
    ("sales",),
)
def trend_month_sum(t):
    return G.trend_analysis(t("sales"), "order_date", "revenue", "M", "sum")


@query(
    "trend_quarter_count",
    """
SELECT CAST(year(d) AS VARCHAR) || 'Q' || CAST(quarter(d) AS VARCHAR) AS period, CAST(count(*) AS DOUBLE) AS value
FROM (SELECT TRY_CAST(date_text AS DATE) AS d FROM dirty) x WHERE d IS NOT NULL GROUP BY 1
""",
    ("dirty",),
)
def trend_quarter_count(t):
    return G.trend_analysis(t("dirty"), "date_text", frequency="Q")


@query(
    "trend_week_wednesday",
    """
SELECT strftime(d - CAST((isodow(d) + 3) % 7 AS INTEGER), '%Y-%m-%d') || '/' || strftime(d - CAST((isodow(d) + 3) % 7 AS INTEGER) + 6, '%Y-%m-%d')
  AS period, CAST(sum(revenue) AS DOUBLE) AS value
FROM (SELECT CAST(order_date AS DATE) AS d, revenue FROM sales) x GROUP BY 1
""",
    ("sales",),
)
def trend_week_wednesday(t):
    return G.trend_analysis(t("sales"), "order_date", "revenue", "W-WED", "sum")


@query(
    "trend_fiscal_quarter",
    """
SELECT CAST(year(d) AS VARCHAR) || 'Q' || CAST(quarter(d) AS VARCHAR) AS period, round(CAST(sum(revenue) AS DOUBLE) / count(revenue), 6) AS value
FROM (SELECT CAST(order_date AS DATE) + INTERVAL 9 MONTH AS d, revenue FROM sales) x GROUP BY 1
""",
    ("sales",),
)
def trend_fiscal_quarter(t):
    return rounded(G.trend_analysis(t("sales"), "order_date", "revenue", "Q-MAR", "mean"))


@query(
    "trend_fiscal_year",
    """
SELECT CAST(year(order_date + INTERVAL 6 MONTH) AS VARCHAR) AS period, CAST(count(DISTINCT customer_id) AS DOUBLE) AS value FROM sales GROUP BY 1
""",
    ("sales",),
)
def trend_fiscal_year(t):
    return G.trend_analysis(t("sales"), "order_date", "customer_id", "Y-JUN", "nunique")


@query(
    "trend_business_day",
    """
SELECT strftime(d + CAST(CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS INTEGER), '%Y-%m-%d') AS period, CAST(count(*) AS DOUBLE) AS value
FROM (SELECT CAST(order_date AS DATE) AS d FROM sales) x GROUP BY 1
""",
    ("sales",),
)
def trend_business_day(t):
    return G.trend_analysis(t("sales"), "order_date", frequency="B")


@query(
    "trend_15_minutes",
    """
SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS period, max(value) AS value
FROM events GROUP BY 1
""",
)
def trend_15_minutes(t):
    return G.trend_analysis(t("events"), "ts", "value", "15min", "max", spans=True)


@query(
    "trend_2_months",
    """
SELECT strftime(make_date(year(order_date), 2 * ((month(order_date) + 1) // 2) - 1, 1), '%Y-%m') AS period, CAST(sum(revenue) AS DOUBLE) AS value
FROM sales GROUP BY 1
""",
    ("sales",),
)
def trend_2_months(t):
    return G.trend_analysis(t("sales"), "order_date", "revenue", "2M", "sum", spans=True)


@query(
    "trend_2_months_code",
    "SELECT strftime(order_date, '%Y-%m') AS period, CAST(sum(revenue) AS DOUBLE) AS value FROM sales GROUP BY 1",
    ("sales",),
)
def trend_2_months_code(t):
    return G.trend_analysis(t("sales"), "order_date", "revenue", "2M", "sum")


_DIMENSIONS = ["category", "region", "product"]
_MULTI = """
SELECT dimension, group_value, round(CAST(sum(revenue) AS DOUBLE) / count(revenue), 6) AS mean_revenue,
       count(*) AS sample_size
FROM (SELECT 'category' AS dimension, category AS group_value, revenue FROM sales
      UNION ALL SELECT 'region', region, revenue FROM sales
      UNION ALL SELECT 'product', product, revenue FROM sales) x
GROUP BY dimension, group_value
"""


@query("multi_group_mean", _MULTI, ("sales",))
def multi_group_mean(t):
    return rounded(G.multi_group_mean(t("sales"), _DIMENSIONS, "revenue"))


@query(
    "group_extremes",
    f"""
WITH m AS ({_MULTI}),
u AS (SELECT * FROM (SELECT *, sum(sample_size) OVER (PARTITION BY dimension) AS total FROM m) s
      WHERE sample_size >= greatest(10, floor(total * 0.005))),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY mean_revenue DESC, group_value) AS hi,
             row_number() OVER (PARTITION BY dimension ORDER BY mean_revenue, group_value) AS lo FROM u)
SELECT dimension, 'highest' AS which, group_value, mean_revenue, sample_size FROM r WHERE hi = 1
UNION ALL SELECT dimension, 'lowest', group_value, mean_revenue, sample_size FROM r WHERE lo = 1
""",
    ("sales",),
)
def group_extremes(t):
    means = rounded(G.multi_group_mean(t("sales"), _DIMENSIONS, "revenue"))
    return G.group_extremes(means, "mean_revenue", "group_value", ["dimension"])


# -- logs and keyed tables ------------------------------------------------------------------------------


@query(
    "log_rates",
    """
SELECT count(*) AS runs, round(avg(CASE WHEN status LIKE 'completed%' THEN 1.0 ELSE 0.0 END), 6) AS completion_rate,
       round(avg(CASE WHEN status = 'failed' THEN 1.0 ELSE 0.0 END), 6) AS failure_rate
FROM run_log
""",
    ("run_log",),
)
def log_rates(t):
    return rounded(K.run_rates(t("run_log")))


@query(
    "keyword_topk",
    r"""
SELECT doc_id, CAST(len(list_intersect(list_distinct(regexp_split_to_array(
           regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+')), ['the', 'and', 'with'])) AS INTEGER) AS overlap
FROM documents ORDER BY overlap DESC, doc_id LIMIT 10
""",
)
def keyword_topk(t):
    return K.keyword_topk(t("documents"), "text", "doc_id", "The with and", 10)


@query(
    "upsert_latest",
    """
SELECT user_id, event_type, value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) x
WHERE k = 1
""",
)
def upsert_latest(t):
    events = t("events").select("user_id", "event_type", "ts", "event_id", "value")
    stored, incoming = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    latest = K.upsert_latest([stored, incoming], ["user_id", "event_type"], ["ts", "event_id"])
    return latest.select("user_id", "event_type", "value")


@query(
    "delete_by_key",
    """
SELECT event_id, user_id, event_type, value FROM events
WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 50)
""",
)
def delete_by_key(t):
    events = t("events").select("event_id", "user_id", "event_type", "value")
    doomed = events.where("event_type = 'error' AND value > 50").select("user_id")
    return K.delete_by_key(events, doomed, ["user_id"])
