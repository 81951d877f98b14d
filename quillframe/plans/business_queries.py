"""Business investigations and chart tables."""

from __future__ import annotations

from ..functions.roles import detect_roles
from ..operators import business as B
from ..operators import charts as V
from .registry import query, rounded

_SALES = ("sales",)


def _sales(t):
    sales = t("sales")
    return sales, detect_roles(sales)


def _months(measure: str = "revenue", trim: bool = True) -> str:
    """Comparable months as ``months`` (month, value, n)."""
    edge = """
    WHERE NOT ((SELECT count(*) FROM monthly) > 2 AND (SELECT median(days) FROM monthly) > 10 AND (
        (month = (SELECT min(month) FROM monthly) AND (SELECT day(min(order_date)) FROM sales) > 3) OR
        (month = (SELECT max(month) FROM monthly) AND
         (SELECT day(max(order_date)) < day(last_day(CAST(max(order_date) AS DATE))) - 2 FROM sales))))"""
    return f"""
WITH monthly AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, CAST(sum({measure}) AS DOUBLE) AS value,
                        count({measure}) AS n, count(DISTINCT CAST(order_date AS DATE)) AS days FROM sales GROUP BY 1),
months AS (SELECT month, value, n FROM monthly {edge if trim else ''})
"""


@query("biz_months", _months() + "SELECT strftime(month, '%Y-%m') AS period, value, n FROM months", _SALES)
def biz_months(t):
    return B.biz_months(*_sales(t))


@query(
    "biz_trend",
    _months() + """
SELECT period, value, prev_value, round(change_pct, 6) AS change_pct, round(first_pct, 6) AS change_from_first_pct FROM (
  SELECT strftime(month, '%Y-%m') AS period, value, lag(value) OVER (ORDER BY month) AS prev_value,
         (value - lag(value) OVER (ORDER BY month)) * 100 / abs(lag(value) OVER (ORDER BY month)) AS change_pct,
         (value - first_value(value) OVER (ORDER BY month)) * 100 / abs(first_value(value) OVER (ORDER BY month)) AS first_pct,
         row_number() OVER (ORDER BY month DESC) AS k FROM months) x WHERE k <= 36""",
    _SALES,
)
def biz_trend(t):
    return rounded(B.biz_trend(*_sales(t)))


@query(
    "biz_trend_summary",
    _months() + """, x AS (SELECT *, lag(value) OVER (ORDER BY month) AS prev FROM months)
SELECT count(*) AS months, round(max_by(value, month), 6) AS latest,
       round((max_by(value, month) - max_by(prev, month)) * 100 / abs(max_by(prev, month)), 6) AS change_vs_prior_pct,
       round((max_by(value, month) - min_by(value, month)) * 100 / abs(min_by(value, month)), 6) AS change_from_first_pct,
       strftime(max_by(month, value), '%Y-%m') AS highest_month, max(value) AS highest,
       strftime(min_by(month, value), '%Y-%m') AS lowest_month, min(value) AS lowest FROM x""",
    _SALES,
)
def biz_trend_summary(t):
    return rounded(B.trend_summary(*_sales(t)))


_KPIS = """
SELECT CAST(sum(revenue) AS DOUBLE) AS total_revenue, CAST(sum(profit) AS DOUBLE) AS total_profit,
       round(CAST(sum(profit) AS DOUBLE) / CAST(sum(revenue) AS DOUBLE) * 100, 6) AS profit_margin_pct,
       count(DISTINCT order_id) AS orders,
       round(CAST(sum(revenue) AS DOUBLE) / count(DISTINCT order_id), 6) AS average_order_value,
       count(DISTINCT customer_id) AS customers, CAST(sum(quantity) AS DOUBLE) AS units FROM sales
"""


@query("biz_kpis", _KPIS, _SALES)
def biz_kpis(t):
    return rounded(B.biz_kpis(*_sales(t)))


@query(
    "biz_quality",
    """
WITH long AS (SELECT 'id' AS c, CAST(id AS VARCHAR) AS v FROM dirty_money UNION ALL SELECT 'price', CAST(price AS VARCHAR) FROM dirty_money
  UNION ALL SELECT 'priority', priority FROM dirty_money UNION ALL SELECT 'status', status FROM dirty_money
  UNION ALL SELECT 'constant_col', constant_col FROM dirty_money UNION ALL SELECT 'number_text', number_text FROM dirty_money
  UNION ALL SELECT 'date_text', date_text FROM dirty_money)
SELECT 'records' AS item, CAST(count(*) AS VARCHAR) AS value FROM dirty_money
UNION ALL SELECT 'missing_pct', CAST(round((count(*) - count(v)) * 100.0 / count(*), 2) AS VARCHAR) FROM long
UNION ALL SELECT 'duplicate_rows', CAST((SELECT count(*) FROM dirty_money) - count(*) AS VARCHAR) FROM (SELECT DISTINCT * FROM dirty_money) d
UNION ALL SELECT 'date_from', CAST(min(TRY_CAST(date_text AS DATE)) AS VARCHAR) FROM dirty_money
UNION ALL SELECT 'date_to', CAST(max(TRY_CAST(date_text AS DATE)) AS VARCHAR) FROM dirty_money
UNION ALL SELECT 'issue_1', 'medium:duplicates:'
UNION ALL SELECT 'issue_2', 'medium:missing:price' FROM long WHERE c = 'price' HAVING count(*) > count(v)
UNION ALL SELECT 'issue_3', 'medium:missing:priority' FROM long WHERE c = 'priority' HAVING count(*) > count(v)
UNION ALL SELECT 'issue_4', 'medium:constant:constant_col' FROM long WHERE c = 'constant_col' HAVING count(DISTINCT v) = 1
UNION ALL SELECT 'issue_5', 'low:cardinality:id' FROM long WHERE c = 'id' HAVING count(DISTINCT v) > 0.3 * count(*)
""",
    ("dirty_money",),
)
def biz_quality(t):
    dirty = t("dirty_money")
    return B.biz_quality(dirty, detect_roles(dirty, {"date": "date_text"}))


_RANKING = """
SELECT {group} AS group_value, CAST(sum({measure}) AS DOUBLE) AS value, count(*) AS n FROM sales GROUP BY {group}
HAVING count(*) >= greatest(2, floor((SELECT count(*) FROM sales) * 0.001)) ORDER BY value DESC, group_value LIMIT 12
"""


@query("biz_ranking", _RANKING.format(group="category", measure="revenue"), _SALES)
def biz_ranking(t):
    return B.biz_ranking(*_sales(t))


@query("biz_ranking_product_profit", _RANKING.format(group="product", measure="profit"), _SALES)
def biz_ranking_product_profit(t):
    return B.biz_ranking(*_sales(t), "Which product has the best profit?")


_DRIVER_FIELDS = ("quantity", "discount", "profit")
_RANKS = "SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in (*_DRIVER_FIELDS, "revenue")
) + " FROM sales"


@query(
    "biz_drivers",
    f"WITH r AS ({_RANKS}) " + " UNION ALL ".join(
        f"SELECT 'revenue' AS target, '{c}' AS feature, round(corr({c}, revenue), 6) AS r, count(*) AS n FROM r" for c in _DRIVER_FIELDS
    ),
    _SALES,
)
def biz_drivers(t):
    return rounded(B.biz_drivers(t("sales")))


@query(
    "biz_quartile_contrast",
    """
WITH q AS (SELECT quantile_cont(CAST(profit AS DOUBLE), 0.25) AS a, quantile_cont(CAST(profit AS DOUBLE), 0.75) AS b FROM sales)
SELECT 'profit' AS feature, 'lower quarter' AS quarter, round(median(CAST(revenue AS DOUBLE)), 6) AS median_target, count(*) AS n
FROM sales, q WHERE profit <= a
UNION ALL SELECT 'profit', 'upper quarter', round(median(CAST(revenue AS DOUBLE)), 6), count(*) FROM sales, q WHERE profit >= b
""",
    _SALES,
)
def biz_quartile_contrast(t):
    return rounded(B.biz_quartile_contrast(t("sales")))


_LAST_TWO = _months() + """, two AS (SELECT month, value, row_number() OVER (ORDER BY month DESC) AS k FROM months),
a AS (SELECT * FROM two WHERE k = 2), b AS (SELECT * FROM two WHERE k = 1)
"""


@query(
    "biz_change",
    _LAST_TWO + """SELECT strftime(a.month, '%Y-%m') AS before_period, strftime(b.month, '%Y-%m') AS after_period,
    a.value AS before_value, b.value AS after_value, round(b.value - a.value, 6) AS delta FROM a, b""",
    _SALES,
)
def biz_change(t):
    return rounded(B.biz_change(*_sales(t)))


@query(
    "biz_volume_value",
    _LAST_TWO + """, o AS (SELECT count(DISTINCT CASE WHEN date_trunc('month', order_date) = a.month THEN order_id END) AS oa,
    count(DISTINCT CASE WHEN date_trunc('month', order_date) = b.month THEN order_id END) AS ob FROM sales, a, b)
SELECT oa AS orders_before, ob AS orders_after, round((ob - oa) * 100.0 / oa, 6) AS orders_change_pct,
       round(a.value / oa, 6) AS value_before, round(b.value / ob, 6) AS value_after,
       round((b.value / ob / (a.value / oa) - 1) * 100, 6) AS value_change_pct FROM o, a, b""",
    _SALES,
)
def biz_volume_value(t):
    return rounded(B.biz_volume_value(*_sales(t)))


@query(
    "biz_contribution",
    _LAST_TWO + """, c AS (SELECT category AS group_value,
    coalesce(CAST(sum(CASE WHEN date_trunc('month', order_date) = a.month THEN revenue END) AS DOUBLE), 0) AS before_value,
    coalesce(CAST(sum(CASE WHEN date_trunc('month', order_date) = b.month THEN revenue END) AS DOUBLE), 0) AS after_value
    FROM sales, a, b WHERE date_trunc('month', order_date) IN (a.month, b.month) GROUP BY category)
SELECT group_value, before_value, after_value, round(after_value - before_value, 6) AS contribution FROM c, a, b
ORDER BY CASE WHEN b.value < a.value THEN after_value - before_value ELSE before_value - after_value END, group_value LIMIT 3""",
    _SALES,
)
def biz_contribution(t):
    return rounded(B.biz_contribution(*_sales(t)))


@query(
    "biz_discounts",
    """
SELECT discount > 0 AS discounted, count(*) AS n, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(profit) AS DOUBLE) AS profit,
       round(CAST(sum(profit) AS DOUBLE) * 100 / CAST(sum(revenue) AS DOUBLE), 6) AS margin_pct FROM sales GROUP BY 1
""",
    _SALES,
)
def biz_discounts(t):
    return rounded(B.biz_discounts(*_sales(t)))


@query(
    "biz_customer_value",
    """
SELECT customer_id AS customer, CAST(sum(revenue) AS DOUBLE) AS revenue, count(*) AS n FROM sales
GROUP BY customer_id ORDER BY revenue DESC, customer LIMIT 3
""",
    _SALES,
)
def biz_customer_value(t):
    return B.biz_customer_value(*_sales(t))


@query(
    "biz_top20_share",
    """
WITH c AS (SELECT customer_id, CAST(sum(revenue) AS DOUBLE) AS s FROM sales GROUP BY customer_id),
r AS (SELECT s, row_number() OVER (ORDER BY s DESC) AS k, count(*) OVER () AS n FROM c)
SELECT count(*) AS customers, CAST(ceil(max(n) * 2 / 10.0) AS BIGINT) AS top_customers,
       round(sum(CASE WHEN k <= ceil(n * 2 / 10.0) THEN s ELSE 0 END) * 100 / sum(s), 6) AS top_share_pct FROM r
""",
    _SALES,
)
def biz_top20_share(t):
    return rounded(B.biz_top20_share(*_sales(t)))


@query(
    "biz_anomalies",
    """
WITH q AS (SELECT quantile_cont(CAST(revenue AS DOUBLE), 0.25) AS a, quantile_cont(CAST(revenue AS DOUBLE), 0.75) AS b FROM sales),
w AS (SELECT a - 1.5 * (b - a) AS low, b + 1.5 * (b - a) AS high FROM q)
SELECT 'revenue' AS measure, round(max(low), 6) AS low, round(max(high), 6) AS high, count(*) AS n,
       CAST(sum(CASE WHEN revenue < low OR revenue > high THEN 1 ELSE 0 END) AS BIGINT) AS anomalies,
       round(sum(CASE WHEN revenue < low OR revenue > high THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS share_pct FROM sales, w
""",
    _SALES,
)
def biz_anomalies(t):
    return rounded(B.biz_anomalies(*_sales(t)))


@query(
    "biz_forecast",
    _months() + """, f AS (SELECT CAST(max(month) + INTERVAL 1 MONTH AS DATE) AS month FROM months)
SELECT strftime(f.month, '%Y-%m') AS period, value AS estimate, 'same month last year' AS method
FROM f LEFT JOIN months m ON m.month = f.month - INTERVAL 12 MONTH""",
    _SALES,
)
def biz_forecast(t):
    return B.biz_forecast(*_sales(t))


@query(
    "biz_backtest",
    _months() + """SELECT round(avg(abs(m.value - y.value)), 6) AS mean_abs_error, count(*) AS comparisons
FROM months m JOIN months y ON y.month = m.month - INTERVAL 12 MONTH""",
    _SALES,
)
def biz_backtest(t):
    return rounded(B.biz_backtest(*_sales(t)))


_YOY = """
 my AS (SELECT CAST(sum(revenue) AS DOUBLE) AS r, CAST(sum(profit) AS DOUBLE) AS p,
             row_number() OVER (ORDER BY date_trunc('month', order_date) DESC) AS k
      FROM sales GROUP BY date_trunc('month', order_date)),
s AS (SELECT sum(CASE WHEN k <= 12 THEN r END) AS r1, sum(CASE WHEN k > 12 THEN r END) AS r0,
             sum(CASE WHEN k <= 12 THEN p END) AS p1, sum(CASE WHEN k > 12 THEN p END) AS p0 FROM my WHERE k <= 24 HAVING count(*) = 24),
y AS (SELECT round((r1 - r0) * 100 / r0, 6) AS revenue_change_pct, round((p1 - p0) * 100 / p0, 6) AS profit_change_pct,
             round(p0 * 100 / r0, 6) AS old_margin_pct, round(p1 * 100 / r1, 6) AS new_margin_pct FROM s)
"""


@query("biz_yoy", "WITH " + _YOY + " SELECT * FROM y", _SALES)
def biz_yoy(t):
    return rounded(B.biz_yoy(*_sales(t)))


@query(
    "biz_investigation",
    _months() + "," + _YOY + """,
kp AS (""" + _KPIS + """),
pm AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, CAST(sum(profit) AS DOUBLE) AS value FROM sales GROUP BY 1),
rk AS (SELECT product, CAST(sum(profit) AS DOUBLE) AS v FROM sales GROUP BY product
       HAVING count(*) >= greatest(2, floor((SELECT count(*) FROM sales) * 0.001)))
SELECT * FROM (UNPIVOT (SELECT total_revenue, total_profit, profit_margin_pct, CAST(orders AS DOUBLE) AS orders, average_order_value,
                        CAST(customers AS DOUBLE) AS customers, units FROM kp) ON COLUMNS(*) INTO NAME item VALUE value)
UNION ALL SELECT * FROM (UNPIVOT y ON COLUMNS(*) INTO NAME item VALUE value)
UNION ALL SELECT 'best_profit:' || max_by(product, v), max(v) FROM rk
UNION ALL SELECT 'worst_profit:' || min_by(product, v), min(v) FROM rk
UNION ALL SELECT * FROM (SELECT 'revenue_trend:' || strftime(month, '%Y-%m'),
    round((value - lag(value) OVER (ORDER BY month)) * 100 / abs(lag(value) OVER (ORDER BY month)), 6) FROM months ORDER BY month DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'profit_trend:' || strftime(month, '%Y-%m'),
    round((value - lag(value) OVER (ORDER BY month)) * 100 / abs(lag(value) OVER (ORDER BY month)), 6)
    FROM pm WHERE month IN (SELECT month FROM months) ORDER BY month DESC LIMIT 1)
""",
    _SALES,
)
def biz_investigation(t):
    return rounded(B.biz_investigation(*_sales(t)))


# -- charts -------------------------------------------------------------------------------------------


@query("chart_bar_count", "SELECT priority AS x, CAST(count(*) AS DOUBLE) AS y FROM dirty GROUP BY priority", ("dirty",))
def chart_bar_count(t):
    return V.chart_data(t("dirty"), {"chart_type": "bar", "x": "priority", "aggregation": "count"})


@query("chart_line_sum", "SELECT order_date AS x, CAST(sum(revenue) AS DOUBLE) AS y FROM sales GROUP BY order_date", _SALES)
def chart_line_sum(t):
    return V.chart_data(t("sales"), {"chart_type": "line", "x": "order_date", "y": "revenue", "aggregation": "sum"})


@query(
    "chart_donut",
    "SELECT category AS x, round(median(CAST(revenue AS DOUBLE)), 6) AS y FROM sales GROUP BY category", _SALES,
)
def chart_donut(t):
    return rounded(V.chart_data(
        t("sales"), {"chart_type": "donut", "x": "category", "y": "revenue", "aggregation": "median"}))


@query(
    "chart_scatter_sample",
    """
SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem
ORDER BY md5(l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber || ':42'),
         l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 5000
""",
)
def chart_scatter_sample(t):
    return V.chart_data(t("lineitem"), {
        "chart_type": "scatter", "x": "l_quantity", "y": "l_extendedprice", "color": "l_returnflag",
        "key": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    })


@query(
    "chart_histogram",
    """
WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem),
b AS (SELECT CAST(least(floor((l_extendedprice - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(lo + i * w, 6) AS lo, round(CASE WHEN i = 29 THEN hi ELSE lo + (i + 1) * w END, 6) AS hi,
       coalesce(n, 0) AS "count" FROM range(30) r(i) CROSS JOIN e LEFT JOIN b ON b.bin = i
""",
)
def chart_histogram(t):
    return rounded(V.chart_data(t("lineitem"), {"chart_type": "histogram", "x": "l_extendedprice"}))


@query(
    "chart_box",
    """
WITH q AS (SELECT priority AS x, quantile_cont(price, 0.25) AS q1, median(price) AS med, quantile_cont(price, 0.75) AS q3
           FROM dirty GROUP BY priority)
SELECT x, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       min(CASE WHEN price >= q1 - 1.5 * (q3 - q1) THEN price END) AS lo_whisker,
       max(CASE WHEN price <= q3 + 1.5 * (q3 - q1) THEN price END) AS hi_whisker
FROM q JOIN dirty ON priority IS NOT DISTINCT FROM x GROUP BY x, q1, med, q3
""",
    ("dirty",),
)
def chart_box(t):
    return rounded(V.chart_data(t("dirty"), {"chart_type": "box", "x": "priority", "y": "price"}))


@query(
    "chart_heatmap",
    """
WITH m AS (SELECT round(corr(o_orderkey, o_custkey), 4) AS kc, round(corr(o_orderkey, o_totalprice), 4) AS kp,
                  round(corr(o_custkey, o_totalprice), 4) AS cp FROM orders)
SELECT 'o_orderkey' AS a, 'o_orderkey' AS b, 1.0 AS r FROM m UNION ALL SELECT 'o_custkey', 'o_custkey', 1.0 FROM m
UNION ALL SELECT 'o_totalprice', 'o_totalprice', 1.0 FROM m
UNION ALL SELECT 'o_orderkey', 'o_custkey', kc FROM m UNION ALL SELECT 'o_custkey', 'o_orderkey', kc FROM m
UNION ALL SELECT 'o_orderkey', 'o_totalprice', kp FROM m UNION ALL SELECT 'o_totalprice', 'o_orderkey', kp FROM m
UNION ALL SELECT 'o_custkey', 'o_totalprice', cp FROM m UNION ALL SELECT 'o_totalprice', 'o_custkey', cp FROM m
""",
)
def chart_heatmap(t):
    return V.chart_data(t("orders"), {"chart_type": "heatmap"})
