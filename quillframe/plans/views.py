"""Derived inputs in SQL that Spark and a plain SQL engine read alike: name -> (text, tables used)."""

_DIRTY = """
SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice * 20
            ELSE o_totalprice END AS price,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN '  ' || lower(o_orderpriority)
            ELSE o_orderpriority END AS priority,
       o_orderstatus AS status, 'same' AS constant_col,
       CASE WHEN o_orderkey % 13 = 0 THEN 'bad' ELSE CAST(o_custkey AS STRING) END AS number_text,
       CASE WHEN o_orderkey % 17 = 0 THEN 'not a date' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_text
FROM {orders}
"""

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "sales": (
        """
SELECT l_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
       p_brand AS product, p_type AS category, r_name AS region,
       CAST(l_quantity AS INT) AS quantity, CAST(l_discount AS DECIMAL(4,2)) AS discount,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS revenue,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(0.25 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))
            AS DECIMAL(18,4)) AS profit
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey
""",
        ("lineitem", "orders", "part", "customer", "nation", "region"),
    ),
    # Nulls, duplicates, untidy text, a constant, outliers, bad numbers and bad dates.
    "dirty": (f"SELECT * FROM ({_DIRTY}) t UNION ALL SELECT * FROM ({_DIRTY}) t WHERE id % 50 = 0", ("orders",)),
    # The same with exact prices.
    "dirty_money": (
        f"""
SELECT id, CAST(price AS DECIMAL(18,2)) AS price, priority, status, constant_col, number_text, date_text
FROM (SELECT * FROM ({_DIRTY}) t UNION ALL SELECT * FROM ({_DIRTY}) t WHERE id % 50 = 0) d
""",
        ("orders",),
    ),
    "people": (
        """
SELECT c_custkey AS id, c_name || ', ' || c_mktsegment || '. x' AS name,
       c_custkey % 4 AS sibsp, c_custkey % 3 AS parch,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 90 END AS age, c_acctbal AS fare
FROM {customer}
""",
        ("customer",),
    ),
    "outcomes": (
        """
SELECT l.doc_id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS outcome, toxic, source, n_chars,
       CASE WHEN l.doc_id % 10 = 0 THEN NULL ELSE lang END AS lang
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
""",
        ("labels", "documents"),
    ),
    "run_log": (
        """
SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'completed_with_errors'
       ELSE 'completed' END AS status FROM {events}
""",
        ("events",),
    ),
    "tree": (
        """
SELECT n_nationkey AS id,
       CASE WHEN n_nationkey = 0 THEN NULL ELSE CAST(floor((n_nationkey - 1) / 2.0) AS INT) END AS parent_id
FROM {nation}
""",
        ("nation",),
    ),
}
