"""Profiles, correlations, cleaning, features, tests and drivers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as K
from ..operators import features as X
from ..operators import profile as P
from ..operators.correlation import correlations
from ..operators.drivers import DriverAnalysis
from ..operators.stats import statistical_test
from ..session import local_table
from .registry import query, rounded

_COLUMNS = ["id", "price", "priority", "status", "constant_col", "number_text", "date_text"]
_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM dirty_money" for c in _COLUMNS
)
_FACTS = f"""
WITH long AS ({_LONG}),
facts AS (SELECT column_name, count(*) - count(value) AS missing,
                 round((count(*) - count(value)) * 100.0 / count(*), 2) AS missing_pct,
                 count(DISTINCT value) AS uniq, count(*) AS n
          FROM long GROUP BY column_name)
"""
_DIRTY = ("dirty_money",)


def _profile(t):
    return P.Profile(t("dirty_money"))


@query(
    "profile_shape",
    _FACTS + """SELECT max(n) AS "rows", count(*) AS "columns", CAST(sum(missing) AS BIGINT) AS missing_cells,
    round(sum(missing) * 100.0 / sum(n), 2) AS missing_pct FROM facts""",
    _DIRTY,
)
def profile_shape(t):
    return _profile(t).shape()


@query(
    "profile_duplicates",
    "SELECT (SELECT count(*) FROM dirty_money) - count(*) AS duplicate_rows FROM (SELECT DISTINCT * FROM dirty_money) d",
    _DIRTY,
)
def profile_duplicates(t):
    return P.duplicate_rows(t("dirty_money"))


@query("profile_columns", _FACTS + "SELECT column_name, missing, missing_pct, uniq AS \"unique\" FROM facts", _DIRTY)
def profile_columns(t):
    return _profile(t).column_table()


@query("missing_report", _FACTS + "SELECT column_name, missing, missing_pct, uniq AS \"unique\" FROM facts WHERE missing > 0", _DIRTY)
def missing_report(t):
    return _profile(t).missing_report()


@query(
    "profile_flags",
    _FACTS + """SELECT column_name, uniq <= 1 AS constant, uniq > 50 AND uniq > 0.3 * n AS high_cardinality,
    uniq = n AND (column_name LIKE '%id%' OR uniq > 100) AS potential_id FROM facts""",
    _DIRTY,
)
def profile_flags(t):
    return _profile(t).flags()


@query(
    "profile_top_values",
    f"""
WITH long AS ({_LONG}), counts AS (SELECT column_name, value, count(*) AS n FROM long GROUP BY ALL)
SELECT * FROM (SELECT column_name, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value NULLS LAST) AS INTEGER)
                      AS position, value, n AS "count" FROM counts) r WHERE position <= 8
""",
    _DIRTY,
)
def profile_top_values(t):
    return _profile(t).top_values()


def _per_numeric(template: str) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in ("id", "price"))


@query(
    "profile_numeric",
    _per_numeric("""
SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS minimum, CAST(max({c}) AS DOUBLE) AS maximum,
       round(CAST(sum({c}) AS DOUBLE) / count({c}), 6) AS mean, round(median(CAST({c} AS DOUBLE)), 6) AS median,
       round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75 FROM dirty_money"""),
    _DIRTY,
)
def profile_numeric(t):
    return rounded(_profile(t).numeric_table().drop("skew"))


@query(
    "profile_skew",
    _per_numeric("SELECT '{c}' AS column_name, round(skewness(CAST({c} AS DOUBLE)), 6) AS skew FROM dirty_money"),
    _DIRTY,
)
def profile_skew(t):
    return rounded(_profile(t).numeric_table().select("column_name", "skew"))


@query(
    "profile_outliers",
    _per_numeric("""
SELECT '{c}' AS column_name, (SELECT count(*) FROM dirty_money,
    (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b FROM dirty_money) q
    WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers"""),
    _DIRTY,
)
def profile_outliers(t):
    return _profile(t).outliers()


@query(
    "profile_leakage",
    """
SELECT 'status' AS column_name, 'price' AS target, 'leakage: set after payment' AS reason, CAST(NULL AS DOUBLE) AS score
UNION ALL
SELECT 'gross', 'price', 'near-perfect correlation', round(corr(price, price * 1.19 + o % 3), 4)
FROM (SELECT o_totalprice AS price, o_orderkey AS o FROM orders) x HAVING abs(corr(price, price * 1.19 + o % 3)) > 0.98
""",
)
def profile_leakage(t):
    rows = t("orders").selectExpr(
        "o_orderkey AS id", "o_totalprice AS price", "o_totalprice * 1.19D + o_orderkey % 3 AS gross", "o_orderstatus AS status"
    )
    return P.Profile(rows, ["price"], {"status": "leakage: set after payment"}).leakage()


@query(
    "overview_target_dist",
    """
SELECT outcome AS value, count(*) AS "count", round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percentage
FROM outcomes GROUP BY outcome
""",
    ("outcomes",),
)
def overview_target_dist(t):
    return P.target_overview(t("outcomes"), "outcome")


@query(
    "overview_numeric",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, round(avg(CAST({c} AS DECIMAL(18,2))), 2) AS mean,
        round(median({c}), 2) AS median, CAST(min({c}) AS DOUBLE) AS minimum, CAST(max({c}) AS DOUBLE) AS maximum FROM lineitem"""
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    ),
)
def overview_numeric(t):
    return P.numeric_highlights(t("lineitem"))


@query(
    "overview_categorical",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST(position AS INTEGER) AS position, value, n AS "count" FROM
        (SELECT {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c} NULLS LAST) AS position
         FROM outcomes GROUP BY {c}) x WHERE position <= 3"""
        for c in ("source", "lang")
    ),
    ("outcomes",),
)
def overview_categorical(t):
    return P.categorical_highlights(t("outcomes"), "outcome")


_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


_ONE_AGG = (
    "WITH m AS (SELECT "
    + ", ".join(f"round(corr({a}, {b}), 4) AS r_{i}_{j}" for i, a in enumerate(_NUMERIC) for j, b in enumerate(_NUMERIC) if i < j)
    + " FROM {source}) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {'1.0' if i == j else f'r_{min(i, j)}_{max(i, j)}'} AS r FROM m"
        for i, a in enumerate(_NUMERIC) for j, b in enumerate(_NUMERIC)
    )
)


@query("corr_pearson", _ONE_AGG.format(source="lineitem"))
def corr_pearson(t):
    return correlations(t("lineitem").select(*_NUMERIC))


_RANKED = "(SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _NUMERIC
) + " FROM lineitem) ranked"


@query("corr_spearman", _ONE_AGG.format(source=_RANKED))
def corr_spearman(t):
    return correlations(t("lineitem").select(*_NUMERIC), "spearman")


@query(
    "corr_kendall",
    """
WITH p AS (SELECT l_quantity AS x, l_linenumber AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) AS up,
             sqrt(sum(a.n * b.n * abs(sign(a.x - b.x))) * sum(a.n * b.n * abs(sign(a.y - b.y)))) AS scale FROM p a, p b)
SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE round(up / scale, 4) END AS r
FROM s, (VALUES ('l_quantity'), ('l_linenumber')) va(a), (VALUES ('l_quantity'), ('l_linenumber')) vb(b)
""",
)
def corr_kendall(t):
    return correlations(t("lineitem").select("l_quantity", "l_linenumber"), "kendall")


@query(
    "quality_issues",
    _FACTS + """, dup AS (SELECT (SELECT count(*) FROM dirty_money) - count(*) AS d FROM (SELECT DISTINCT * FROM dirty_money) x),
sk AS (SELECT 'price' AS column_name, skewness(CAST(price AS DOUBLE)) AS s FROM dirty_money
       UNION ALL SELECT 'id', skewness(CAST(id AS DOUBLE)) FROM dirty_money)
SELECT 'medium' AS severity, 'duplicates' AS type, NULL AS column_name, CAST(d AS DOUBLE) AS value FROM dup WHERE d > 0
UNION ALL SELECT CASE WHEN missing_pct > 30 THEN 'high' ELSE 'medium' END, 'missing', column_name, missing_pct FROM facts WHERE missing_pct > 0
UNION ALL SELECT 'medium', 'constant', column_name, NULL FROM facts WHERE uniq <= 1
UNION ALL SELECT 'low', 'cardinality', column_name, CAST(uniq AS DOUBLE) FROM facts WHERE uniq > 50 AND uniq > 0.3 * n
UNION ALL SELECT 'low', 'skew', column_name, round(s, 6) FROM sk WHERE abs(s) > 2
""",
    _DIRTY,
)
def quality_issues(t):
    return rounded(_profile(t).quality_issues())


# -- cleaning ---------------------------------------------------------------------------------------


def _cleaned(name: str, operation: dict, oracle: str):
    @query(name, oracle, ("dirty",))
    def run(t):
        return K.clean(t("dirty"), [operation])[0]


def _replacing(**changed: str) -> str:
    items = ", ".join(f"{changed.get(c, c)} AS {c}" for c in _COLUMNS)
    return f"SELECT {items} FROM dirty"


_cleaned("clean_dedup", {"operation": "drop_duplicates"}, "SELECT DISTINCT * FROM dirty")
_cleaned(
    "clean_impute_median", {"operation": "impute_numeric", "column": "price"},
    _replacing(price="coalesce(price, (SELECT median(price) FROM dirty))"),
)
_cleaned(
    "clean_impute_mode", {"operation": "impute_categorical", "column": "priority"},
    _replacing(priority="""coalesce(priority, (SELECT priority FROM dirty WHERE priority IS NOT NULL
               GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1))"""),
)
_cleaned(
    "clean_standardize", {"operation": "standardize_categories", "column": "priority"},
    _replacing(priority=r"lower(regexp_replace(priority, '^\s+|\s+$', '', 'g'))"),
)
_cleaned(
    "clean_convert", {"operation": "convert_type", "column": "id", "dtype": "float64"},
    _replacing(id="CAST(id AS DOUBLE)"),
)
_cleaned("clean_drop", {"operation": "drop_columns", "columns": ["constant_col", "absent"]},
         "SELECT id, price, priority, status, number_text, date_text FROM dirty")


@query(
    "clean_impute_mean",
    """SELECT id, round(coalesce(CAST(price AS DOUBLE), (SELECT CAST(sum(price) AS DOUBLE) / count(price) FROM dirty_money)), 6) AS price
       FROM dirty_money""",
    _DIRTY,
)
def clean_impute_mean(t):
    return rounded(K.clean(t("dirty_money"), [
        {"operation": "impute_numeric", "column": "price", "strategy": "mean"}])[0].select("id", "price"))


@query(
    "clean_cap",
    """
SELECT id, CASE WHEN price IS NOT NULL THEN round(least(greatest(price, a - 1.5 * (b - a)), b + 1.5 * (b - a)), 6) END AS price
FROM dirty, (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM dirty) q
""",
    ("dirty",),
)
def clean_cap(t):
    return rounded(K.clean(t("dirty"), [{"operation": "cap_outliers", "column": "price"}])[0].select("id", "price"))


@query(
    "clean_recommend",
    _FACTS + """SELECT 'drop_duplicates' AS operation, NULL AS column_name
      WHERE (SELECT count(*) FROM dirty_money) > (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_money) d)
UNION ALL SELECT 'impute_numeric', column_name FROM facts WHERE missing > 0 AND column_name IN ('id', 'price')
UNION ALL SELECT 'impute_categorical', column_name FROM facts
      WHERE missing > 0 AND missing_pct <= 70 AND column_name NOT IN ('id', 'price')
UNION ALL SELECT 'drop_columns', column_name FROM facts WHERE uniq <= 1""",
    _DIRTY,
)
def clean_recommend(t):
    steps = [
        (op["operation"], op.get("column") or next(iter(op.get("columns", [])), None))
        for op in K.recommend_cleaning(t("dirty_money"))
    ]
    return local_table(t.spark, steps, "operation string, column_name string")


_STEPS = [
    {"operation": "drop_duplicates"},
    {"operation": "impute_numeric", "column": "price"},
    {"operation": "drop_columns", "columns": ["priority"]},
]


@query(
    "clean_preview",
    """
WITH d AS (SELECT DISTINCT * FROM dirty),
a AS (SELECT count(*) AS n FROM dirty), b AS (SELECT count(*) AS n,
     count(*) - count(price) AS mp, count(*) - count(priority) AS mq FROM d)
SELECT 1 AS step, a.n AS rows_before, b.n AS rows_after, mp + mq AS missing_after FROM a, b
UNION ALL SELECT 2, n, n, mq FROM b UNION ALL SELECT 3, n, n, 0 FROM b
""",
    ("dirty",),
)
def clean_preview(t):
    return K.preview_cleaning(t("dirty"), _STEPS).select("step", "rows_before", "rows_after", "missing_after")


# -- features ---------------------------------------------------------------------------------------


def _feature(name: str, source: str, operations: list[dict], output: list[str], oracle: str):
    @query(name, oracle, (source,) if source in {"people"} else ())
    def run(t):
        return rounded(X.engineer(t(source), operations)[0].select(*output), 9)


_FAMILY = {"operation": "family_size", "sibsp": "sibsp", "parch": "parch"}
_feature("feat_family_size", "people", [_FAMILY], ["id", "family_size"],
         "SELECT id, sibsp + parch + 1 AS family_size FROM people")
_feature("feat_is_alone", "people", [_FAMILY, {"operation": "is_alone", "from": "family_size"}], ["id", "is_alone"],
         "SELECT id, CASE WHEN sibsp + parch = 0 THEN 1 ELSE 0 END AS is_alone FROM people")
_feature("feat_title", "people", [{"operation": "title_from_name", "column": "name"}], ["id", "title"],
         r"SELECT id, CASE WHEN regexp_matches(name, ',\s*([^.]*)\.') THEN regexp_extract(name, ',\s*([^.]*)\.', 1) ELSE 'Unknown' END AS title FROM people")
_feature(
    "feat_per_person", "people",
    [_FAMILY, {"operation": "fare_per_person", "fare": "fare", "family": "family_size"}], ["id", "fare_per_person"],
    "SELECT id, round(fare / (sibsp + parch + 1), 9) AS fare_per_person FROM people",
)
_AGES = [0, 18, 30, 45, 60, 120]
_feature(
    "feat_age_group", "people", [{"operation": "age_group", "column": "age", "bins": _AGES}], ["id", "age_group"],
    """
SELECT id, CASE WHEN age < 0 THEN NULL WHEN age <= 18 THEN '(-0.001, 18.0]' WHEN age <= 30 THEN '(18.0, 30.0]'
    WHEN age <= 45 THEN '(30.0, 45.0]' WHEN age <= 60 THEN '(45.0, 60.0]' WHEN age <= 120 THEN '(60.0, 120.0]' END AS age_group
FROM people""",
)
_feature(
    "feat_date_parts", "orders", [{"operation": "date_parts", "column": "o_orderdate"}],
    ["o_orderkey", "o_orderdate_year", "o_orderdate_month", "o_orderdate_dow"],
    """
SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month,
       isodow(o_orderdate) - 1 AS o_orderdate_dow FROM orders""",
)
_feature(
    "feat_ratio", "people", [{"operation": "ratio", "name": "fare_per_sib", "numerator": "fare", "denominator": "sibsp"}],
    ["id", "fare_per_sib"], "SELECT id, round(fare / nullif(sibsp, 0), 9) AS fare_per_sib FROM people",
)
_feature(
    "feat_bin_edges", "people", [{"operation": "bin", "name": "age_bin", "column": "age", "bins": _AGES}], ["id", "age_bin"],
    """
SELECT id, CASE WHEN age <= 0 THEN NULL WHEN age <= 18 THEN '(0, 18]' WHEN age <= 30 THEN '(18, 30]'
    WHEN age <= 45 THEN '(30, 45]' WHEN age <= 60 THEN '(45, 60]' WHEN age <= 120 THEN '(60, 120]' END AS age_bin
FROM people""",
)
_feature(
    "feat_bin_equal_width", "people",
    [{"operation": "bin", "name": "age_bin", "column": "age", "bins": 4, "labels": ["a", "b", "c", "d"]}], ["id", "age_bin"],
    """
SELECT id, CASE WHEN age IS NULL THEN NULL WHEN age <= lo + w THEN 'a' WHEN age <= lo + 2 * w THEN 'b'
                WHEN age <= lo + 3 * w THEN 'c' ELSE 'd' END AS age_bin
FROM people, (SELECT min(age) AS lo, (max(age) - min(age)) / 4.0 AS w FROM people) q""",
)
_feature("feat_log1p", "people", [{"operation": "log1p", "column": "fare"}], ["id", "fare_log"],
         "SELECT id, round(ln(1 + greatest(fare, 0)), 9) AS fare_log FROM people")
_feature(
    "feat_frequency", "part", [{"operation": "frequency_encode", "column": "p_brand"}], ["p_partkey", "p_brand_frequency"],
    """
SELECT p_partkey, round(count(*) OVER (PARTITION BY p_brand) * 1.0 / count(*) OVER (), 9) AS p_brand_frequency FROM part""",
)
_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_feature(
    "feat_one_hot", "part", [{"operation": "one_hot", "columns": ["p_type"]}],
    ["p_partkey", *[f"p_type_{v}" for v in _TYPES]],
    "SELECT p_partkey, " + ", ".join(f"CAST(p_type = '{v}' AS INTEGER) AS p_type_{v}" for v in _TYPES) + " FROM part",
)


@query(
    "feat_preview",
    "SELECT id, sibsp + parch + 1 AS family_size, CASE WHEN sibsp + parch = 0 THEN 1 ELSE 0 END AS is_alone FROM people ORDER BY id LIMIT 5",
    ("people",),
)
def feat_preview(t):
    return X.preview_features(t("people"), [_FAMILY, {"operation": "is_alone", "from": "family_size"}], "id")["sample"]


# -- tests ------------------------------------------------------------------------------------------


def _test_columns(df, *extra):
    return rounded(df.select("statistic", "df", *extra, "n", "effect_size"))


@query(
    "test_pearson",
    """
SELECT round(corr(l_quantity, l_extendedprice), 6) AS statistic, CAST(count(*) - 2 AS DOUBLE) AS df, count(*) AS n,
       round(corr(l_quantity, l_extendedprice), 6) AS effect_size FROM lineitem""",
)
def test_pearson(t):
    return _test_columns(statistical_test(t("lineitem"), "pearson", ["l_quantity", "l_extendedprice"]))


@query(
    "test_spearman",
    """
SELECT round(corr(x, y), 6) AS statistic, CAST(count(*) - 2 AS DOUBLE) AS df, count(*) AS n, round(corr(x, y), 6) AS effect_size
FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x,
             rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y
      FROM lineitem) r""",
)
def test_spearman(t):
    return _test_columns(statistical_test(t("lineitem"), "spearman", ["l_quantity", "l_extendedprice"]))


@query(
    "test_chi_square",
    """
WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY ALL),
ra AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM c GROUP BY b),
n AS (SELECT sum(o) AS n FROM c),
e AS (SELECT coalesce(o, 0) AS o, ra * cb / CAST(n AS DOUBLE) AS e FROM ra CROSS JOIN cb CROSS JOIN n
      LEFT JOIN c ON c.a = ra.a AND c.b = cb.b),
x AS (SELECT sum((o - e) * (o - e) / e) AS chi FROM e)
SELECT round(chi, 6) AS statistic, CAST(((SELECT count(*) FROM ra) - 1) * ((SELECT count(*) FROM cb) - 1) AS DOUBLE) AS df,
       CAST(n AS BIGINT) AS n,
       round(sqrt(chi / (n * greatest(1, least((SELECT count(*) FROM ra), (SELECT count(*) FROM cb)) - 1))), 6) AS effect_size
FROM x, n""",
)
def test_chi_square(t):
    return _test_columns(statistical_test(t("lineitem"), "chi_square", ["l_returnflag", "l_linestatus"]))


@query(
    "test_welch_t",
    """
WITH g AS (SELECT o_orderstatus AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v, var_pop(o_totalprice) AS p
           FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus),
x AS (SELECT * FROM g WHERE g = 'F'), y AS (SELECT * FROM g WHERE g = 'O')
SELECT round((x.m - y.m) / sqrt(x.v / x.n + y.v / y.n), 6) AS statistic,
       round(pow(x.v / x.n + y.v / y.n, 2) / (pow(x.v / x.n, 2) / (x.n - 1) + pow(y.v / y.n, 2) / (y.n - 1)), 6) AS df,
       x.n + y.n AS n, round((x.m - y.m) / sqrt((x.p + y.p) / 2), 6) AS effect_size FROM x, y""",
)
def test_welch_t(t):
    rows = t("orders").where(F.col("o_orderstatus").isin("F", "O"))
    return _test_columns(statistical_test(rows, "t_test", ["o_orderstatus", "o_totalprice"]))


@query(
    "test_anova",
    """
WITH g AS (SELECT o_orderstatus AS g, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * v) AS w, sum(n * m) / sum(n) AS c FROM g)
SELECT round((SELECT sum(g.n * pow(g.m - s.c, 2)) FROM g, s) / (k - 1) / (w / (n - k)), 6) AS statistic,
       CAST(k - 1 AS DOUBLE) AS df, CAST(n - k AS DOUBLE) AS df2, CAST(n AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS effect_size FROM s""",
)
def test_anova(t):
    return _test_columns(statistical_test(t("orders"), "anova", ["o_orderstatus", "o_totalprice"]), "df2")


# -- drivers ----------------------------------------------------------------------------------------

_SEG = """
WITH w AS (SELECT *, CASE WHEN outcome = 'yes' THEN 1 ELSE 0 END AS pos FROM outcomes),
b AS (SELECT count(*) AS n, sum(pos) AS p, sum(pos) * 1.0 / count(*) AS base,
             greatest(CASE WHEN count(*) < 100 THEN 2 ELSE 20 END, floor(count(*) * 5 / 1000)) AS least_n FROM w),
q AS (SELECT quantile_cont(n_chars, 0.0) AS q0, quantile_cont(n_chars, 0.2) AS q1, quantile_cont(n_chars, 0.4) AS q2,
             quantile_cont(n_chars, 0.6) AS q3, quantile_cont(n_chars, 0.8) AS q4, quantile_cont(n_chars, 1.0) AS q5 FROM w),
s AS (SELECT 'toxic' AS feature, coalesce(CAST(toxic AS VARCHAR), 'Missing') AS segment, pos FROM w
      UNION ALL SELECT 'source', coalesce(source, 'Missing'), pos FROM w
      UNION ALL SELECT 'lang', coalesce(lang, 'Missing'), pos FROM w
      UNION ALL SELECT 'n_chars', CASE WHEN n_chars <= q1 THEN '(' || (q0 - 0.001) || ', ' || round(q1, 3) || ']'
          WHEN n_chars <= q2 THEN '(' || round(q1, 3) || ', ' || round(q2, 3) || ']'
          WHEN n_chars <= q3 THEN '(' || round(q2, 3) || ', ' || round(q3, 3) || ']'
          WHEN n_chars <= q4 THEN '(' || round(q3, 3) || ', ' || round(q4, 3) || ']'
          WHEN n_chars <= q5 THEN '(' || round(q4, 3) || ', ' || round(q5, 3) || ']' END, pos FROM w, q),
g AS (SELECT feature, segment, count(*) AS customers, CAST(sum(pos) AS BIGINT) AS positive_customers,
             sum(pos) * 1.0 / count(*) AS rate FROM s GROUP BY feature, segment),
t AS (SELECT feature, segment, customers, positive_customers, rate, rate / base AS exact_lift FROM g, b WHERE customers >= least_n),
r AS (SELECT feature, segment, customers, positive_customers, round(rate * 100, 1) AS positive_rate_pct,
             round(exact_lift, 2) AS lift FROM t)
"""
_OUT = ("outcomes",)


def _drivers(t):
    return DriverAnalysis(t("outcomes"), "outcome")


@query(
    "driver_baseline",
    _SEG + """SELECT 'outcome' AS target, 'yes' AS positive_label, round(base * 100, 1) AS baseline_rate_pct, n AS total_customers,
    CAST(least_n AS BIGINT) AS minimum_segment_size FROM b""",
    _OUT,
)
def driver_baseline(t):
    return _drivers(t).baseline()


@query("driver_quantile_segments", _SEG + "SELECT * FROM r WHERE feature = 'n_chars'", _OUT)
def driver_quantile_segments(t):
    return _drivers(t).segments(["n_chars"])


@query("driver_category_segments", _SEG + "SELECT * FROM r WHERE feature <> 'n_chars'", _OUT)
def driver_category_segments(t):
    return _drivers(t).segments(["toxic", "source", "lang"])


@query(
    "driver_segments",
    _SEG + "SELECT * FROM r ORDER BY lift DESC, customers DESC, feature, segment NULLS LAST LIMIT 8", _OUT,
)
def driver_segments(t):
    return _drivers(t).top_segments(8)


@query(
    "driver_field_gaps",
    _SEG + """SELECT feature, round(max(rate) * 100, 1) AS highest_rate_pct, round(min(rate) * 100, 1) AS lowest_rate_pct,
    round((max(rate) - min(rate)) * 100, 1) AS rate_gap_points FROM t GROUP BY feature ORDER BY rate_gap_points DESC, feature LIMIT 5""",
    _OUT,
)
def driver_field_gaps(t):
    return _drivers(t).strongest_fields()
