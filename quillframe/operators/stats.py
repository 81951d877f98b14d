"""Statistical tests: sufficient statistics on Spark, the tail probability as one scalar."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, measure, require_columns
from ..functions.pvalues import chi2_upper, f_upper, t_two_sided
from ..session import local_table
from .correlation import pearson_pairs, spearman_pairs

TESTS = ("pearson", "spearman", "chi_square", "t_test", "anova")
SIGNIFICANCE = 0.05


def statistical_test(df: DataFrame, test: str, columns: Sequence[str]) -> DataFrame:
    """One row: test, statistic, df, df2, n, effect_size, p_value, association."""
    if test not in TESTS:
        raise ValueError(f"unknown test: {test}")
    if len(columns) != 2:
        raise ValueError("a statistical test needs two columns")
    require_columns(df, columns)
    run = {
        "pearson": _correlation_test,
        "spearman": _correlation_test,
        "chi_square": _chi_square,
        "t_test": _welch,
        "anova": _anova,
    }[test]
    facts = run(df, test, *columns)
    p = facts["p_value"]
    return local_table(df.sparkSession, [(test, facts["statistic"], facts["df"], facts.get("df2"), facts["n"], facts.get("effect_size"), p,
          None if p is None else p < SIGNIFICANCE)],
        "test string, statistic double, df double, df2 double, n long, effect_size double, "
        "p_value double, association boolean",
    )


def _correlation_test(df: DataFrame, test: str, a: str, b: str) -> dict:
    both = df.select(measure(df, a).cast("double").alias("a"), measure(df, b).cast("double").alias("b")).where(
        "a IS NOT NULL AND b IS NOT NULL"
    )
    n = both.count()
    find = pearson_pairs if test == "pearson" else spearman_pairs
    r = find(both, [("a", "b")])[("a", "b")]
    freedom = n - 2
    t = None
    if r is not None and freedom > 0:
        t = math.inf if abs(r) >= 1 else r * math.sqrt(freedom / (1 - r * r))
    return {"statistic": r, "df": float(freedom), "n": n, "effect_size": r, "p_value": t_two_sided(t, freedom)}


def _chi_square(df: DataFrame, test: str, a: str, b: str) -> dict:
    """Cells that occur, plus the share of the cells that do not, from the two marginals.

    An empty cell adds its expected count, so chi-square needs no row x column grid: the expected
    counts of all cells sum to n.
    """
    cells = (
        df.where(col(a).isNotNull() & col(b).isNotNull())
        .groupBy(col(a).alias("a"), col(b).alias("b"))
        .agg(F.count(F.lit(1)).cast("double").alias("o"))
    )
    rows = cells.groupBy("a").agg(F.sum("o").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("cb"))
    size = cells.agg(F.sum("o").alias("n"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c")).first()
    n, r, c = size["n"] or 0.0, size["r"], size["c"]
    if r < 1 or c < 1:
        return {"statistic": None, "df": 0.0, "n": 0, "effect_size": None, "p_value": None}
    freedom = (r - 1) * (c - 1)
    expected = F.col("ra") * F.col("cb") / F.lit(n)
    joined = cells.join(rows, "a").join(cols, "b")
    if freedom == 1:
        # Four cells: all are needed, also the empty ones, for the continuity correction.
        table = {(x["a"], x["b"]): x["o"] for x in cells.collect()}
        ra = {x["a"]: x["ra"] for x in rows.collect()}
        cb = {x["b"]: x["cb"] for x in cols.collect()}
        chi = 0.0
        for i, ri in ra.items():
            for j, cj in cb.items():
                e = ri * cj / n
                gap = abs(table.get((i, j), 0.0) - e)
                chi += (gap - min(0.5, gap)) ** 2 / e
    elif freedom == 0:
        chi = 0.0
    else:
        chi = joined.agg(
            (F.sum((F.col("o") - expected) ** 2 / expected - expected) + F.lit(n)).alias("chi")
        ).first()["chi"]
    effect = math.sqrt(max(chi, 0.0) / (n * max(1, min(r, c) - 1)))
    return {"statistic": chi, "df": float(freedom), "n": int(n), "effect_size": effect,
            "p_value": chi2_upper(chi, freedom)}


def _group_moments(df: DataFrame, group: str, value: str, limit: int) -> list:
    return (
        df.where(col(group).isNotNull())
        .groupBy(col(group).alias("g"))
        .agg(
            F.count(measure(df, value)).alias("n"),
            F.avg(measure(df, value).cast("double")).alias("mean"),
            F.var_samp(measure(df, value).cast("double")).alias("var_samp"),
            F.var_pop(measure(df, value).cast("double")).alias("var_pop"),
        )
        .orderBy("g")
        .limit(limit)
        .collect()
    )


def _welch(df: DataFrame, test: str, group: str, value: str) -> dict:
    groups = _group_moments(df, group, value, 3)
    if len(groups) != 2:
        raise ValueError("Welch's test compares two groups")
    x, y = groups
    statistic = freedom = effect = None
    n = x["n"] + y["n"]
    if x["n"] > 1 and y["n"] > 1:
        vx, vy = x["var_samp"] / x["n"], y["var_samp"] / y["n"]
        gap = x["mean"] - y["mean"]
        if vx + vy > 0:
            statistic = gap / math.sqrt(vx + vy)
            freedom = (vx + vy) ** 2 / (vx**2 / (x["n"] - 1) + vy**2 / (y["n"] - 1))
        pooled = math.sqrt((x["var_pop"] + y["var_pop"]) / 2)
        effect = gap / pooled if pooled else None
    return {"statistic": statistic, "df": freedom, "n": n, "effect_size": effect,
            "p_value": t_two_sided(statistic, freedom)}


def _anova(df: DataFrame, test: str, group: str, value: str) -> dict:
    """Between- and within-group sums of squares, aggregated over the group table on Spark."""
    number = measure(df, value).cast("double")
    groups = df.where(col(group).isNotNull()).groupBy(col(group)).agg(
        F.count(number).cast("double").alias("n"), F.avg(number).alias("mean"), F.var_pop(number).alias("var")
    )
    row = groups.where("n > 0").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
        # weighted sum of squares of the group means around their weighted mean
        F.sum(F.col("n") * F.col("mean")).alias("total"),
    ).first()
    k, n = row["k"], row["n"] or 0.0
    if k < 2 or n <= k:
        return {"statistic": None, "df": None, "n": int(n), "p_value": None}
    centre = row["total"] / n
    between = groups.where("n > 0").agg(
        F.sum(F.col("n") * (F.col("mean") - F.lit(centre)) ** 2).alias("between")
    ).first()["between"]
    within = row["within"]
    statistic = (between / (k - 1)) / (within / (n - k)) if within else None
    return {"statistic": statistic, "df": float(k - 1), "df2": float(n - k), "n": int(n),
            "p_value": f_upper(statistic, k - 1, n - k)}
