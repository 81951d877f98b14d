"""Dataset profile, quality issues and overview.

Everything is built from a few scans: one aggregate with a few expressions per column, one table of (column, digest)
frequencies for distinct counts and top values, and the quantile selection.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import (
    col,
    is_nested,
    measure,
    numeric_columns,
    require_columns,
    total,
)
from ..functions.roles import leakage_columns
from ..session import local_table
from .correlation import pearson_pairs
from .frequencies import Frequencies, as_text, plain_columns, present, value_counts
from .ranks import exact_quantiles
from .rows import duplicate_rows

COLUMNS_PER_AGGREGATE = 40
TOP_VALUES = 8
SEVERITY_ORDER = {"high": 0, "medium": 1, "low": 2}


def adjusted_skew(value: Column) -> Column:
    """Aggregate: bias-corrected skewness; null below three values, 0 for a constant."""
    n = F.count(value).cast("double")
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    skew = F.when(F.min(value) == F.max(value), F.lit(0.0)).otherwise(F.skewness(value))
    return F.when(n >= 3, skew * factor)


class Profile:
    """Profile of one DataFrame; every part is computed once, when first asked for."""

    def __init__(
        self,
        df: DataFrame,
        targets: Sequence[str] = (),
        descriptions: dict[str, str] | None = None,
        approx: bool = False,
    ):
        self.df = df
        self.spark = df.sparkSession
        self.targets = [t for t in targets if t in df.columns]
        self.descriptions = descriptions or {}
        self.approx = approx
        self.columns = list(df.columns)
        self.numeric = numeric_columns(df)

    # -- one aggregate over all columns -------------------------------------------------------
    @cached_property
    def _basic(self) -> tuple[int, dict[str, dict]]:
        rows, stats = 0, {c: {} for c in self.columns}
        for start in range(0, len(self.columns), COLUMNS_PER_AGGREGATE):
            chunk = self.columns[start : start + COLUMNS_PER_AGGREGATE]
            wanted = {("", "rows"): F.count(F.lit(1))}
            for c in chunk:
                wanted[(c, "present")] = F.count(present(self.df, c))
                if c in self.numeric:
                    value = measure(self.df, c)
                    double = value.cast("double")
                    wanted[(c, "min")] = F.min(double)
                    wanted[(c, "max")] = F.max(double)
                    wanted[(c, "sum")] = total(value)
                    wanted[(c, "std")] = F.stddev_samp(double)
                    wanted[(c, "skew")] = adjusted_skew(double)
            row = self.df.agg(*[e.alias(f"e{i}") for i, e in enumerate(wanted.values())]).first()
            for i, (c, name) in enumerate(wanted):
                if name == "rows":
                    rows = row[i]
                else:
                    stats[c][name] = row[i]
        return rows, stats

    @property
    def rows(self) -> int:
        return self._basic[0]

    def missing(self, name: str) -> int:
        return self.rows - self._basic[1][name]["present"]

    @cached_property
    def duplicates(self) -> int:
        return duplicate_rows(self.df).first()["duplicate_rows"]

    @cached_property
    def _quantiles(self) -> dict[str, dict[float, float | None]]:
        if not self.numeric:
            return {}
        values = {c: measure(self.df, c) for c in self.numeric}
        return exact_quantiles(self.df, values, [0.25, 0.5, 0.75], self.approx)

    @cached_property
    def _unique(self) -> dict[str, int]:
        """Distinct non-null values per column, from the value frequencies."""
        if self.approx:
            plain = plain_columns(self.df)
            row = self.df.agg(*[
                F.hll_sketch_estimate(F.hll_sketch_agg(as_text(self.df, c))).alias(f"u{i}") for i, c in enumerate(plain)
            ]).first()
            return {c: row[f"u{i}"] for i, c in enumerate(plain)}
        return self._frequencies.distinct()

    @cached_property
    def _frequencies(self) -> Frequencies:
        return Frequencies(self.df)

    # -- result tables --------------------------------------------------------------------------
    def shape(self) -> DataFrame:
        cells = sum(self.missing(c) for c in self.columns)
        share = cells * 100.0 / (self.rows * len(self.columns)) if self.rows and self.columns else 0.0
        return local_table(self.spark, [(self.rows, len(self.columns), cells, round(share, 2))],
            "rows long, columns int, missing_cells long, missing_pct double",
        )

    def _column_facts(self) -> list[dict]:
        n = max(self.rows, 1)
        facts = []
        for c in self.columns:
            unique = self._unique.get(c)
            missing = self.missing(c)
            fact = {
                "column_name": c,
                "missing": missing,
                "missing_pct": round(missing * 100.0 / n, 2),
                "unique": unique,
                "constant": None if unique is None else unique <= 1,
                "high_cardinality": None if unique is None else unique > 50 and unique / n > 0.3,
                "potential_id": None
                if unique is None
                else unique == self.rows and ("id" in c.lower() or unique > 100),
            }
            facts.append(fact)
        return facts

    def column_table(self) -> DataFrame:
        """Missing and distinct values per column."""
        return local_table(self.spark, [(f["column_name"], f["missing"], f["missing_pct"], f["unique"]) for f in self._column_facts()],
            "column_name string, missing long, missing_pct double, unique long",
        )

    def flags(self) -> DataFrame:
        names = ("column_name", "constant", "high_cardinality", "potential_id")
        return local_table(self.spark, [tuple(f[k] for k in names) for f in self._column_facts()],
            "column_name string, constant boolean, high_cardinality boolean, potential_id boolean",
        )

    def missing_report(self) -> DataFrame:
        return self.column_table().where("missing > 0")

    def top_values(self, k: int = TOP_VALUES) -> DataFrame:
        """The ``k`` most frequent values of each column; ties in text order, null last."""
        return self._frequencies.top(k)

    def numeric_facts(self) -> dict[str, dict[str, float | None]]:
        facts = {}
        for c in self.numeric:
            basic, q = self._basic[1][c], self._quantiles[c]
            n = basic["present"]
            facts[c] = {
                "minimum": basic["min"],
                "maximum": basic["max"],
                "mean": basic["sum"] / n if n else None,
                "median": q[0.5],
                "std": basic["std"],
                "q25": q[0.25],
                "q75": q[0.75],
                "skew": basic["skew"],
            }
        return facts

    def numeric_table(self) -> DataFrame:
        names = ("minimum", "maximum", "mean", "median", "std", "q25", "q75", "skew")
        return local_table(self.spark, [(c, *[facts[k] for k in names]) for c, facts in self.numeric_facts().items()],
            "column_name string, " + ", ".join(f"{k} double" for k in names),
        )

    def outliers(self) -> DataFrame:
        """Values strictly outside the quartiles by more than 1.5 interquartile ranges."""
        bounds = {c: iqr_bounds(q[0.25], q[0.75]) for c, q in self._quantiles.items()}
        return outlier_counts(self.df, bounds)

    @cached_property
    def leakage_facts(self) -> list[tuple[str, str | None, str, float | None]]:
        first = self.targets[0] if self.targets else None
        found = [
            (c, first, self.descriptions[c], None) for c in leakage_columns(self.columns, self.descriptions)
        ]
        pairs = [(c, t) for t in self.targets if t in self.numeric for c in self.numeric if c != t]
        used = dict.fromkeys(c for pair in pairs for c in pair)
        doubles = self.df.select(*[measure(self.df, c).cast("double").alias(c) for c in used])
        for (c, t), r in pearson_pairs(doubles, pairs).items():
            if r is not None and abs(r) > 0.98:
                found.append((c, t, "near-perfect correlation", round(r, 4)))
        return found

    def leakage(self) -> DataFrame:
        return local_table(self.spark, self.leakage_facts, "column_name string, target string, reason string, score double"
        )

    def issue_facts(self) -> list[tuple[str, str, str | None, float | None]]:
        """(severity, type, column, value) per finding, in the order the checks run."""
        issues = []
        if self.duplicates:
            issues.append(("medium", "duplicates", None, float(self.duplicates)))
        numeric = self.numeric_facts()
        for f in self._column_facts():
            c = f["column_name"]
            if f["missing_pct"]:
                severity = "high" if f["missing_pct"] > 30 else "medium"
                issues.append((severity, "missing", c, f["missing_pct"]))
            if f["constant"]:
                issues.append(("medium", "constant", c, None))
            if f["high_cardinality"]:
                issues.append(("low", "cardinality", c, float(f["unique"])))
            skew = numeric.get(c, {}).get("skew")
            if skew is not None and abs(skew) > 2:
                issues.append(("low", "skew", c, skew))
        issues += [("high", "leakage", c, score) for c, _, _, score in self.leakage_facts]
        return issues

    def quality_issues(self) -> DataFrame:
        return local_table(self.spark, self.issue_facts(), "severity string, type string, column_name string, value double"
        )


def iqr_bounds(q25: float | None, q75: float | None) -> tuple[float, float] | None:
    if q25 is None or q75 is None:
        return None
    spread = 1.5 * (q75 - q25)
    return q25 - spread, q75 + spread


def outlier_counts(df: DataFrame, bounds: dict[str, tuple[float, float] | None]) -> DataFrame:
    known = {c: b for c, b in bounds.items() if b is not None}
    counts = {c: 0 for c in bounds}
    if known:
        exprs = []
        for i, (c, (low, high)) in enumerate(known.items()):
            value = measure(df, c).cast("double")
            exprs.append(F.count_if((value < F.lit(low)) | (value > F.lit(high))).alias(f"o{i}"))
        row = df.agg(*exprs).first()
        counts.update({c: row[f"o{i}"] for i, c in enumerate(known)})
    return local_table(df.sparkSession, list(counts.items()), "column_name string, outliers long")


# -- overview -----------------------------------------------------------------------------------
def target_overview(df: DataFrame, target: str, regression: bool = False) -> DataFrame | None:
    """Share of each outcome when there are at most 12, else the target's summary numbers.

    None when a text target has more than 12 values.
    """
    require_columns(df, [target])
    counts = value_counts(df, [target])
    distinct = counts.where("value IS NOT NULL").limit(13).count()
    numeric = target in numeric_columns(df)
    if numeric and (regression or distinct > 12):
        return numeric_highlights(df, [target])
    if distinct > 12:
        return None
    rows = df.count()
    return counts.select(
        "value",
        col("n").alias("count"),
        F.round(col("n") * F.lit(100.0) / F.lit(max(rows, 1)), 1).alias("percentage"),
    )


def numeric_highlights(df: DataFrame, columns: Sequence[str] | None = None, limit: int = 6) -> DataFrame:
    """Mean and median (2 digits), minimum and maximum of the first few numeric columns."""
    names = (list(columns) if columns is not None else numeric_columns(df))[:limit]
    profile = Profile(df.select(*[col(c) for c in names]))
    rows = [
        (c, round(f["mean"], 2), round(f["median"], 2), f["minimum"], f["maximum"])
        for c, f in profile.numeric_facts().items()
        if f["mean"] is not None
    ]
    return local_table(df.sparkSession, rows, "column_name string, mean double, median double, minimum double, maximum double"
    )


def categorical_highlights(df: DataFrame, target: str | None = None, limit: int = 6, k: int = 3) -> DataFrame:
    """The most common values of the first few non-numeric columns."""
    numeric = set(numeric_columns(df))
    names = [f.name for f in df.schema.fields if f.name not in numeric and f.name != target and not is_nested(f)]
    if not names:
        return local_table(df.sparkSession, [], "column_name string, position int, value string, count long"
        )
    return Frequencies(df, names[:limit]).top(k)


def dataset_overview(
    df: DataFrame,
    targets: Sequence[str] = (),
    descriptions: dict[str, str] | None = None,
    regression: bool = False,
) -> dict[str, DataFrame | None]:
    """The tables a first look at a dataset needs."""
    profile = Profile(df, targets, descriptions)
    target = profile.targets[0] if profile.targets else None
    return {
        "shape": profile.shape(),
        "duplicates": duplicate_rows(df),
        "target": target_overview(df, target, regression) if target else None,
        "numeric": numeric_highlights(df),
        "categorical": categorical_highlights(df, target),
        "leakage": profile.leakage(),
    }
