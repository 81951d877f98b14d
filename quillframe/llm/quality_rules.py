"""Quality rules: text statistics, and a decision list learned from labelled statistics; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed

SPACES = " \t\n\x0b\f\r"
#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
WINDOW = 8

FEATURES = (
    "n_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "distinct_share",
)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ... , base_failed) for every row of ``docs(doc_id, text)``.

    Words are runs of characters other than space and \\x09-\\x0D.  ``n_dup_lines`` counts lines (split at \\n) with a word that equal
    an earlier one; ``n_repeat_words`` the words in 8-word windows found twice or more in the text.  Null and empty
    texts have zeros everywhere and fail the base rules; repeated rows give repeated results.  Every statistic is computed within its
    row, so nothing is shuffled and only the memory for one text is needed.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    step = base.select(
        "doc_id", text_key(F.col("text")).alias("text_key"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        (F.length("text") - F.length(F.translate("text", "!?", ""))).cast("long").alias("n_marks"),
        lines.alias("lines"),
        F.transform(
            F.when(F.btrim("text", F.lit(SPACES)) == "", F.array().cast("array<string>")).otherwise(
                F.split(F.btrim("text", F.lit(SPACES)), r"[\x20\x09-\x0D]+", -1)
            ),
            lambda w: F.xxhash64(w),
        ).alias("words"),
    )
    step = step.select(
        "doc_id", "text_key", "word_chars", "n_symbols", "n_upper", "n_marks",
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
            ),
        ).alias("windows"),
    )
    numbered = F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    step = step.withColumn("sorted", F.when(F.size("windows") > F.size(F.array_distinct("windows")), F.sort_array(numbered)))
    at = F.sequence(F.lit(0), F.size("sorted") - 1)
    twice = F.filter(
        at,
        lambda k: F.coalesce(F.get("sorted", k)["h"] == F.get("sorted", k - 1)["h"], F.lit(False))
        | F.coalesce(F.get("sorted", k)["h"] == F.get("sorted", k + 1)["h"], F.lit(False)),
    )
    step = step.drop("windows").withColumn(
        "starts", F.when(F.col("sorted").isNotNull(), F.sort_array(F.transform(twice, lambda k: F.get("sorted", k)["i"])))
    ).drop("sorted")
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("starts") - 1), F.lit(0),
        lambda total, k: total + F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - F.get("starts", k), F.lit(WINDOW))),
    )
    step = step.withColumn("n_repeat_words", F.when(F.col("starts").isNotNull(), covered).otherwise(0).cast("long")).drop("starts")

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return step.select(
        "doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word_chars"), share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_upper", "word_chars").alias("upper_share"), share("n_marks", "word_chars").alias("mark_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
        ((F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)).alias("base_failed"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.value if self.at_least else F.col(self.feature) < self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.value:g}"


@dataclass(frozen=True)
class DecisionList:
    """Conjunctions in order; the first that holds rejects, and a row that none rejects is kept."""

    rules: tuple[tuple[Condition, ...], ...] = field(default=())

    def kept(self) -> Column:
        """An ordered Spark conditional expression over the statistics."""
        out = None
        for rule in self.rules:
            out = (F if out is None else out).when(conjunction(rule), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def which(self) -> Column:
        """Number of the rejecting rule, null if kept."""
        out = F.lit(None).cast("int")
        for k, rule in reversed(list(enumerate(self.rules))):
            out = F.when(conjunction(rule), F.lit(k)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, rule))}" for rule in self.rules) + "\nkeep"


def conjunction(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def _grow(rows: DataFrame, cuts: dict[str, list[float]], most: int, precision: float) -> tuple[Condition, ...]:
    """Add the condition of greatest information gain until the rule is precise enough.

    Each step is one aggregate to a count of both classes for every (feature, bin).
    """
    rule: tuple[Condition, ...] = ()
    while len(rule) < most:
        binned = F.explode(F.array(*[
            F.struct(
                F.lit(name).alias("feature"),
                sum(((F.col(name) >= v).cast("int") for v in values), F.lit(0)).alias("bin"),
            ) for name, values in cuts.items()
        ])).alias("b")
        counts = rows.where(conjunction(rule)).select("bad", binned).groupBy("b.feature", "b.bin").agg(
            F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")
        ).collect()
        table = {name: [(0, 0)] * (len(values) + 1) for name, values in cuts.items()}
        for row in counts:
            table[row["feature"]][row["bin"]] = (row["p"], row["n"])
        p_all, n_all = (sum(x[k] for x in next(iter(table.values()))) for k in (0, 1))
        if not p_all or p_all >= precision * (p_all + n_all):
            break
        best = None
        for name, values in cuts.items():
            p = n = 0
            for value, (dp, dn) in zip(values, table[name]):
                p, n = p + dp, n + dn
                for at_least, pp, nn in ((False, p, n), (True, p_all - p, n_all - n)):
                    gain = foil_gain(pp, nn, p_all, n_all)
                    if best is None or gain > best[0]:
                        best = gain, Condition(name, at_least, value)
        if best is None or best[0] <= 0:
            break
        rule += (best[1],)
    return rule


def foil_gain(p: int, n: int, p_before: int, n_before: int) -> float:
    from math import log2

    return p * (log2(p / (p + n)) - log2(p_before / (p_before + n_before))) if p else 0.0


def _prune(rows: DataFrame, rule: tuple[Condition, ...]) -> tuple[tuple[Condition, ...], int, int]:
    """The shortest prefix of the rule that does best on rows held back from growing, and its hits and misses there."""
    parts = []
    for k in range(1, len(rule) + 1):
        holds = conjunction(rule[:k]).cast("int")
        parts += [F.sum(holds * F.col("bad")).alias(f"p{k}"), F.sum(holds * (1 - F.col("bad"))).alias(f"n{k}")]
    got = rows.agg(*parts).first()
    scores = []
    for k in range(1, len(rule) + 1):
        p, n = got[f"p{k}"] or 0, got[f"n{k}"] or 0
        scores.append(((p - n) / (p + n) if p + n else -1.0, -k, p, n))
    _, k, p, n = max(scores)
    return rule[:-k], p, n


def learn_rules(
    labelled: DataFrame, features: tuple[str, ...] = FEATURES, label: str = "quality", key: str = "doc_id",
    most_rules: int = 10, most_conditions: int = 3, n_cuts: int = 31, precision: float = 0.98, accept: float = 0.9, least_hits: int = 5,
) -> DecisionList:
    """Sequential covering over ``labelled``: rules for ``label`` = 0, best first, each learned on what the earlier ones leave.

    Rows with a null label are left out; with no rows of a class nothing is rejected.  Two thirds of the rows (by a hash of ``key``) grow a
    rule, the others prune it; a rule is taken if at least ``accept`` of its pruning hits are right and there are at least
    ``least_hits``.  Thresholds are ``n_cuts`` quantiles of each statistic.  All labelled rows are used; only
    (feature, bin) counts reach the driver.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(
        *features, (F.col(label) == 0).cast("int").alias("bad"), (F.pmod(F.xxhash64(key), F.lit(3)) == 0).alias("held_back")
    )
    rows = checkpointed(rows)
    quantiles = rows.agg(*[
        F.percentile_approx(f, [(k + 1) / (n_cuts + 1) for k in range(n_cuts)], 10_000).alias(f) for f in features
    ]).first()
    bad = rows.where("bad = 1").agg(*[
        F.percentile_approx(f, [(k + 1) / (n_cuts + 1) for k in range(n_cuts)], 10_000).alias(f) for f in features
    ]).first()
    cuts = {f: sorted({*(quantiles[f] or []), *(bad[f] or [])}) for f in features}
    rules: list[tuple[Condition, ...]] = []
    left = rows
    while len(rules) < most_rules:
        rule = _grow(left.where(~F.col("held_back")), cuts, most_conditions, precision)
        if not rule:
            break
        rule, p, n = _prune(left.where("held_back"), rule)
        if p < least_hits or p < accept * (p + n):
            break
        rules.append(rule)
        left = rows.where(~conjunction_of_any(rules))
    return DecisionList(tuple(rules))


def conjunction_of_any(rules: list[tuple[Condition, ...]]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | conjunction(rule)
    return out


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every row of ``docs`` with ``base_failed``, ``rule`` (number of the rejecting learned rule) and ``kept``.

    ``labels(doc_id, quality)``: 1 good, 0 bad; a document labelled more than once counts as good if any label says so; labels
    without a document, and nulls, are left out.  A document is kept if it passes the base rules and the learned list.
    """
    stats = checkpointed(text_statistics(docs))
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("_doc")
    ).agg(F.max("quality").alias("quality"))
    labelled = stats.join(marks, F.col("doc_id") == F.col("_doc")).where(~F.col("base_failed"))
    found = learn_rules(labelled)
    return stats.withColumn("rule", found.which()).withColumn("kept", ~F.col("base_failed") & found.kept())
