"""Secret scans over an incremental ledger of content-addressed text versions; DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Column, Window as W, functions as F

from ..session import checkpointed


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  A match of ``pattern`` counts if ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def greedy(self) -> str:
        """The pattern for engines without possessive repetition, which here only says how to search, not what is found."""
        return re.sub(r"(?<=[*+}])\+", "", self.pattern)


#: Kinds in the order in which equal starts are listed.  The hex pattern asks for its least length at once: its matches are
#: whole runs either way, and runs of a few letters are in every sentence.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
#: A private key from its BEGIN line to its END line (no other line of five dashes between); without one, over header fields and base64 lines,
#: where line breaks may be written as \\n.  Repeated groups are possessive: Java repeats those in a loop, others by recursion, once for each line.
PEM = (
    r"-----BEGIN (?:[A-Z0-9\x20]*\x20)?PRIVATE KEY(?: BLOCK)?-----"
    r"(?:[^-]*+(?:-{1,4}[^-]++)*+-----END (?:[A-Z0-9\x20]*\x20)?PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:(?:[\x20\t\r\n]|\\[nr])*+(?:(?:Proc-Type|DEK-Info|Version|Comment): [^\r\n]*+|[A-Za-z0-9+/]{16,}+={0,2}))*+"
    r"(?:(?:[\r\n]|\\[nr])++[A-Za-z0-9+/]{1,15}(?:={1,2}|[\r\n]|\z))?)"
)
RULES = BASE_RULES + (
    Rule("pem", 3, PEM, 0, 1),
)

LEDGER = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Scan:
    """``paths``: (doc_id, blob, findings) for every row; ``ledger``: the pairs scanned by this run, also those without findings."""

    paths: DataFrame
    ledger: DataFrame


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> Scan:
    """Find secrets in every version of every path; ``versions(doc_id, text)`` has one row for each version.

    A version is addressed by the SHA-256 of its text (null counts as empty).  ``ledger`` holds the (blob, kind, version) pairs
    scanned before, with their spans (see ``LEDGER``).  Each distinct blob is scanned once, and only with the rules it has not seen
    in their present version; findings, old and new, are then joined back to all rows.  Matches are leftmost and
    non-overlapping for each kind; starts and ends are in code points, end exclusive.  Findings of a row are ordered by
    start, then by the rules' order.

    Repeated rows give repeated results, a null doc_id stays null, equal texts share one scan; texts without
    findings, and empty tables, give empty lists and results; other columns are ignored.  No whole text is a join key;
    the texts to be scanned are shuffled once, by their blob.
    """
    spark = versions.sparkSession
    rows = versions.select(
        F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("blob", blob_id(F.col("text")))
    chosen = rows.groupBy("blob").agg(F.min("doc_id").alias("_at"))
    names = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    if ledger is None:
        ledger = spark.sql("SELECT 1 AS x WHERE false").select(
            F.lit("").alias("blob"), F.lit("").alias("kind"), F.lit(0).alias("version"),
            F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
        )
        chosen = chosen.withColumn("todo", names)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("seen"))
        chosen = chosen.join(seen, "blob", "left").withColumn(
            "todo", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
        )
    chosen = chosen.where(F.size("todo") > 0).select(F.col("blob").alias("_blob"), "_at", "todo")
    unseen = rows.join(chosen, (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("_at")))

    def matches(rule: Rule) -> Column:
        pattern = F.lit(rule.pattern)
        found = F.struct(
            F.lit(rule.kind).alias("kind"),
            F.arrays_zip(
                F.split("text", rule.pattern, -1).alias("gap"),
                F.regexp_extract_all("text", pattern, F.lit(0)).alias("hit"),
                F.regexp_extract_all("text", pattern, F.lit(rule.group)).alias("value"),
            ).alias("parts"),
        )
        due = F.array_contains("todo", f"{rule.kind}@{rule.version}")
        return F.when(due & F.col("text").rlike(rule.pattern), found)

    kinds = unseen.select("blob", "todo", F.array_compact(F.array(*[matches(r) for r in rules])).alias("found"))
    each = kinds.select("blob", "todo", F.explode_outer("found").alias("f")).select(
        "blob", "todo", F.col("f.kind").alias("kind"), F.posexplode_outer("f.parts").alias("i", "part")
    )
    before = W.partitionBy("blob", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    width = F.length("part.gap") + F.length(F.coalesce("part.hit", F.lit("")))
    # A blob whose least doc_id is repeated comes more than once; equal rows are one.
    placed = each.dropDuplicates(["blob", "kind", "i"]).withColumn(
        "start", (F.coalesce(F.sum(width).over(before), F.lit(0)) + F.length("part.gap")).cast("int")
    )
    least = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.least)]), F.col("kind"))
    spans = placed.withColumn(
        "span",
        F.when(
            F.col("kind").isNotNull() & F.col("part.hit").isNotNull() & (F.length("part.value") >= least),
            F.struct("kind", "start", (F.col("start") + F.length("part.hit")).cast("int").alias("end")),
        ),
    )
    scanned = checkpointed(
        spans.groupBy("blob").agg(F.first("todo").alias("todo"), F.collect_list("span").alias("spans"))
    )
    order = F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)]), F.col("kind"))
    old = ledger.where(F.size("spans") > 0).join(
        spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int"), ["kind", "version"], "left_semi"
    ).select("blob", "kind", F.explode("spans").alias("s")).select("blob", "kind", "s.start", "s.end")
    new = scanned.where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s")).select("blob", "s.kind", "s.start", "s.end")
    entry = F.struct("start", order.alias("place"), "kind", "end")
    findings = new.unionByName(old).groupBy(F.col("blob").alias("_blob")).agg(F.sort_array(F.collect_list(entry)).alias("findings"))
    empty = F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")
    paths = rows.select("doc_id", "blob").join(findings, F.col("blob") == F.col("_blob"), "left").select(
        "doc_id", "blob",
        F.transform(
            F.coalesce("findings", empty), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"))
        ).alias("findings"),
    )
    pair = F.split(F.col("pair"), "@")
    fresh = scanned.select("blob", "spans", F.explode("todo").alias("pair")).select(
        "blob", pair[0].alias("kind"), pair[1].cast("int").alias("version"), "spans"
    ).select(
        "blob", "kind", "version",
        F.transform(
            F.filter("spans", lambda s: s["kind"] == F.col("kind")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
        ).alias("spans"),
    )
    return Scan(paths, fresh)


def redacted(text: Column, findings: Column, mark: str = "[secret]") -> Column:
    """``text`` with the union of its findings' spans replaced by ``mark``; adjoining spans give one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    ordered = F.sort_array(F.transform(findings, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"))))

    def step(state: Column, f: Column) -> Column:
        between = F.substring(text, state["at"] + 1, f["start"] - state["at"])
        return F.when(
            f["start"] < state["at"],
            F.struct(F.greatest(state["at"], f["end"]).alias("at"), state["out"].alias("out")),
        ).otherwise(F.struct(f["end"].alias("at"), F.concat(state["out"], between, F.lit(mark)).alias("out")))

    return F.when(F.size(findings) == 0, text).otherwise(
        F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text) - s["at"])))
    )
