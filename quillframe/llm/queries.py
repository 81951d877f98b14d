"""One query for each operator, over its whole table, and the SQL each must agree with where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import oracles
from .decontamination import find_passages
from .divergence_audit import divergence_audit
from .exact_dedup import exact_dedup
from .html_text import extract_pages, learn_pages
from .language_id import identify_languages, learn_languages
from .license_scan import scan_licenses
from .near_dup import near_duplicates
from .packing import pack
from .quality_rules import quality_verdicts
from .secret_scan import BASE_RULES, RULES, scan_versions
from .substring_dedup import substring_dedup
from .token_alignment import align_tokens
from .toxicity import learn_toxicity, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return add


@query("op2_substring_dedup", oracles.SUBSTRING_DEDUP)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@query("op4_minhash_near_dup", oracles.NEAR_DUP)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), shingle=2)


@query("op6_harmonic_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


@query("op9_secret_ledger", oracles.secret_scan(RULES))
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_versions(table(spark, folder, "documents")).paths

    def listed(items):
        text = F.transform(items, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string")))
        return F.concat_ws(",", text)

    base = F.filter("findings", lambda f: f["kind"].isin(*[r.kind for r in BASE_RULES]))

    def of_kind(kind):
        return F.filter("findings", lambda f: f["kind"] == kind)

    counts = [F.size(of_kind(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


@query("op10_quality_rules")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_verdicts(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def hashed(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query("op3_language_ecoc")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = learn_languages(docs.where(hashed(4) != 2))
    found = identify_languages(docs, model)
    return found.select("doc_id", (hashed(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op8_toxicity_neighbours")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = learn_toxicity(table(spark, folder, "labels").where(hashed(5) != 0), docs)
    found = score_toxicity(docs, model)
    return found.select("doc_id", (hashed(5) == 0).alias("held_out"), "score", "predicted", "evidence")


@query("op5_html_main_text")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return extract_pages(pages, learn_pages(pages))


@query("op1_license_scan")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"))


@query("op7_benchmark_decontamination")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op11_divergence_audit", oracles.DIVERGENCE_AUDIT)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return divergence_audit(table(spark, folder, "documents"))


@query("op12_exact_dedup", oracles.EXACT_DEDUP)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


@query("op13_token_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    names = ("byte_bpe_50k.json", "piece_bpe_32k.model")
    return align_tokens(table(spark, folder, "documents"), *map(public_tokenizers.path, names))
