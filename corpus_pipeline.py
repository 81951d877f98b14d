"""From raw documents to packed training sequences: five stages, each on all rows that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillframe.llm.decontamination import without_passages
from quillframe.llm.near_dup import near_duplicates
from quillframe.llm.packing import pack
from quillframe.llm.quality_rules import quality_verdicts, text_key
from quillframe.llm.secret_scan import blob_id, redacted, scan_versions
from quillframe.session import scratch_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the decision list learned from ``labels``; equal rows have one verdict."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    rejected = quality_verdicts(docs, labels).where(~F.col("kept")).select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")
    ).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (text_key(F.col("text")) == F.col("_key"))
    return docs.join(rejected, same, "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least doc_id, once; rows without a doc_id stay."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_doc")).distinct()
    first = docs.join(kept, F.col("doc_id").cast("long") == F.col("_doc"), "left_semi").dropDuplicates(["doc_id"])
    return first.unionByName(docs.where(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a ``benchmark`` item."""
    return without_passages(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets found in their texts replaced by a mark and ``n_chars`` counted anew."""
    found = scan_versions(docs).paths.where(F.size("findings") > 0).select(
        F.col("blob").alias("_blob"), F.col("findings").alias("_findings")
    ).dropDuplicates(["_blob"])
    text = F.when(F.col("_findings").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("_findings")))
    joined = docs.join(found, blob_id(F.col("text")) == F.col("_blob"), "left").withColumn("_clean", text)
    columns = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        fresh = F.length("_clean").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("_findings").isNull(), F.col("n_chars")).otherwise(fresh)
    return joined.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids of the public word tokenizer."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret scan", secrets),
    ("packing", packing),
]

#: Learning, edit distance and tokenizing have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces made from ``documents``; what a stage returns is written and read again before the next."""
    folder = scratch_folder(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
