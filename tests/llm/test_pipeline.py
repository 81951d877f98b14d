"""The pipeline on the smallest tables: what each stage keeps, against brute force."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out.append(docs.toPandas())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.toPandas())
    return out


def test_stages_keep_the_columns(kept):
    assert all(list(frame.columns) == list(kept[0].columns) for frame in kept[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "secret scan", "packing"]


def test_one_of_each_group_of_near_copies_stays(kept):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    before = [(d, shingles(t)) for d, t in zip(kept[1]["doc_id"], kept[1]["text"])]
    stays = set(kept[2]["doc_id"])
    alike = {d: {e for e, t in before if 100 * len(s & t) >= 80 * len(s | t)} for d, s in before}
    for d, group in alike.items():
        assert (d in stays) or min(group) < d
        assert len(group) > 1 or d in stays


def test_no_secret_is_left_and_clean_documents_stay(kept):
    assert set(kept[3]["doc_id"]) == set(kept[4]["doc_id"])
    before = dict(zip(kept[3]["doc_id"], kept[3]["text"]))
    for doc_id, text, n in zip(kept[4]["doc_id"], kept[4]["text"], kept[4]["n_chars"]):
        assert not re.search(r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", text)
        assert text == before[doc_id] or ("[secret]" in text and n == len(text))


def test_run_packs_what_is_kept(spark, kept):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.select("doc_id").distinct().count() == len(kept[4]) == kept[5]["doc_id"].nunique()
    assert got.agg(F.sum("length")).first()[0] == kept[5]["length"].sum()
