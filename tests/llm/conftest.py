"""Awkward documents that every operator on whole texts has to live with."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillframe.session import local_table

SYLLABLES = "the ba ko ri mu sen tal vor épi ñu".split()
#: Names that operators use for columns of their own.
CLASH = "unit row owner digest body suspect hot salt n best pairs times part bucket pair count most group source_no term slots".split()


def some_words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd_rows() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empty, repeated and long texts, ties, unusual white space and characters."""
    rng = random.Random(11)
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, " \t\n", None, "b"), (4, "one", "en", "a"), (5, "o n e\n", "en", "a"),
            (6, "One", "fr", "b"), (None, "no id", "en", "a"), (None, "noid", "en", "a"), (7, "noid", "en", "b")]
    base = " ".join(some_words(rng, 60))
    rows += [(20 + k, base + " " * (k % 3), "en" if k % 2 else "fr", "abc"[k % 3]) for k in range(12)]
    rows += [(40 + k, " ".join(some_words(rng, 40)), "en", "abc"[k % 3]) for k in range(30)]
    rows += [(80 + k, " ".join(some_words(rng, 25)), "fr", "ab"[k % 2]) for k in range(20)]
    rows += [(110, "x " * 3000, "en", "c"), (111, " ".join(some_words(rng, 6000)), "en", "c"), (112, "dup row", "en", "a"), (112, "dup row", "en", "a")]
    rows += [(120, "日本 \U0001F9FF\U0001F600x", "ja", "a"), (121, "a▁b", "ja", "a"), (122, "tab\tb \tc\r\nx \r y  z　\nq", "ja", "b"),
             (123, "<|endoftext|> <s> </s>", "xx", ""), (124, "\x00 nul \x1c y", "xx", ""), (125, "🧿" * 50, "xx", ""), (126, "  two  \n\n", "xx", "")]
    return rows


@pytest.fixture(scope="module")
def odd_docs(spark, odd_rows):
    table = local_table(spark, odd_rows, "doc_id long, text string, lang string, source string")
    return table.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)]).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return local_table(spark, [], "doc_id long, text string, lang string, source string")
