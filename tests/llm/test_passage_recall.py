"""Recall of benchmark passages at the edit limit, at every length of items."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pyarrow as pa
import pytest

from quillframe.llm.decontamination import Items, _search, edit_limit, repeats_needed

LENGTHS = [*range(5, 71), 100, 200, 350]
TRIALS = 40


def word(rng: random.Random) -> str:
    return "".join(rng.choices("abcdefghijklmnop", k=6))


@pytest.mark.parametrize("kind", ["deletions", "mixed"])
def test_recall_at_the_edit_limit(kind):
    rng = random.Random(kind)
    texts = [[word(rng) for _ in range(n)] for n in LENGTHS]
    items = Items([(n, " ".join(t)) for n, t in zip(LENGTHS, texts)], 80)
    rows = []
    for n, text in zip(LENGTHS, texts):
        for _ in range(TRIALS if n <= 70 else 10):
            copy = list(text)
            for _ in range(edit_limit(n, 80)):
                what = 0 if kind == "deletions" else rng.randrange(3)
                at = rng.randrange(len(copy))
                copy[at : at + (what != 1)] = [] if what == 0 else [word(rng)]
            around = [[word(rng) for _ in range(rng.randrange(30, 60))] for _ in range(2)]
            rows.append((n, " ".join([*around[0], *copy, *around[1]])))
    batch = pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    hits = [0] * (max(LENGTHS) + 1)
    for out in _search(SimpleNamespace(value=items))(iter([batch])):
        for doc_id, item_id in zip(out.column("doc_id").to_pylist(), out.column("item_id").to_pylist()):
            assert doc_id == item_id
            hits[doc_id] += 1
    shares = {n: hits[n] / (TRIALS if n <= 70 else 10) for n in LENGTHS}
    assert sum(hits) / len(rows) >= 0.97
    assert min(shares.values()) >= 0.9, {n: s for n, s in shares.items() if s < 0.9}


def test_more_recall_takes_more_repetitions():
    assert repeats_needed(30, 6, 0.8) < repeats_needed(30, 6, 0.95) <= repeats_needed(30, 6, 0.99)
    assert repeats_needed(30, 0, 0.99) == 1
