"""What a counting task of the divergence audit sends and looks up."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyspark

from quillframe.llm import divergence_audit as audit


def _lexicons(words: dict[str, list[str]]):
    out = {}
    for lang, terms in words.items():
        hashes = audit.hashes_of([t.encode() for t in terms])
        sizes, bits, order = audit.perfect_hash(hashes)
        terms = [terms[k].encode() for k in order]
        words[lang] = terms
        out[lang] = [{"n_terms": len(terms), "sizes": sizes, "bits": np.packbits(bits, bitorder="little").tobytes(), "body": b"".join(terms),
                      "widths": np.array([len(t) for t in terms], np.int32)}]
    return out


def _run(monkeypatch, held_slots: int):
    letters = "abcdefghij"
    words = {lang: [lang * 2 + a + b + c for a in letters for b in letters for c in letters] for lang in ("k", "m")}
    batches = []
    for j in range(40):
        rows = [(" ".join(words[lang][(j + 25 * s) % 900 : (j + 25 * s) % 900 + 30]), lang, f"s{s}") for s in range(4) for lang in ("k", "m")]
        batches.append(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["text", "lang", "source"]))
    want = Counter()
    for batch in batches:
        for text, lang, source in zip(*(c.to_pylist() for c in batch.columns)):
            want.update((lang, source, t.encode()) for t in text.split())
    shared = SimpleNamespace(id=object(), value=_lexicons(words))
    monkeypatch.setattr(audit, "HELD_SLOTS", held_slots)
    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    asked, slots = [], audit.Lexicon.slots
    monkeypatch.setattr(audit.Lexicon, "slots", lambda self, terms, hashes: asked.append(len(terms)) or slots(self, terms, hashes))
    rows = [r for b in audit._recounted(shared, False)(iter(batches)) for r in b.to_pylist()]
    got = Counter()
    for r in rows:
        counts = audit.unpacked(r["counts"])
        assert r["n"] == counts.sum()
        got.update({(r["lang"], r["source"], words[r["lang"]][k]): int(counts[k]) for k in np.flatnonzero(counts)})
    assert got == want
    return rows, asked


def test_a_task_sends_its_counts_once_while_few_are_not_zero(monkeypatch):
    rows, _ = _run(monkeypatch, 2000)  # eight groups of 1000 slots each, 70 of them used
    assert len(rows) == 8


def test_counts_beyond_the_bound_are_sent_in_between(monkeypatch):
    rows, _ = _run(monkeypatch, 1)
    assert len(rows) == 8 * 40


def test_terms_are_looked_up_in_their_own_language(monkeypatch):
    _, asked = _run(monkeypatch, 2000)
    assert len(asked) == 80 and max(asked) <= 4 * 30


def test_sums_beyond_32_bits():
    held = audit._Counts({"k": SimpleNamespace(edges=np.array([0, 3]))})
    for _ in range(3):
        held.add(("k", "s"), np.array([0, 2]), np.array([2**30, 1]))
        held.shrink()
    assert held.dense(("k", "s")).tolist() == [3 * 2**30, 0, 3] and held.size == 6  # 2 ** 31 does not fit one piece
