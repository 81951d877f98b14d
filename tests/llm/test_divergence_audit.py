"""The divergence audit against whole-number arithmetic over plain counters."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillframe.llm import divergence_audit as audit
from quillframe.llm.divergence_audit import divergence_audit


def brute(rows, least_docs, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for _, text, lang, source in rows]
    df = defaultdict(Counter)
    for lang, _, terms in docs:
        df[lang].update(set(terms))
    kept = {lang: sorted(t for t, n in c.items() if n >= least_docs) for lang, c in df.items()}
    counts = defaultdict(Counter)
    for lang, source, terms in docs:
        counts[lang, source].update(t for t in terms if df[lang][t] >= least_docs)
        counts[lang, None].update(t for t in terms if df[lang][t] >= least_docs)

    def p(group, term):
        return 1 + 10**9 * (counts[group][term] + 1) // (counts[group].total() + len(kept[group[0]]))

    out = []
    for lang, source in list(counts):
        if source is None:
            continue
        pairs, terms = [], []
        for other_lang, other in list(counts):
            if other_lang == lang and other not in (None, source):
                value = sum((p((lang, source), t) - p((lang, other), t)) ** 2 // p((lang, other), t) for t in kept[lang])
                pairs.append((-value, other.encode()))
        for t in kept[lang]:
            mine, all_of = p((lang, source), t), p((lang, None), t)
            if counts[lang, source][t] and mine > all_of:
                terms.append((-((mine - all_of) ** 2 // all_of), t.encode()))
        out += [(lang, source, "pair", item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(pairs))]
        out += [(lang, source, "term", item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(terms)[:top])]
    return sorted(out)


@pytest.mark.parametrize("options", [
    {}, {"least_docs": 2, "top": 5}, {"least_docs": 1, "shard_terms": 3, "tile": 1}, {"least_docs": 1, "head_bytes": 0, "shard_terms": 7, "tile": 2},
    {"least_docs": 1, "head_bytes": 900, "top": 3},
])
def test_values_and_ranks(odd_docs, odd_rows, options, monkeypatch):
    if options.get("tile"):
        monkeypatch.setattr(audit, "HELD_SLOTS", 1)
    got = [tuple(r) for r in divergence_audit(odd_docs, **options).collect()]
    assert sorted(got) == brute(odd_rows, options.get("least_docs", 3), options.get("top", 200))


def test_no_rows(no_docs):
    assert divergence_audit(no_docs).collect() == []


def test_perfect_hash_is_minimal_and_proves_hits():
    terms = [f"t{k}".encode() for k in range(5000)]
    hashes = audit.hashes_of(terms)
    shards = []
    for shard in range(4):  # the third gets no term
        mine = [k for k in range(3000) if int(hashes.astype(np.int64)[k] % 4) == shard and shard != 2]
        sizes, bits, order = audit.perfect_hash(hashes[mine])
        assert sorted(order) == list(range(len(mine))) and sum(bits) == len(mine)
        shards.append({"n_terms": len(mine), "sizes": sizes, "bits": np.packbits(bits, bitorder="little").tobytes(),
                       "body": b"".join(terms[mine[k]] for k in order), "widths": np.array([len(terms[mine[k]]) for k in order], np.int32)})
    slots = audit.Lexicon(shards).slots(pa.array(terms, pa.large_binary()), hashes)
    stored = np.array([k < 3000 and int(hashes.astype(np.int64)[k] % 4) != 2 for k in range(5000)])
    assert ((slots >= 0) == stored).all()
    assert sorted(slots[stored]) == list(range(stored.sum()))


def test_probabilities_are_exact_for_large_counts():
    for total in (1, 7, 3 * 10**9, 8 * 10**15):
        counts = np.array([0, 1, total // 3, total - 1])
        assert audit.probabilities(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]
