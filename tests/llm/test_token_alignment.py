"""Token alignment against cumulated decoded bytes of whole texts, and counts over all documents."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from quillframe.llm import token_alignment
from quillframe.llm.token_alignment import Aligner, align_tokens

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def brute(odd_rows):
    aligner, each = Aligner(*PATHS), []
    for _, text, *_ in odd_rows:
        whole = (" " + text).encode() if text else b""
        a = aligner.a.tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = aligner.b.model.encode(text) if text else []
        bytes_a, bytes_b = ([side.bytes_of[k].as_py() for k in ids] for side, ids in ((aligner.a, a), (aligner.b, b)))
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole or not whole:
            each.append((0, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(x) for x in part]).tolist() for part in (bytes_a, bytes_b)]
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to = [e.index(cut) + 1 for e in ends]
            groups.append((a[at[0] : to[0]], b[at[1] : to[1]]))
            at = to
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        each.append((len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest()))
    count = Counter(pair for e in each for pair in set(e[3]))
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    return [
        (row[0], e[0], e[1], e[2], len(e[3]), sum(count[p] == most[p[0]] for p in e[3]), sum(count[p] for p in e[3]), e[4])
        for row, e in zip(odd_rows, each)
    ]


@pytest.mark.parametrize("head_pairs", [1 << 22, 40, 0])
def test_groups_links_and_counts(odd_docs, brute, head_pairs):
    got = [tuple(r) for r in align_tokens(odd_docs, *PATHS, head_pairs=head_pairs).collect()]
    assert sorted(got, key=repr) == sorted(brute, key=repr)


def test_small_memory_and_long_groups(odd_docs, brute, monkeypatch):
    """A worker that forgets after every slice, and pairs kept as distinct ones, give the same result."""
    rows = odd_docs.select("doc_id", "text").toArrow().to_batches()
    for name, value in (("CACHE_UNITS", 1), ("SLICE_BYTES", 100), ("DENSE_LINKS", 2), ("BATCH_BYTES", 20)):
        monkeypatch.setattr(token_alignment, name, value)
    token_alignment._ENCODERS.clear()
    got = [r for batch in token_alignment._encoded(*PATHS)(iter(rows)) for r in batch.to_pylist()]
    assert sorted((r["doc_id"] or -1, r["n_links"], r["groups_sha256"]) for r in got) == sorted((r[0] or -1, r[4], r[7]) for r in brute)
    assert all(token_alignment.unpacked(r["times"]).sum() == r["n_links"] for r in got)


def test_no_rows(no_docs):
    assert align_tokens(no_docs, *PATHS).collect() == []
