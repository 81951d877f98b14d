"""What the toxicity index and its vocabulary leave undone."""

import numpy as np
import pyarrow as pa

from quillframe.llm import toxicity


def _two_tongues(n: int):
    """Unit rows over 401 terms: each half has 200 terms of its own, and all share the last one a little."""
    rng = np.random.default_rng(5)
    rows = np.zeros((n, 401))
    for k in range(n):
        rows[k, (k % 2) * 200 + rng.permutation(200)[:60]] = 1 + rng.random(60)
        rows[k, 400] = 0.5
    return rows / np.sqrt((rows**2).sum(1, keepdims=True))


def test_blocks_without_a_neighbour_are_passed_over(monkeypatch):
    rows = _two_tongues(1200)
    index = toxicity.BlockMaxIndex([(k, k % 2, np.flatnonzero(r).tolist(), r[r > 0].tolist()) for k, r in enumerate(rows)], 401)
    assert len(index.blocks) == 2 and sorted(b.stop - b.start for b in index.blocks) == [600, 600]
    products, add = [], toxicity.BlockMaxIndex._add
    monkeypatch.setattr(toxicity.BlockMaxIndex, "_add", staticmethod(lambda near, dense, block, which: products.append(len(which)) or add(near, dense, block, which)))
    queries = [(np.flatnonzero(r), r[r > 0]) for r in rows[::7]]
    found = index.nearest_of_each(queries, 15)
    assert sum(products) == len(queries)  # of two blocks each, only its own
    for r, (best, cosine) in zip(rows[::7], found):
        want = np.round(rows.astype(np.float32).astype(float) @ r, 6)
        order = np.lexsort((np.arange(len(want)), -want))[:15]
        np.testing.assert_allclose(cosine, np.minimum(want[order], 1), atol=2e-6)
        np.testing.assert_allclose(np.minimum(want[best], 1), cosine, atol=2e-6)


def test_a_block_of_another_tongue_is_searched_when_the_own_has_too_few(monkeypatch):
    monkeypatch.setattr(toxicity, "DENSE_BYTES", 1 << 20)
    rows = _two_tongues(1200)
    index = toxicity.BlockMaxIndex([(k, 0, np.flatnonzero(r).tolist(), r[r > 0].tolist()) for k, r in enumerate(rows)], 401)
    best, cosine = index.nearest(np.flatnonzero(rows[4]), rows[4][rows[4] > 0], 900)
    want = np.round(rows @ rows[4], 5)
    assert len(best) == 900 and set(best[:600]) == set(range(0, 1200, 2))
    np.testing.assert_allclose(want[best], cosine, atol=2e-5)


def test_repeated_words_are_looked_up_once(monkeypatch):
    texts = pa.array(["alpha alphabet beta", None, "", "beta " * 500 + "alphabets", "ALPHA-beta"])
    looked, places = [], toxicity.Vocabulary.places
    monkeypatch.setattr(toxicity.Vocabulary, "places", lambda self, term: looked.append(len(term)) or places(self, term))
    terms = np.unique(np.concatenate([kinds for _, _, kinds, _, _ in toxicity.row_terms(texts.slice(0, 1))]))
    got = {}
    for lo, _, kinds, row, at in toxicity.row_terms(texts, toxicity.Vocabulary(terms)):
        for r, t, n in zip(*toxicity._counted_places(row, at)):
            got[lo + r, int(kinds[t])] = n
    assert looked == [4, 4, 3, 2, 2, 2]
    plain = {}
    for lo, _, kinds, row, at in toxicity.row_terms(texts):
        for r, t, n in zip(*toxicity._counted_places(row, at)):
            plain[lo + r, int(kinds[t])] = n
    assert got == {key: n for key, n in plain.items() if key[1] in set(terms.tolist())}
    assert max(got.values()) == 500 and {r for r, _ in got} == {0, 3, 4}


def test_vocabulary_finds_all_terms_and_no_others():
    terms = np.unique(np.concatenate([np.arange(50, dtype=np.uint64), np.arange(5000, dtype=np.uint64) << np.uint64(50), np.array([2**64 - 1], np.uint64)]))
    asked = np.concatenate([terms[::-1], terms + np.uint64(1), np.array([77, 2**63], np.uint64)])
    which, place = toxicity.Vocabulary(terms).places(asked)
    known = np.isin(asked, terms)
    assert which.tolist() == np.flatnonzero(known).tolist() and (terms[place] == asked[known]).all()
    assert len(toxicity.Vocabulary(terms[:0]).places(asked)[0]) == 0
