"""What queries of the toxicity index share when they are scored together."""

import numpy as np

from quillframe.llm import toxicity


def _unit_rows(n: int) -> np.ndarray:
    rng = np.random.default_rng(8)
    rows = np.where(rng.random((n, 300)) < 0.3, 1 + rng.random((n, 300)), 0)
    return rows / np.sqrt((rows**2).sum(1, keepdims=True))


def _index(rows: np.ndarray) -> toxicity.BlockMaxIndex:
    return toxicity.BlockMaxIndex([(k, k % 2, np.flatnonzero(r).tolist(), r[r > 0].tolist()) for k, r in enumerate(rows)], rows.shape[1])


def _widths(monkeypatch) -> list[int]:
    """How many terms the matrices have that are multiplied."""
    widths, add = [], toxicity.BlockMaxIndex._add
    monkeypatch.setattr(
        toxicity.BlockMaxIndex, "_add", staticmethod(lambda near, dense, block, which: widths.append(block.dense.shape[1]) or add(near, dense, block, which))
    )
    return widths


def test_only_terms_that_queries_share_are_multiplied(monkeypatch):
    rows, widths = _unit_rows(800), _widths(monkeypatch)
    index, asked = _index(rows), rows[:90].copy()
    asked[:, 100:] = 0
    queries = [(np.flatnonzero(r), r[r > 0]) for r in asked]
    found = index.nearest_of_each(queries, 15)
    assert widths and max(widths) <= 100
    widths.clear()
    for query, r, (best, cosine) in zip(queries, asked, found):
        want = np.round(rows.astype(np.float32).astype(float) @ r, 6)
        order = np.lexsort((np.arange(len(want)), -want))[:15]
        assert best.tolist() == order.tolist()
        np.testing.assert_allclose(cosine, want[order], atol=2e-6)
        alone = index.nearest(*query, 15)
        assert alone[0].tolist() == best.tolist() and alone[1].tolist() == cosine.tolist()
    assert not widths  # one query is answered from its postings


def test_a_batch_of_queries_without_known_blocks_or_terms():
    rows = _unit_rows(40)
    index = _index(rows)
    none = (np.zeros(0, np.int64), np.zeros(0))
    found = index.nearest_of_each([none, (np.flatnonzero(rows[3]), rows[3][rows[3] > 0]), none], 50)
    assert [len(best) for best, _ in found] == [0, 40, 0] and found[1][0][0] == 3
    assert index.nearest_of_each([], 5) == []
