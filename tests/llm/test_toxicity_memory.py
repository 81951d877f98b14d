"""What a worker of the toxicity index holds."""

import tracemalloc

import numpy as np

from quillframe.llm import toxicity


def test_queries_scored_together_hold_the_postings_of_one(monkeypatch):
    monkeypatch.setattr(toxicity, "DENSE_BYTES", 0)
    rng = np.random.default_rng(3)
    n_terms, terms = 200, np.arange(200)
    examples = [(k, k % 2, terms, rng.random(200)) for k in range(1500)]
    index = toxicity.BlockMaxIndex(examples, n_terms)
    assert index.example.nbytes + index.weight.nbytes == 6 * 1500 * 200
    queries = [(terms, rng.random(200)) for _ in range(toxicity.AT_ONCE)]
    queries = [(t, w / 1000) for t, w in queries]
    tracemalloc.start()
    found = index.nearest_of_each(queries, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    whole = np.array([e[3] for e in examples]).astype(np.float32)
    for (_, weight), (best, cosine) in zip(queries, found):
        want = np.round((whole * weight).sum(1), 6)
        np.testing.assert_allclose(cosine, np.sort(want)[::-1][:5], atol=2e-6)
        np.testing.assert_allclose(want[best], cosine, atol=2e-6)
