"""Recall of near-duplicate links down to the operator's own threshold."""

import numpy as np
import pytest

from tarn.llm import neardup


def pairs(rng, level, n, low, high):
    """Texts of random words, and copies in which words at even distances are replaced."""
    out = []
    for _ in range(n):
        a = [f"w{x}" for x in rng.integers(0, 10**9, int(rng.integers(low, high)))]
        b = list(a)
        for at in np.linspace(0, len(a) - 1, int((1 - level) * len(a) + 1e-9)).astype(int):
            b[at] = f"v{rng.integers(0, 10**9)}"
        out.append((" ".join(a), " ".join(b)))
    return out


@pytest.mark.parametrize("low, high", [(5, 12), (12, 41), (41, 100), (100, 400)])
@pytest.mark.parametrize("level", [0.98, 0.95, 0.92, 0.9, 0.87, 0.85, 0.82, 0.8])
def test_similar_pairs_share_a_sketch(level, low, high):
    rng = np.random.default_rng(int(level * 100) + low)
    found = 0
    for a, b in pairs(rng, level, 100, low, high):
        w = neardup.Words([a, b])
        h = w.hashes()
        blobs = [(h[i:j] >> np.uint64(32)).astype(np.uint32).tobytes() for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
        assert neardup.similar(*blobs)
        x, y = neardup.order_minhash(h, w.first)
        short = max(w.n) <= neardup.SHORT
        found += bool(((x == y)[: None if short else neardup.SKETCHES]).any())
    assert found >= 90


def test_links_are_found_down_to_the_threshold(spark):
    rng = np.random.default_rng(8)
    texts, levels = [], [0.95, 0.9, 0.87, 0.85, 0.82, 0.8]
    for level in levels:
        texts += [t for p in pairs(rng, level, 60, 30, 200) for t in p]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    for k, level in enumerate(levels):
        at = range(120 * k, 120 * (k + 1), 2)
        assert sum(of[i] == of[i + 1] for i in at) >= 54, level
    assert all(v in (i, i - i % 2) for i, v in of.items())
