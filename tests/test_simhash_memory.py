"""Signatures of a large batch are worked out in parts."""

import random
import tracemalloc

import numpy as np
import pandas as pd

from vacantia.functions import simhash


def test_a_large_batch_takes_little_memory():
    rng = random.Random(3)
    texts = [[f"w{rng.randrange(10**5)}" for _ in range(400)] for _ in range(4000)]
    joined = pd.Series([" ".join(t) for t in texts])
    tracemalloc.start()
    got = simhash._simhash(joined)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    want = simhash.signatures([simhash.three_grams(t) for t in texts[:50]])
    assert (got.to_numpy()[:50].view(np.uint64) == want).all()


def test_parts_short_and_empty_texts(monkeypatch):
    rng = random.Random(4)
    texts = [[rng.choice(["a", "c++", "d9", "e" * 70]) for _ in range(rng.choice([0, 1, 2, 3, 4, 30]))] for _ in range(500)]
    want = simhash.signatures([simhash.three_grams(t) for t in texts])
    for part in (1, 50, 1 << 20):
        monkeypatch.setattr(simhash, "PART", part)
        assert (simhash._simhash(pd.Series([" ".join(t) for t in texts])).to_numpy().view(np.uint64) == want).all()
    assert len(simhash._simhash(pd.Series([], dtype=object))) == 0
