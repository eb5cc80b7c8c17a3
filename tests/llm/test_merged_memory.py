import tracemalloc

import numpy as np

from sensorloom.llm import context_tree


def test_merged_keys_are_held_once():
    """Adding up 4 million keys takes less than 60 bytes of scratch for a key beside what came in; sums are exact."""
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 40, 500_000) for _ in range(8)]
    want, counts = np.unique(np.concatenate(parts), return_counts=True)
    merged = context_tree.Merged()
    tracemalloc.start()
    for p in parts:
        merged.add(*np.unique(p, return_counts=True))
    keys, got = merged.all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (keys == want).all() and (got == counts).all()
    assert peak < 60 * 4_000_000
