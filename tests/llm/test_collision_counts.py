import numpy as np
import pytest

from sensorloom.llm import collision_ann


def measured(x, queries):
    index, hits, verified = collision_ann.ShardIndex(np.arange(len(x)), x), 0, 0
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        found = index.search(x[q], q, 20)[0]
        hits += len(set(np.lexsort((np.arange(len(x)), -s))[:20]) & set(found))
        verified += index.verified
    return hits / 20 / len(queries), verified / len(queries) / len(x)


@pytest.mark.parametrize("spread", [0.5, 1.0, 2.0])
def test_counts_select_the_candidates(spread):
    """At a full shard of clustered vectors a fifth at most is verified, and nine neighbours of ten are found."""
    r = np.random.default_rng(9)
    x = r.normal(size=(64, 32))[r.integers(0, 64, 16_384)] * spread + r.normal(size=(16_384, 32))
    recall, share = measured(x, range(0, 16_384, 1024))
    assert recall >= 0.95 and share <= 0.2


def test_unclustered_vectors():
    r = np.random.default_rng(1)
    recall, share = measured(r.normal(size=(8000, 24)), range(0, 8000, 400))
    assert recall >= 0.95 and share <= 0.35


def test_places_in_all_arrays_at_once():
    r = np.random.default_rng(2)
    index = collision_ann.ShardIndex(np.arange(300), r.normal(size=(300, 5)) * 10 ** r.uniform(-3, 3, (300, 1)))
    for width in (0.0, 0.1, 5.0, 1e9):
        at = r.normal(size=len(index.sorted)) * 100 - width
        for side in ("left", "right"):
            assert index.places(at, side).tolist() == [int(np.searchsorted(s, v, side)) for s, v in zip(index.sorted, at, strict=True)]
