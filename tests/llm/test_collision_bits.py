import time

import numpy as np
import pytest

from sensorloom.llm import collision_ann


@pytest.mark.parametrize(("n", "directions", "share"), [(1, 1, 1.0), (63, 5, 0.4), (64, 7, 1.0), (700, 31, 0.81), (1000, 32, 0.01), (300, 160, 0.81)])
def test_bits_hold_the_counts(n, directions, share):
    """Summed bits name just the vectors that lie in `need` windows, as counts one by one do."""
    r = np.random.default_rng(n)
    x = r.normal(size=(n, 6))
    index = collision_ann.ShardIndex(np.arange(n), x, directions=directions, share=share)
    buckets = index.sorted.shape[1]
    ends = np.sort(r.integers(0, buckets + 1, (2, 9, directions)), axis=0)
    bits = np.unpackbits(index.reached(*ends).view(np.uint8), axis=1, bitorder="little")
    inside = np.diff(np.unpackbits(index.below.view(np.uint8), axis=2, bitorder="little")[:, :, :n].astype(int), axis=1)  # direction, bucket, vector
    assert (inside.sum(axis=1) == 1).all()
    for got, low, high in zip(bits, *ends, strict=True):
        counts = sum(inside[j, low[j] : high[j]].sum(axis=0) for j in range(directions))
        assert np.array_equal(np.flatnonzero(got), np.flatnonzero(counts >= index.need))


def test_copies_share_their_buckets():
    """Copies fill many buckets' worth of ranks but lie in one; ties go to the smaller id."""
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 16))
    x[500:2001] = x[7]
    index = collision_ann.ShardIndex(np.arange(3000)[::-1].copy(), x[::-1].copy())
    bits = np.unpackbits(np.diff(index.below, axis=1).view(np.uint8), axis=2, bitorder="little")
    assert (bits[:, :, 500:2001] == bits[:, :, 7:8]).all()
    assert index.search(x[7], 7, 20)[0].tolist() == list(range(500, 520))


def test_ties_of_copies_go_to_the_smaller_id():
    """Wherever copies lie in a shard, they are projected and scored alike."""
    for seed in range(30):
        r = np.random.default_rng(seed)
        x = r.normal(size=(1500, 24))
        copies = np.sort(r.choice(1500, 300, replace=False))
        x[copies] = r.normal(size=24)
        own, s = copies[0], (x * x[copies[0]]).sum(axis=1)
        nearer = np.setdiff1d(np.flatnonzero(s > s[own] + 1e-9), copies)
        best = [*nearer[np.argsort(-s[nearer])], *copies[1:]][:20]
        assert collision_ann.ShardIndex(np.arange(1500), x).search(x[own], own, 20)[0].tolist() == best


def test_searches_together_and_alone():
    r = np.random.default_rng(5)
    x = r.normal(size=(900, 8)) * 10 ** r.uniform(-1, 1, (900, 1))
    index = collision_ann.ShardIndex(np.arange(900), x)
    for q, (ids, scores) in enumerate(index.search_all(x[:70], np.arange(70), 20)):
        alone = index.search(x[q], q, 20)
        assert ids.tolist() == alone[0].tolist() and np.allclose(scores, alone[1], rtol=1e-12)


def test_a_search_costs_less_than_its_collisions_one_by_one():
    """At a full shard, windows of 160 directions hold some 1.5 million entries for each query; adding them up one by one took most of the CPU time."""
    r = np.random.default_rng(9)
    n = 16_384
    x = r.normal(size=(64, 32))[r.integers(0, 64, n)] * 0.5 + r.normal(size=(n, 32))
    index = collision_ann.ShardIndex(np.arange(n), x)
    own = np.arange(0, n, 256)

    def least(run):
        times = []
        for _ in range(3):
            began = time.thread_time()
            run()
            times.append(time.thread_time() - began)
        return min(times)

    windows = r.integers(0, n, 1_500_000, dtype=np.int32)
    assert least(lambda: index.search_all(x[own], own, 20)) < len(own) * least(lambda: np.bincount(windows, minlength=n))
