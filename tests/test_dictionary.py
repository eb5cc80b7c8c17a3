import numpy as np
import pytest

from sensorloom.operators import dictionary, metrics, split


def frame(spark, n, steps, seed):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        bump = np.zeros((2, steps))
        at = r.integers(0, steps - 6)
        bump[:, at : at + 6] += np.array([1, 2, 3, 3, 2, 1.0])
        rows.append((i, ("walking", "running")[i % 2], (bump + r.normal(size=(2, steps)) * 0.1).tolist()))
    return spark.createDataFrame(rows, "window_id long, activity_name string, w array<array<double>>")


@pytest.mark.parametrize(("mode", "rounds"), [("mean", 12), ("per_channel", 4)])
def test_equals_the_learner_in_one_task(spark, monkeypatch, mode, rounds):
    monkeypatch.setattr(dictionary, "SERIES", 7)  # several blocks an activity
    pairs = split.pair_windows(frame(spark, 60, 24, 1), frame(spark, 50, 24, 2), None).repartition(3).cache()
    options = dict(count=4, rounds=rounds, mode=mode)
    want = {r.activity_name: r.SHR for r in metrics.shapelets(pairs, **options).collect()}
    got = {r.activity_name: r.SHR for r in dictionary.shapelets(pairs, **options).collect()}
    assert want.keys() == got.keys() == {"walking", "running"} and all(np.isclose(want[a], got[a], rtol=1e-6) for a in want)
    some = {r.activity_name: r.SHR for r in dictionary.shapelets(pairs, 10, count=3, rounds=2).collect()}
    assert all(np.isclose(some[a], x, rtol=1e-6) for a, x in ((r.activity_name, r.SHR) for r in metrics.shapelets(pairs, 10, count=3, rounds=2).collect()))


def test_refit_equals_the_one_on_series():
    r = np.random.default_rng(3)
    x, shapes = r.normal(size=(40, 20)), r.normal(size=(5, 6))
    gain, at = r.normal(size=(40, 5)), r.integers(0, 15, (40, 5))
    gain[:, 3] = 0
    plain, summed = shapes.copy(), shapes.copy()
    metrics._refit(x, plain, gain, at, 8.0)
    dictionary._refit(summed, dictionary._sums(x[:15], gain[:15], at[:15], 6) + dictionary._sums(x[15:], gain[15:], at[15:], 6), 8.0)
    assert np.allclose(plain, summed) and np.allclose(plain[3], shapes[3])


def test_nothing_and_unknown_modes(spark):
    pairs = split.pair_windows(frame(spark, 4, 8, 1), frame(spark, 4, 8, 2), None)
    assert dictionary.shapelets(pairs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        dictionary.shapelets(pairs, mode="other")
