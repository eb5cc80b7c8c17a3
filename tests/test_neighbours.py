import numpy as np
import pytest

from sensorloom.operators import classify, neighbours

SCHEMA = "{0}_id long, label int, x array<double>"


def frames(spark, train, queries):
    make = lambda rows, side: spark.createDataFrame([(i, i % 3, None if v is None else [float(a) for a in v]) for i, v in rows], SCHEMA.format(side))
    return make(train, "train"), make(queries, "query")


def brute(train, queries, k):
    out = []
    for q, v in queries:
        d = sorted((float(np.sqrt(((np.asarray(t) - v) ** 2).sum())), i) for i, t in train)
        out += [(q, i, round(x, 9)) for x, i in d[:k]]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r.train_id, round(r.d, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(0)
    centres = r.normal(size=(40, 8)) * 20
    train = [(i, centres[i % 40] + r.normal(size=8)) for i in range(2000)]
    queries = [(i, centres[i % 40] + r.normal(size=8)) for i in range(200)]
    return train, queries


def test_matches_brute_force_and_compares_few_pairs(spark, clustered, monkeypatch):
    train, queries = clustered
    t, q = frames(spark, train, queries)
    seen = []
    nearest = neighbours._nearest
    monkeypatch.setattr(neighbours, "_nearest", lambda met, k: seen.append(met) or nearest(met, k))
    assert found(neighbours.neighbours(t, q, 5)) == brute(train, queries, 5)
    pairs = 0
    for met in seen:  # compared is the same in all rows of a query and block
        pairs += met.groupBy("query_id", "compared").count().selectExpr("sum(compared)").first()[0]
    assert pairs < len(train) * len(queries) / 10


@pytest.mark.parametrize("block", [3, 1024])
def test_any_data(spark, block, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    r = np.random.default_rng(1)
    same = np.ones(4)
    train = [(i, same if i % 3 == 0 else r.integers(0, 3, 4)) for i in range(90)]  # a third of all rows are equal, many tie
    queries = [(i, r.integers(0, 3, 4) * 1.0) for i in range(25)] + [(99, same), (100, same * 1e9)]
    t, q = frames(spark, train, queries)
    assert found(neighbours.neighbours(t, q, 4)) == brute(train, queries, 4)
    assert found(neighbours.neighbours(t, q, 200)) == brute(train, queries, 200)


def test_odd_rows(spark):
    odd = [(50, None), (51, [1.0, float("nan")]), (52, [float("inf"), 0.0])]
    t, q = frames(spark, [(1, [0.0, 0.0]), (2, [3.0, 4.0]), *odd], [(7, [0.0, 0.0]), (8, None), *odd])
    assert found(neighbours.neighbours(t, q, 5)) == [(7, 1, 0.0), (7, 2, 5.0)]
    assert neighbours.neighbours(t.limit(0), q, 5).count() == 0 and neighbours.neighbours(t, q.limit(0), 5).count() == 0
    assert [tuple(r) for r in classify.knn(t, q, 5).collect()] == [(7, 1, 1)]  # the exact hit alone counts


def test_lone_training_row(spark):
    t, q = frames(spark, [(1, [2.0])], [(1, [5.0]), (2, [2.0])])
    assert found(neighbours.neighbours(t, q, 3)) == [(1, 1, 3.0), (2, 1, 0.0)]
