import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import classify, metrics, split
from sensorloom.queries import ORACLES, QUERIES
from sensorloom.sources import sensor

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b, strict=True))
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    got = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = [dict(zip(cols, r, strict=True)) for r in cur.fetchall()]
    order = lambda rows: sorted(([r[c] for c in sorted(r)] for r in rows), key=lambda r: [(x is None, str(x)) for x in r if not isinstance(x, float)])
    assert len(got) == len(want) and (not got or sorted(got[0]) == sorted(cols))
    assert all(same(a, b) for a, b in zip(order(got), order(want), strict=True))


def test_sampled_pairs(spark, con, monkeypatch):
    """Queries over sampled pairs take all pairs up to 128 of an activity, with the operators' own lags, shapelets and rounds."""
    n = dict(con.execute("SELECT 'a' || label, least(count(*) FILTER (vec_id % 2 = 0), count(*) FILTER (vec_id % 2 = 1), 128) FROM embeddings GROUP BY label").fetchall())
    got = {r.activity_name: r for r in QUERIES["similarity_all"](spark, SF).collect()}
    assert max(n.values()) > 12 and {a: r.num_real for a, r in got.items() if a in n} == n
    w = sensor.vectors_as_windows(spark, SF)
    pairs = split.pair_windows(w.where("NOT generated"), w.where("generated"), 128, 42).persist()
    r, s = (pairs.select("activity_name", F.col(f"{x}_id").alias("window_id"), F.col(x).alias("w")) for x in "rs")
    for row in metrics.autocorrelation_difference(r, s, 32).collect():
        assert math.isclose(got[row.activity_name].ACD, row.ACD, abs_tol=1e-6)
    want = {r.activity_name: r.DTW for r in metrics.warp(pairs).collect()}
    assert all(math.isclose(r.DTW, want[r.activity_name], abs_tol=1e-6) for r in QUERIES["dtw_pairs"](spark, SF).collect())
    asked = []
    monkeypatch.setattr(metrics, "shapelets", lambda x, **options: asked.append((x.count(), options)) or x)
    QUERIES["shr"](spark, SF)
    assert asked == [(sum(n.values()), {})]


def test_forest_has_the_reference_size(spark, monkeypatch):
    """300 trees of any depth; 30 is the deepest Spark allows. Grown smaller here."""
    asked, forest = [], classify.RandomForestClassifier
    monkeypatch.setattr(classify, "RandomForestClassifier", lambda **o: asked.append((o["numTrees"], o["maxDepth"])) or forest(numTrees=2, maxDepth=2, seed=1))
    assert QUERIES["rf_utility"](spark, SF).count() == 3 and asked == [(300, 30)] * 3


def test_nearest_neighbours_of_whole_vectors(spark, con):
    """Brute force over all components of every vector."""
    rows = con.execute("SELECT vec_id, label, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, labels, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.float64)
    train = ids % 3 != 0
    x = (x - x[train].mean(axis=0)) / x[train].std(axis=0)
    want = {}
    for q in np.flatnonzero(~train):
        d = np.linalg.norm(x[train] - x[q], axis=1)
        near = np.lexsort((ids[train], d))[:5]
        votes = {}
        for i in near:
            votes[labels[train][i]] = votes.get(labels[train][i], 0) + (1 / d[i] if d[near[0]] > 0 else float(d[i] == 0))
        want[ids[q]] = min(votes, key=lambda v: (-votes[v], v))
    got = {r.query_id: r.prediction for r in QUERIES["knn_consistency"](spark, SF).collect()}
    assert got == want
