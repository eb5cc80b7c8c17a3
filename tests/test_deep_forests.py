import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import classify, forests


def table(spark, n, classes=4, width=5, seed=1, values=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) if values is None else rng.integers(0, values, (n, width)).astype(float)
    c = rng.integers(0, classes, n)
    return x, c, spark.createDataFrame([(i, float(k), v) for i, (k, v) in enumerate(zip(c.tolist(), x.tolist(), strict=True))], "id long, label double, features array<double>")


def plain(x, c, w, classes, name, depth, asked):
    """One tree, node by node: what share of each class the asked rows' leaves have."""
    out = np.zeros((len(asked), classes))

    def grow(rows, name, left, points):
        counts = np.bincount(c[rows], w[rows], classes)
        best = (-1, None, None)
        if np.count_nonzero(counts) > 1 and left:
            order, width = np.arange(x.shape[1])[None].copy(), x.shape[1]
            for j in range(width):
                if j >= math.ceil(math.sqrt(width)) and best[0] >= 0:
                    break
                forests._draw(np.array([name]), order, j)
                v = x[rows, order[0, j]]
                for a, b in zip(np.unique(v)[:-1], np.unique(v)[1:], strict=True):
                    sides = [np.bincount(c[rows[s]], w[rows[s]], classes) for s in (v <= a, v > a)]
                    score = sum((s**2).sum() / s.sum() for s in sides)
                    if score > best[0] + 1e-9:
                        best = (score, order[0, j], (a, (a + b) / 2))
        if best[0] < 0:
            out[points] = counts / counts.sum()
            return
        _, f, (a, middle) = best
        for side, child in enumerate(forests._children(np.array([name]))):
            grow(rows[(x[rows, f] > a) == bool(side)], child, left - 1, points[(asked[points, f] > middle) == bool(side)])

    grow(np.flatnonzero(w), name, depth, np.arange(len(asked)))
    return out


@pytest.mark.parametrize(("values", "depth"), [(None, 30), (3, 30), (None, 3)])
def test_trees_are_those_of_a_plain_recursion(values, depth):
    """Also where equal rows have different classes, so that no feature cuts."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 5)) if values is None else rng.integers(0, values, (150, 5)).astype(float)
    c, asked, trees = rng.integers(0, 3, 150), x[:40] + rng.normal(size=(40, 5)) / 9, np.arange(6)
    taken, names = np.stack([forests._taken(7, t, 0, rng.integers(1, 3, 150)) for t in trees]), forests._roots(7, trees)
    got = forests._votes(x, c, 3, taken, names, depth, asked)
    want = sum(plain(x, c, taken[t], 3, names[t], depth, asked) for t in trees)
    assert np.allclose(got / forests.VOTE, want, atol=1e-6)


def test_forest_needs_few_jobs(spark):
    """One job for each level and lot of nodes made hundreds."""
    _, _, rows = table(spark, 400)
    rows = rows.select("id", "label", *[F.col("features")[i].alias(f"x{i}") for i in range(5)])
    spark.sparkContext.setJobGroup("forests", "forests")
    got = classify.forest_utility(rows.where("id % 4 < 2"), rows.where("id % 4 = 2"), rows.where("id % 4 = 3"), [f"x{i}" for i in range(5)], trees=20, depth=30).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 3 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("forests")) < 60


def test_predictions_do_not_depend_on_partitions_or_copies(spark):
    """The same rows elsewhere give the same predictions, equal test rows one prediction, and every test row comes back."""
    _, _, rows = table(spark, 300)
    model = forests.RandomForestClassifier(numTrees=9, maxDepth=30)
    test = rows.where("id < 90").unionByName(rows.where("id < 20").withColumn("id", F.col("id") + 1000))
    got = {r.id: r.prediction for r in model.fit(rows).transform(test).collect()}
    again = {r.id: r.prediction for r in model.fit(rows.repartition(7)).transform(test.repartition(3)).collect()}
    assert got == again and len(got) == 110 and all(got[i] == got[i + 1000] for i in range(20))


def test_nulls_labels_and_copies(spark):
    """Null and NaN are larger than all numbers, labels may be any numbers, and many copies of a row are one row with a count."""
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, -7.5).otherwise(1e9).alias("label"), F.array(F.when(F.col("id") % 2 == 0, F.lit(1.0)).when(F.col("id") % 4 == 1, F.lit(float("nan"))), F.lit(0.0)).alias("features"))
    model = forests.RandomForestClassifier(numTrees=5, maxDepth=4).fit(rows)
    assert model.n == 3 - 1  # null and NaN are one value
    got = {(r.label, r.prediction) for r in model.transform(rows).collect()}
    assert got == {(-7.5, -7.5), (1e9, 1e9)}
    with pytest.raises(ValueError):
        forests.RandomForestClassifier(numTrees=5, maxDepth=4).fit(rows.withColumn("label", F.lit(None).cast("double")))


def test_large_nodes_are_split_before_rows_are_dealt(spark, monkeypatch):
    """Every tree votes once on every test row, in several waves, passes, blocks and chunks of test rows; no task sees more rows than it may."""
    x, c, rows = table(spark, 3000, classes=3, width=4, seed=5)
    rows = rows.withColumn("label", F.expr("CAST(features[0] > 0.3 AS DOUBLE) + CAST(features[1] > 0 AS DOUBLE)"))
    for name, value in {"NODE_ROWS": 400, "BLOCK_ROWS": 256, "TEST_BLOCKS": 1, "WAVE_ROWS": 9000, "WAVE_TREES": 2, "PASS_NODES": 3}.items():
        monkeypatch.setattr(forests, name, value)
    model = forests.RandomForestClassifier(numTrees=5, maxDepth=30).fit(rows.where("id >= 1000"))
    tops = model._tops(forests.kept(model.blocks), [np.unique(np.quantile(x[:, f], np.arange(1, 256) / 256)) for f in range(4)], range(2), 400)
    ends = [np.bincount(top.end(x[1000:])) for top in tops.values()]
    assert all(n.sum() == 2000 and len(n[n > 0]) > 4 and n.max() < 1000 for n in ends)
    seen, summed = [], model._summed
    monkeypatch.setattr(model, "_summed", lambda votes: seen.append(summed(votes)) or seen[-1])
    got = model.transform(rows.where("id < 1000")).collect()
    votes = seen[-1].collect()
    assert len(got) == len(votes) == 1000 and all(abs(sum(r.votes) / forests.VOTE - 5) < 1e-6 for r in votes)
    assert sum(r.label == r.prediction for r in got) > 970


def test_depth_holds_across_both_ways(spark, monkeypatch):
    """A tree of one split, made by histograms or in a task, has the same two sides."""
    rows = spark.range(2000).select(F.col("id"), F.expr("CAST(id % 10 >= 6 AS DOUBLE)").alias("label"), F.array((F.col("id") % 10).cast("double")).alias("features"))
    for limit in (1 << 20, 4):
        monkeypatch.setattr(forests, "NODE_ROWS", limit)
        model = forests.RandomForestClassifier(numTrees=3, maxDepth=1).fit(rows)
        assert all(r.label == r.prediction for r in model.transform(rows).collect())
