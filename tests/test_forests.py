import threading

from pyspark.sql import functions as F

from sensorloom.operators import classify


def test_forests_are_trained_at_the_same_time(spark, monkeypatch):
    """No forest is done before all three have begun; each sees all of its rows."""
    begun, forest, sizes = threading.Barrier(3, timeout=60), classify.RandomForestClassifier, []

    class Waiting:
        def __init__(self, **options):
            self.options = options

        def fit(self, rows):
            begun.wait()
            sizes.append(rows.count())
            return forest(**self.options).fit(rows)

    monkeypatch.setattr(classify, "RandomForestClassifier", Waiting)
    df = spark.range(120).select(F.col("id"), (F.col("id") % 2).alias("label"), (F.col("id") % 2 * 10 + F.col("id") % 3).alias("x"))
    parts = [df.where(f"id % 4 {w}") for w in ("< 2", "= 2", "= 3")]
    got = {r.setting: r.accuracy for r in classify.forest_utility(parts[0], parts[0].where("id < 60"), parts[1].unionByName(parts[2]), ["x"], trees=5, depth=3).collect()}
    assert got == {"real_only": 1.0, "synthetic_only": 1.0, "real_plus_synthetic": 1.0} and sorted(sizes) == [30, 60, 90]
