import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import clean, scans, windows
from sensorloom.operators.select import exact_quantiles

SCHEMA = "event_id long, subject_id int, activity_id int, timestamp double, x double, y double, n long, k long"


@pytest.fixture(scope="module")
def recordings(spark):
    """A group with a third of all rows, ties and gaps in time, nulls, NaN, null keys, and columns named as the scans name theirs."""
    r = random.Random(3)
    rows, at = [], 0.0
    for i in range(1500):
        at += r.choice([0.0, 0.01, 0.01, 0.01, 0.02, 0.5])
        group = (1, 1) if i % 3 == 0 else r.choice([(1, 2), (2, 1), (2, 2), (None, 1), (3, None)])
        t = None if i % 211 == 5 else float("nan") if i % 307 == 7 else at
        rows.append((i, *group, t, r.choice([None, r.random()]) if i % 400 > 60 else None, None if group == (2, 2) else r.choice([None, None, r.random()]), 1, 2))
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


ORDER = ["timestamp", "event_id"]


def rows_of(df, *columns):
    """Rows by event_id, NaN as text so that it equals itself."""
    return sorted((r.event_id, *[str(r[c]) if r[c] is None or r[c] != r[c] else round(float(r[c]), 9) for c in columns]) for r in df.collect())


@pytest.mark.parametrize("size", [10**6, 40, 7])
def test_filling_in_segments(recordings, size):
    got = scans.interpolate_long(recordings, ["x", "y"], ORDER, size)
    assert got.columns == recordings.columns
    assert rows_of(got, "x", "y") == rows_of(clean.interpolate(recordings, ["x", "y"], ORDER), "x", "y")


@pytest.mark.parametrize("size", [10**6, 40, 7])
def test_runs_in_segments(recordings, size):
    some = recordings.where("NOT isnan(timestamp)")
    want = clean.assign_runs(some, ORDER)
    got = scans.runs_long(some, ORDER, segment_rows=size)
    assert rows_of(got, "run_id") == rows_of(want, "run_id")
    assert rows_of(scans.lag_delta_long(some, ORDER, size), "delta") == rows_of(clean.lag_delta(some, ORDER), "delta")


def test_row_numbers_in_segments(recordings):
    from pyspark.sql.window import Window

    want = recordings.withColumn("at", F.row_number().over(Window.partitionBy("subject_id").orderBy(*ORDER)) - 1)
    assert rows_of(scans.numbered_long(recordings, ["subject_id"], ORDER, "at", 25), "at") == rows_of(want, "at")


def test_segments_are_bounded_and_ordered(recordings):
    cut = scans.segmented(recordings.where("timestamp IS NOT NULL AND NOT isnan(timestamp)"), ["subject_id", "activity_id"], "timestamp", 20)
    got = cut.groupBy("__g", "__s").agg(F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).orderBy("__g", "__s").collect()
    assert max(r.n for r in got) < 60 < 500  # equal times stay together; the largest group has 500 rows
    assert all(p["__g"] != q["__g"] or p.b < q.a for p, q in zip(got, got[1:], strict=False))


def test_many_segments_between_cuts(spark, monkeypatch):
    monkeypatch.setattr(scans, "QUANTILES", 4)
    df = spark.range(2000).selectExpr("id AS event_id", "1 AS subject_id", "1 AS activity_id", "pow(id / 100, 3) AS timestamp", "IF(id % 5 = 0, id, NULL) * 1.0D AS x")
    cut = scans.segmented(df, ["subject_id"], "timestamp", 50)
    assert cut.select("__s").distinct().count() > 20
    assert rows_of(scans.interpolate_long(df, ["x"], ORDER, 50), "x") == rows_of(clean.interpolate(df, ["x"], ORDER), "x")


def test_scans_of_nothing(recordings):
    none = recordings.limit(0)
    assert scans.interpolate_long(none, ["x"], ORDER).count() == scans.runs_long(none, ORDER).count() == scans.numbered_long(none, ["subject_id"], ORDER, "at").count() == 0


@pytest.mark.parametrize(("bins", "small"), [(8, 20), (1024, 10_000), (3, 1)])
def test_exact_quantiles(spark, bins, small):
    r = random.Random(1)
    groups = {1: [r.gauss(0, 1) for _ in range(700)], 2: [1e300, -1e300, 5.0] * 40, 3: [7.0] * 300, None: [r.expovariate(1e-6) for _ in range(90)], 5: [float("nan"), float("inf"), 2.0], 6: [None]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k int, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {row.k: row.q for row in exact_quantiles(df, ["k"], "v", probs, bins, small).collect()}
    for k, vs in groups.items():
        vs = [v for v in vs if v is not None and abs(v) < float("inf")]
        assert k not in got if not vs else np.allclose(got[k], np.quantile(np.array(vs), probs), rtol=1e-12)
    assert exact_quantiles(df.where("k = 1"), [], "v", [0.5], bins, small).first().q[0] == pytest.approx(statistics.median(groups[1]), rel=1e-12)
    assert exact_quantiles(df.where("k = 6"), [], "v", [0.5], bins, small).count() == 0


def test_quantile_buffers_stay_small(spark):
    """No task of the selection holds more distinct values of a group than `small` or `bins`."""
    df = spark.range(40_000).selectExpr("1 AS k", "hash(id) * 1.0D AS v")
    plan = exact_quantiles(df, ["k"], "v", [0.5], bins=64, small=500)
    assert plan.first().q[0] == pytest.approx(float(np.median([row.v for row in df.collect()])))
    listed = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in listed  # over intervals of at most 500 rows, which the next line shows
    from sensorloom.operators import select

    seen = []
    kept = select.kept
    select.kept = lambda t: seen.append(kept(t)) or seen[-1]
    try:
        exact_quantiles(df, ["k"], "v", [0.5], bins=64, small=500).collect()
    finally:
        select.kept = kept
    inside = [max(r.inside for r in t.collect()) for t in seen if "inside" in t.columns]
    assert inside[-1] <= 500 and inside == sorted(inside, reverse=True)


def test_windows_by_halo_chunks(spark):
    r = random.Random(5)
    rows = [(i, r.choice([1, 1, 1, 2]), r.choice([1, 2]), r.choice([1, 2, 3]), "a", i * 0.5, float(i), f"f{i}") for i in range(600)]
    runs = spark.createDataFrame(rows, "event_id long, subject_id int, activity_id int, run_id int, activity_name string, timestamp double, x double, source_file string")
    for size, stride in ((8, 4), (5, 7), (3, 1), (600, 1)):
        want, n = [], 0
        for key in sorted({(x[1], x[2], x[3]) for x in rows}):
            mine = [x for x in rows if x[1:4] == key]
            for s in range(0, len(mine) - size + 1, stride):
                cut = mine[s : s + size]
                want.append((n, *key, s, s + size - 1, cut[0][5], cut[-1][5], cut[0][7], [x[6] for x in cut]))
                n += 1
        for options in ({}, {"chunk": 1}, {"segment_rows": 50}):
            got = windows.sliding_windows(runs, ["x"], size, stride, ["timestamp", "event_id"], **options).orderBy("window_id").collect()
            assert [(w.window_id, w.subject_id, w.activity_id, w.run_id, w.start_index, w.end_index, w.start_timestamp, w.end_timestamp, w.source_file, list(w.w[0])) for w in got] == want
