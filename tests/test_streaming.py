import random

import pytest

from sensorloom.streaming import runs

SCHEMA = "ts timestamp, user_id long, event_type string, value double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(PROVIDER)


def expected(rows, size, stride, gap):
    out = []
    for key in sorted({r[1:3] for r in rows}):
        mine = sorted((r[0], r[3]) for r in rows if r[1:3] == key)
        run = []
        for t, v in [*mine, (float("inf"), 0.0)]:
            if run and (t <= run[-1][0] or t - run[-1][0] > gap):
                for s in range(0, len(run) - size + 1, stride):
                    part = run[s : s + size]
                    out.append((*key, part[0][0], part[-1][0], round(sum(x for _, x in part) / size, 9)))
                run = []
            run.append((t, v))
    return sorted(out)


def written(spark, path, rows):
    df = spark.createDataFrame([(float(t), u, e, v) for t, u, e, v in rows], "t double, user_id long, event_type string, value double")
    df.selectExpr("timestamp_micros(cast(round(t * 1e6) as long)) AS ts", "user_id", "event_type", "value").coalesce(1).write.mode("append").parquet(path)


def through(spark, source, out, checkpoint, size, stride, gap, late):
    stream = runs.stream_ordered_windows(runs.read_events(spark, source, spark.createDataFrame([], SCHEMA).schema), size, stride, gap, late)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()
    q.processAllAvailable()
    progress = q.recentProgress
    q.stop()
    return progress


def found(spark, out):
    return sorted((r.user_id, r.event_type, r.start_ts, r.end_ts, round(r["mean"], 9)) for r in spark.read.parquet(out).collect())


def test_out_of_order_rows_restart_and_expiry(spark, rocksdb, tmp_path):
    r = random.Random(4)
    rows, at = [], 1_700_000_000.0
    for _ in range(240):
        at += r.choice([1.0, 1.0, 2.0, 30.0])
        rows.append((at, r.choice([1, 2]), r.choice("ab"), float(r.randrange(100))))
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    batches = [rows[i : i + 40] for i in range(0, 240, 40)]
    for b in batches[:3]:
        written(spark, source, r.sample(b, len(b)))  # arrival within a file is in no order
    through(spark, source, out, checkpoint, 4, 2, 60.0, "0 seconds")
    before = found(spark, out)
    for b in batches[3:]:
        written(spark, source, r.sample(b, len(b)))
    written(spark, source, [(at + 10_000, 9, "z", 0.0)])
    written(spark, source, [(at + 20_000, 9, "z", 0.0)])
    progress = through(spark, source, out, checkpoint, 4, 2, 60.0, "0 seconds")  # a second run from the checkpoint of the first
    want = expected(rows, 4, 2, 60.0)
    got = found(spark, out)
    assert got == want and 0 < len(before) < len(want) and set(before) <= set(got)
    # all keys but the last one's are idle: their state has expired
    assert progress[-1].stateOperators[0].numRowsTotal <= 4


def test_late_rows_are_dropped(spark, rocksdb, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    base = 1_700_000_000.0
    rows = [(base + i, 1, "a", float(i)) for i in range(8)]
    written(spark, source, rows)
    written(spark, source, [(base + 100, 1, "a", 0.0)])  # moves the watermark on
    through(spark, source, out, checkpoint, 4, 2, 10.0, "5 seconds")
    written(spark, source, [(base + 3.5, 1, "a", 99.0), (base + 98, 1, "a", 1.0)])  # the first is too late, the second is not
    written(spark, source, [(base + 500, 2, "b", 0.0)])
    written(spark, source, [(base + 600, 2, "b", 0.0)])
    through(spark, source, out, checkpoint, 4, 2, 10.0, "5 seconds")
    assert found(spark, out) == expected(rows, 4, 2, 10.0)
