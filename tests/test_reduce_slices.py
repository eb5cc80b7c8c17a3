import tracemalloc

import numpy as np
import pyarrow as pa

from sensorloom.operators import reduce


def test_transforms_take_a_batch_in_slices():
    """3000 windows of 4 x 256 in one batch: the same numbers there and back, with a fraction of the batch held beside it."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4, 256))
    w = pa.ListArray.from_arrays(pa.array(np.arange(3001, dtype=np.int32) * 4), pa.ListArray.from_arrays(pa.array(np.arange(12001, dtype=np.int32) * 256), pa.array(x.ravel())))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), w], names=["window_id", "w"])
    base = {"pre_mean": 0.5, "pre_scale": 2.0, "scaler_mean": np.zeros(256), "scaler_scale": np.full(256, 3.0), "latent_mean": np.zeros(256), "mixing": None, "n_components": 256, "components": np.eye(256)}
    rows = [{**base, "channel_index": c} for c in (2, 0)]
    tracemalloc.start()
    parts, most = [], 0
    for out in reduce.projected(iter([batch]), rows, ["window_id"]):
        most, parts = max(most, out.num_rows), [*parts, out]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < most <= reduce.CELLS // 1024 and sum(p.num_rows for p in parts) == 3000
    values = np.concatenate([np.array(p["values"].to_pylist()) for p in parts])
    assert np.allclose(values, np.hstack([x[:, 2], x[:, 0]]) / 6 - 0.5 / 6)
    back = pa.Table.from_batches(reduce.restored(iter(parts), rows, ["window_id"], True))
    assert back["window_id"].to_pylist() == list(range(3000)) and np.allclose(np.array(back["w"].to_pylist()), x[:, [2, 0]])
    assert peak < batch.nbytes * 3  # the values of all slices are held here by the test


def test_a_pass_of_the_rotation_has_no_shuffle(spark, monkeypatch):
    """Each step's plan is a scan and a map; sums meet over several partitions."""
    rng = np.random.default_rng(5)
    z = rng.laplace(size=(400, 3))
    frame = spark.createDataFrame([(0, bytearray(z[i : i + 50].tobytes())) for i in range(0, 400, 50)], "channel_index int, z binary").repartition(4).localCheckpoint()
    plans, collect = [], type(frame).collect
    monkeypatch.setattr(type(frame), "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    monkeypatch.setattr(type(frame), "toPandas", lambda df, to=type(frame).toPandas: plans.append(df._jdf.queryExecution().executedPlan().toString()) or to(df))
    w = reduce.rotations(frame, {0: (400, 3)}, max_iter=6)[0]
    assert np.allclose(w @ w.T, np.eye(3)) and plans and not any("Exchange" in p for p in plans)
