"""Per-channel PCA and FastICA of windows: fit, transform, inverse.

Means, scales, covariances and so all of PCA and the whitening of FastICA come from sums
over all training windows, added up row by row of the matrices; what reaches the driver
has the size of a window squared for each channel, whatever the number of windows. The
rotation of FastICA takes all windows too: they are whitened and packed once, and each step of
the fixed-point iteration is a pass that adds up, for each channel, matrices of the number of
components squared. The model is one small row a channel. The transform works on rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.tables import kept

VECTOR = T.ArrayType(T.DoubleType())
#: Numbers that a transform takes at a time.
CELLS = 1 << 18
# Fixed values of the run files' `standardization`.
STANDARDIZATIONS = ("legacy_timepoint", "per_channel_train", "none", None)
MODEL = "channel_index int, channel_name string, method string, n_components int, pre_mean double, pre_scale double, scaler_mean array<double>, scaler_scale array<double>, components array<array<double>>, mixing array<array<double>>, latent_mean array<double>, explained_variance_ratio array<double>"


def _sums(arrays: DataFrame, key: str = "channel_index") -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """n, sum and summed outer product of the vectors x of each key, added up in the partitions and then by row of the matrix."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for pdf in batches:
            for k, group in pdf.groupby(key)["x"]:
                x = np.stack(group.to_list()).astype(np.float64)
                n, total, outer = held.get(k, (0, 0.0, 0.0))
                held[k] = [n + len(x), total + x.sum(axis=0), outer + x.T @ x]
        for k, (n, total, outer) in held.items():
            yield pd.DataFrame({key: k, "i": np.arange(len(total)), "n": n, "s": total, "o": list(outer)})

    def add(group, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [group[0]], "i": [group[1]], "n": [pdf["n"].sum()], "s": [pdf["s"].sum()], "o": [np.sum(np.stack(pdf["o"].to_list()), axis=0)]})

    schema = f"{key} int, i int, n long, s double, o array<double>"
    rows = arrays.mapInPandas(partial, schema).groupBy(key, "i").applyInPandas(add, schema).toPandas().sort_values([key, "i"])
    return {int(k): (int(g["n"].iloc[0]), g["s"].to_numpy(), np.stack(g["o"].to_list())) for k, g in rows.groupby(key)}


def components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(components, explained ratio) of a covariance; each component's largest loading is positive."""
    value, vec = np.linalg.eigh(cov)
    value, vec = np.maximum(value[::-1], 0), vec[:, ::-1][:, :k].T
    vec = vec * np.sign(vec[np.arange(len(vec)), np.abs(vec).argmax(axis=1)])[:, None]
    return vec, value[:k] / max(value.sum(), 1e-300)


def whitening(cov: np.ndarray, k: int) -> np.ndarray:
    """Rows that make the first k components, those that are not next to nothing, uncorrelated with variance one."""
    value, vec = np.linalg.eigh(cov)
    scale = np.sqrt(np.maximum(value[::-1], 0))
    k = int(min(k, (scale > 1e-7 * scale.max()).sum())) or 1
    return vec[:, ::-1][:, :k].T / np.maximum(scale[:k], 1e-300)[:, None]


def _orthogonal(w: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(w)
    return u @ vt


def _packed(series: DataFrame, made: dict[int, dict]) -> DataFrame:
    """Whitened windows (window by component, doubles) in a block for each channel and batch of rows, in the checkpoint folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c, group in pdf.groupby("channel_index")["x"]:
                r = made[int(c)]
                x = (np.stack(group.to_list()) - r["pre_mean"]) / r["pre_scale"]
                z = ((x - r["scaler_mean"]) / r["scaler_scale"]) @ r["whiten"].T
                yield pd.DataFrame({"channel_index": [int(c)], "z": [z.tobytes()]})

    return kept(series.mapInPandas(run, "channel_index int, z binary"))


def rotations(blocks: DataFrame, sizes: dict[int, tuple[int, int]], max_iter: int = 1000, tol: float = 1e-4, seed: int = 42) -> dict[int, np.ndarray]:
    """FastICA's rotation of each channel's whitened windows: parallel fixed-point iteration with a log-cosh contrast.

    blocks: (channel_index, z) with z the bytes of windows by components; sizes: windows and components
    of each channel. A step is one pass over the blocks of the channels that still move. What a
    channel moves should shrink; where it has not for eight steps, as when the iteration goes
    to and fro between two rotations, its steps become half as long.
    """
    now = {c: _orthogonal(np.random.default_rng(seed).normal(size=(k, k))) for c, (_, k) in sizes.items()}
    pace = {c: (1.0, np.inf, 0) for c in sizes}  # length of a step, least move so far, steps since then
    moving = set(sizes)
    for _ in range(max_iter):
        if not moving:
            break
        turn = {c: now[c] for c in moving}

        def step(batches: Iterator[pa.RecordBatch], turn: dict[int, np.ndarray] = turn) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for c, raw in zip(batch.column("channel_index").to_pylist(), batch.column("z"), strict=True):
                    if c in turn:
                        w = turn[c]
                        z = np.frombuffer(raw.as_buffer()).reshape(-1, len(w))
                        g = np.tanh(z @ w.T)
                        sums[c] = sums.get(c, 0) + np.column_stack([g.T @ z, (1 - g**2).sum(axis=0)])
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=["channel_index", "m"])

        # a matrix for each partition and channel, so a pass is one stage without a shuffle
        total: dict[int, np.ndarray] = {}
        for r in blocks.mapInArrow(step, "channel_index int, m binary").collect():
            total[r.channel_index] = total.get(r.channel_index, 0) + np.frombuffer(r.m)
        for c, m in total.items():
            n, k = sizes[c]
            w, m = now[c], m.reshape(k, k + 1) / n
            fresh = _orthogonal(m[:, :k] - m[:, k:] * w)
            cosine = (fresh * w).sum(axis=1)
            moved = np.abs(np.abs(cosine) - 1).max()
            length, least, since = pace[c]
            least, since = (moved, 0) if moved < 0.9 * least else (least, since + 1)
            if since == 8:
                length, least, since = max(length / 2, 1 / 16), moved, 0
            pace[c] = length, least, since
            now[c] = fresh if length == 1 else _orthogonal((1 - length) * w + length * np.sign(cosine)[:, None] * fresh)
            if moved < tol:
                moving.discard(c)
    return now


def fit(windows: DataFrame, channels: list[str], method: str = "fastica", k: int = 3, standardization: str = "legacy_timepoint", max_iter: int = 1000, tol: float = 1e-4, seed: int = 42) -> DataFrame:
    """Model rows, one a channel, of training windows (window_id, w).

    standardization: `per_channel_train` scales each channel by one mean and deviation of all its training
    values before the scaling by time point; `legacy_timepoint` and `none` do not.
    """
    if standardization not in STANDARDIZATIONS:
        raise ValueError(f"unknown standardisation: {standardization}")
    if method not in ("pca", "fastica"):
        raise ValueError(f"unknown method: {method}")
    series = windows.select("window_id", F.posexplode("w").alias("channel_index", "x")).select("window_id", "channel_index", F.col("x").cast(VECTOR).alias("x"))
    made: dict[int, dict] = {}
    for c, (n, total, outer) in _sums(series.select("channel_index", "x")).items():
        mean, m, s = total / n, 0.0, 1.0
        if standardization == "per_channel_train":
            m = float(mean.mean())
            s = float(np.sqrt(max(np.trace(outer) / n / len(mean) - m * m, 0.0))) or 1.0
        cov = outer / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0.0)) / s
        sd[sd == 0] = 1.0
        made[c] = {"channel_index": c, "channel_name": channels[c], "method": method, "pre_mean": m, "pre_scale": s, "scaler_mean": (mean - m) / s, "scaler_scale": sd, "latent_mean": np.zeros(len(mean)), "cov": cov / np.outer(sd, sd) / s**2, "n": n}
    fields = [f.name for f in T.StructType.fromDDL(MODEL).fields]
    plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else v
    if method == "pca":
        for r in made.values():
            r["components"], r["explained_variance_ratio"] = components(r["cov"], min(k, r["n"], len(r["cov"])))
            r["n_components"] = len(r["components"])
        return windows.sparkSession.createDataFrame([tuple(plain(r.get(f)) for f in fields) for r in made.values()], MODEL)
    for r in made.values():
        r["whiten"] = whitening(r["cov"], min(k, r["n"], len(r["cov"])))
    turned = rotations(_packed(series, made), {c: (r["n"], len(r["whiten"])) for c, r in made.items()}, max_iter, tol, seed)
    for c, r in made.items():
        unmix = turned[c] @ r["whiten"]
        r |= {"n_components": len(unmix), "components": unmix, "mixing": np.linalg.pinv(unmix)}
    return windows.sparkSession.createDataFrame([tuple(plain(r.get(f)) for f in fields) for r in made.values()], MODEL)


def _rows(model: DataFrame) -> list[dict]:
    """The model on the driver: one row a channel, so its size does not grow with the windows."""
    rows = [r.asDict() for r in model.orderBy("channel_index").collect()]
    for r in rows:
        for c in ("scaler_mean", "scaler_scale", "components", "mixing", "latent_mean"):
            r[c] = None if r[c] is None else np.asarray(r[c], np.float64)
    return rows


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of equal length as rows of doubles."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, about CELLS numbers of the column at a time, so that a worker's memory does not grow with the batches."""
    for batch in batches:
        if batch.num_rows:
            rows = max(1, CELLS * batch.num_rows // max(batch.column(column).nbytes // 8, 1))
            yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def projected(batches: Iterator[pa.RecordBatch], rows: list[dict], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The keys and values of batches with w, under the model's rows."""
    for batch in _slices(batches, "w"):
        parts = []
        for r in rows:
            x = _matrix(pc.list_element(batch.column("w"), r["channel_index"]))
            x = ((x - r["pre_mean"]) / r["pre_scale"] - r["scaler_mean"]) / r["scaler_scale"]
            parts.append((x - r["latent_mean"]) @ r["components"].T)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], _lists(np.hstack(parts))], names=[*keys, "values"])


def restored(batches: Iterator[pa.RecordBatch], rows: list[dict], keys: list[str], undo_channel_scaler: bool) -> Iterator[pa.RecordBatch]:
    """The keys and w of batches with values, under the model's rows."""
    for batch in _slices(batches, "values"):
        v = _matrix(batch.column("values"))
        at, out = 0, []
        for r in rows:
            p = v[:, at : at + r["n_components"]]
            at += r["n_components"]
            x = p @ (r["components"] if r["mixing"] is None else r["mixing"].T) + r["latent_mean"]
            x = x * r["scaler_scale"] + r["scaler_mean"]
            out.append(x * r["pre_scale"] + r["pre_mean"] if undo_channel_scaler else x)
        ends = np.cumsum([0, *np.tile([x.shape[1] for x in out], len(v))], dtype=np.int32)
        series = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.hstack(out).ravel()))
        w = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(out)), series)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], w], names=[*keys, "w"])


def transform(windows: DataFrame, model: DataFrame) -> DataFrame:
    """The windows' columns, w replaced by values: all channels' components in order."""
    rows, keys = _rows(model), [c for c in windows.columns if c != "w"]
    return windows.mapInArrow(lambda batches: projected(batches, rows, keys), windows.select(*keys).schema.add("values", VECTOR))


def inverse(embeddings: DataFrame, model: DataFrame, undo_channel_scaler: bool = True) -> DataFrame:
    """The embeddings' columns, values replaced by w; the channel scaler stays applied when asked."""
    rows, keys = _rows(model), [c for c in embeddings.columns if c != "values"]
    return embeddings.mapInArrow(lambda batches: restored(batches, rows, keys, undo_channel_scaler), embeddings.select(*keys).schema.add("w", T.ArrayType(VECTOR)))


def expand_values(df: DataFrame, width: int) -> DataFrame:
    """values as columns value_0 ... value_{width-1}."""
    return df.select(*[c for c in df.columns if c != "values"], *[F.col("values")[i].cast("float").alias(f"value_{i}") for i in range(width)])


def summary(model: DataFrame) -> DataFrame:
    return model.agg(F.sum("n_components").alias("total_components"), F.max(F.size("scaler_mean")).alias("window_size"), F.array_sort(F.collect_list(F.struct("channel_index", "channel_name", "n_components"))).alias("channels"))


def compact(windows: DataFrame, k: int = 8, method: str = "pca", seed: int = 42) -> DataFrame:
    """Whole windows flattened to one series and reduced to k components, as values; each is the projection of the centred window."""
    if windows.isEmpty():
        return windows.drop("w").withColumn("values", F.array().cast("array<double>"))
    flat = windows.withColumn("w", F.array(F.flatten("w")))
    model = fit(flat, ["all"], method, k, "none", seed=seed)
    return transform(flat, model)


def compact_pca(windows: DataFrame, k: int = 8) -> DataFrame:
    """Whole windows flattened and projected on their first k principal components, without scaling.

    The covariance is a sum over rows of outer products; one matrix of the window's width reaches the driver.
    """
    flat = windows.withColumn("__x", F.flatten("w").cast(VECTOR))
    sums = _sums(flat.select(F.lit(0).alias("channel_index"), F.col("__x").alias("x")))
    if not sums:
        return windows.drop("w").withColumn("values", F.array().cast("array<double>"))
    n, total, outer = sums[0]
    mean = total / n
    comp, _ = components(outer / n - np.outer(mean, mean), min(k, n, len(mean)))
    keys = windows.drop("w").columns

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["__x"].to_list()).astype(np.float64) if len(pdf) else np.zeros((0, len(mean)))
            yield pdf[keys].assign(values=list((x - mean) @ comp.T))

    return flat.drop("w").mapInPandas(project, windows.drop("w").schema.add("values", VECTOR))
