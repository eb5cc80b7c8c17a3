"""Shapelet dictionaries learnt on any number of windows, without an activity in one task.

The learner is that of `metrics.shapelet_error`: series are coded with the shapes, then shapes are
refitted, in turn until the objective settles. Here series and their codes stay in blocks.
A round codes each block with the shapes of its activity and adds up what the refit needs
of the codes: for each shape the gain-weighted pieces of the series under it, and for each two
shapes and each shift between them the sum of products of their gains. These sums have a size
that the settings give, shapes times length and shapes squared times shifts, whatever the
number of windows; from them the driver solves the same least-squares updates in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.metrics import _encode, _rebuilt, _stack
from sensorloom.tables import kept

BLOCK = "activity_name string, channel int, x binary, gain binary, at binary"
SERIES = 1024  # in a block


def _sums(x: np.ndarray, gain: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Pieces under each shape, then products of gains by pair of shapes and shift, in one row."""
    n, count = gain.shape
    pieces = np.lib.stride_tricks.sliding_window_view(x, length, axis=1)
    under = np.stack([gain[:, k] @ pieces[np.arange(n), at[:, k]] for k in range(count)])
    shift = at[:, None, :] - at[:, :, None]
    near = np.abs(shift) < length
    pair = (np.arange(count)[:, None] * count + np.arange(count)) * (2 * length - 1)
    where = (pair + shift + length - 1)[near]
    products = np.bincount(where, (gain[:, :, None] * gain[:, None, :])[near], count * count * (2 * length - 1))
    return np.concatenate([under.ravel(), products])


def _refit(shapes: np.ndarray, sums: np.ndarray, bound: float) -> None:
    """Each shape in turn as the least-squares fit to what the others leave, from the sums; its squared norm at most bound."""
    count, length = shapes.shape
    under, products = sums[: count * length].reshape(count, length), sums[count * length :].reshape(count, count, 2 * length - 1)
    for k in range(count):
        weight = products[k, k, length - 1]
        if weight > 0:
            # what shape j puts under shape k is its values at each shift, weighted by the products of gains
            others = sum(np.convolve(products[k, j], shapes[j])[length - 1 : 2 * length - 1] for j in range(count) if j != k)
            fitted = (under[k] - others) / weight
            shapes[k] = fitted * min(1.0, np.sqrt(bound / max(float(fitted @ fitted), 1e-300)))


def _series(windows, channel: int) -> np.ndarray:
    stack = _stack(windows)
    return stack.mean(axis=2) if channel < 0 else stack[:, :, channel]


def shapelets(pairs: DataFrame, max_samples: int | None = None, seed: int = 42, count: int = 20, penalty: float = 0.1, ratio: float = 0.25, c: float = 100.0, epsilon: float = 1e-5, rounds: int = 1000, inner: int = 5, mode: str = "mean") -> DataFrame:
    """activity_name, SHR: the mean squared error (halved) of synthetic windows coded with shapes learnt on the real ones.

    pairs: activity_name, rn from 1 in each activity, r, s as `split.pair_windows` makes them. `per_channel` learns on each channel
    and averages, `mean` on the mean of the channels. No pairs give no rows.
    """
    if mode not in ("mean", "per_channel"):
        raise ValueError(f"unknown channel mode: {mode}")
    pairs = kept((pairs if max_samples is None else pairs.where(F.col("rn") <= max_samples)).select("activity_name", "rn", "r", "s"))
    first = pairs.select(F.size("r").alias("c"), F.size(F.col("r")[0]).alias("t")).first()
    if first is None:
        return pairs.sparkSession.createDataFrame([], "activity_name string, SHR double")
    channels = [-1] if mode == "mean" else list(range(first.c))
    length = max(1, min(int(np.ceil(first.t * ratio)), first.t))
    sizes = {r.activity_name: r.n for r in pairs.groupBy("activity_name").agg(F.count("*").alias("n")).collect()}
    shapes = _starts(pairs, sizes, channels, first.t, length, count, seed)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for activity, group in pdf.groupby("activity_name"):
                for s in range(0, len(group), SERIES):
                    for ch in channels:
                        x = _series(group["r"].iloc[s : s + SERIES], ch)
                        yield pd.DataFrame({"activity_name": [activity], "channel": [ch], "x": [x.tobytes()], "gain": [np.zeros((len(x), count)).tobytes()], "at": [np.zeros((len(x), count), np.int64).tobytes()]})

    steps = first.t
    blocks = kept(pairs.select("activity_name", "r").mapInPandas(pack, BLOCK))
    before, moving = dict.fromkeys(shapes, np.inf), set(shapes)
    for _ in range(rounds):
        if not moving:
            break
        now = {k: shapes[k].copy() for k in moving}

        def code(batches: Iterator[pd.DataFrame], now: dict = now) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    if (row.activity_name, row.channel) in now:
                        x, gain, at = np.frombuffer(row.x).reshape(-1, steps), np.frombuffer(row.gain).reshape(-1, count).copy(), np.frombuffer(row.at, np.int64).reshape(-1, count).copy()
                        _encode(x, now[row.activity_name, row.channel], gain, at, penalty, inner, epsilon)
                        yield pd.DataFrame({"activity_name": [row.activity_name], "channel": [row.channel], "x": [row.x], "gain": [gain.tobytes()], "at": [at.tobytes()]})

        def add(batches: Iterator[pd.DataFrame], now: dict = now) -> Iterator[pd.DataFrame]:
            held: dict = {}
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    key = (row.activity_name, row.channel)
                    x, gain, at = np.frombuffer(row.x).reshape(-1, steps), np.frombuffer(row.gain).reshape(-1, count), np.frombuffer(row.at, np.int64).reshape(-1, count)
                    cost = 0.5 * ((x - _rebuilt(now[key], gain, at, steps)) ** 2).sum() + penalty * np.abs(gain).sum()
                    held[key] = held.get(key, 0) + np.append(_sums(x, gain, at, length), cost)
            for (activity, channel), v in held.items():
                yield pd.DataFrame({"activity_name": activity, "channel": channel, "i": np.arange(len(v)), "v": v})

        blocks = kept(blocks.mapInPandas(code, BLOCK))
        total = blocks.mapInPandas(add, "activity_name string, channel int, i int, v double").groupBy("activity_name", "channel", "i").agg(F.sum("v").alias("v")).toPandas()
        for key, group in total.sort_values("i").groupby(["activity_name", "channel"]):
            v = group["v"].to_numpy()
            _refit(shapes[key], v[:-1], c)
            if before[key] - v[-1] <= epsilon * before[key] and np.isfinite(before[key]):
                moving.discard(key)
            before[key] = v[-1]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for activity, group in pdf.groupby("activity_name"):
                for ch in channels:
                    x, d = _series(group["s"], ch), shapes[activity, ch]
                    gain, at = np.zeros((len(x), count)), np.zeros((len(x), count), np.int64)
                    _encode(x, d, gain, at, penalty, rounds, epsilon)
                    error = 0.5 * ((x - _rebuilt(d, gain, at, x.shape[1])) ** 2).sum()
                    yield pd.DataFrame({"activity_name": [activity], "channel": [ch], "error": [error], "n": [len(x)]})

    errors = pairs.select("activity_name", "s").mapInPandas(score, "activity_name string, channel int, error double, n long")
    per = errors.groupBy("activity_name", "channel").agg((F.sum("error") / F.sum("n")).alias("e"))
    return per.groupBy("activity_name").agg(F.avg("e").alias("SHR"))


def _starts(pairs: DataFrame, sizes: dict[str, int], channels: list[int], steps: int, length: int, count: int, seed: int) -> dict[tuple[str, int], np.ndarray]:
    """Start shapes of each activity and channel: random pieces of random real series, with a little noise; the driver reads `count` series of each."""
    offsets = steps - length + 1
    drawn: dict = {}
    for activity, n in sizes.items():
        for ch in channels:
            rng = np.random.default_rng(seed + max(ch, 0))
            drawn[activity, ch] = (rng.integers(0, n * offsets, count), rng.normal(0, 1e-3, (count, length)))
    wanted = pd.DataFrame([(a, int(i // offsets) + 1) for (a, _), (at, _) in drawn.items() for i in at], columns=["activity_name", "rn"]).drop_duplicates()
    spark = pairs.sparkSession
    found = pairs.join(F.broadcast(spark.createDataFrame(wanted, "activity_name string, rn long")), ["activity_name", "rn"]).select("activity_name", "rn", "r").collect()
    series = {(r.activity_name, r.rn): r.r for r in found}
    out = {}
    for (activity, ch), (at, noise) in drawn.items():
        rows = [_series([series[activity, int(i // offsets) + 1]], ch)[0][i % offsets : i % offsets + length] for i in at.tolist()]
        out[activity, ch] = np.stack(rows) + noise
    return out
