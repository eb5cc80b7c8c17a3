"""Similarity of real and synthetic windows: distributions, moments, distances, time warping, shapelets.

MDD, ACD, SD, KD and ED are DataFrame expressions; time warping and shapelets have no such
form and run as numpy kernels over Arrow batches, a pair or an activity at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.schemas import OVERALL


def cells(windows: DataFrame, *keys: str) -> DataFrame:
    """activity_name, window_id, c, t, v of windows with w."""
    long = windows.select("activity_name", "window_id", *keys, F.posexplode("w").alias("c", "s"))
    return long.select("activity_name", "window_id", *keys, "c", F.posexplode("s").alias("t", "v"))


def both(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Cells of the activities that both sides have, tagged with side."""
    common = real.select("activity_name").intersect(synthetic.select("activity_name"))
    tagged = cells(real).withColumn("side", F.lit("real")).unionByName(cells(synthetic).withColumn("side", F.lit("synthetic")))
    return tagged.join(common, "activity_name", "left_semi")


def mdd(real: DataFrame, synthetic: DataFrame, bins: int = 50) -> DataFrame:
    """Marginal distribution difference: mean absolute difference of densities over equal bins.

    Bins lie between the real values' extremes of each channel and time step (the first step
    is left out when there are more); synthetic values outside count in the total only. A
    value within rounding of an inner edge may fall on either side of it.
    """
    x = both(real, synthetic)
    last = x.agg(F.max("t")).first()[0] or 0
    x = x.where("t > 0") if last > 0 else x
    is_real = F.col("side") == "real"
    edges = x.groupBy("activity_name", "c", "t").agg(F.min(F.when(is_real, F.col("v"))).alias("lo"), F.max(F.when(is_real, F.col("v"))).alias("top"), F.count_if(is_real).alias("n_real"), F.count_if(~is_real).alias("n_synthetic"))
    edges = edges.withColumn("hi", F.when(F.abs(F.col("top") - F.col("lo")) <= 1e-8 + 1e-5 * F.abs("lo"), F.col("lo") + 1e-5).otherwise(F.col("top")))
    width = (F.col("hi") - F.col("lo")) / bins
    inside = x.join(edges, ["activity_name", "c", "t"]).where(F.col("v").between(F.col("lo"), F.col("hi")))
    binned = inside.withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)))
    counts = binned.groupBy("activity_name", "c", "t", "bin", "n_real", "n_synthetic", "lo", "hi").agg(F.count_if(is_real).alias("a"), F.count_if(~is_real).alias("b"))
    gap = F.abs(F.col("a") / F.col("n_real") - F.col("b") / F.col("n_synthetic")) / width
    per = counts.groupBy("activity_name", "c", "t").agg((F.sum(gap) / bins).alias("d"))
    return per.groupBy("activity_name").agg(F.avg("d").alias("MDD"))


def _by_side(x: DataFrame, *aggs) -> DataFrame:
    return x.groupBy("activity_name", "side", "c").agg(*aggs)


def _difference(stats: DataFrame, name: str) -> DataFrame:
    wide = stats.groupBy("activity_name", "c").agg(F.max(F.when(F.col("side") == "real", F.col("s"))).alias("a"), F.max(F.when(F.col("side") == "synthetic", F.col("s"))).alias("b"))
    return wide.groupBy("activity_name").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias(name))


def skewness_difference(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Third central moment over the cubed sample deviation, channel by channel."""
    n = F.count("v")
    return _difference(_by_side(both(real, synthetic), (F.skewness("v") * F.pow((n - 1) / n, F.lit(1.5))).alias("s")), "SD")


def kurtosis_difference(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Excess population kurtosis, channel by channel."""
    return _difference(_by_side(both(real, synthetic), F.kurtosis("v").alias("s")), "KD")


def autocorrelation_difference(real: DataFrame, synthetic: DataFrame, max_lag: int = 32) -> DataFrame:
    """L2 distance over lags of the channels' autocorrelations, mean over channels.

    Lags below min(max_lag, T); a lag is the mean over windows and steps of centred products
    over the variance, which counts as one when it is next to nothing.
    """
    common = real.select("activity_name").intersect(synthetic.select("activity_name"))
    rows = [w.select("activity_name", F.lit(side).alias("side"), F.posexplode("w").alias("c", "x")) for w, side in ((real, "real"), (synthetic, "synthetic"))]
    x = rows[0].unionByName(rows[1]).join(common, "activity_name", "left_semi")
    moments = _by_side(x.select("activity_name", "side", "c", F.explode("x").alias("v")), F.avg("v").alias("mu"), F.var_pop("v").alias("var"))
    # moments have a row for each activity, side and channel
    series = x.join(F.broadcast(moments), ["activity_name", "side", "c"]).withColumn("y", F.expr("transform(x, v -> v - mu)"))
    lagged = series.withColumn("lag", F.explode(F.expr(f"sequence(0, least({max_lag}, size(y)) - 1)")))
    product = F.expr("aggregate(zip_with(slice(y, 1, size(y) - lag), slice(y, lag + 1, size(y) - lag), (a, b) -> a * b), 0D, (a, v) -> a + v)")
    lagged = lagged.withColumn("sum", product).withColumn("n", F.size("y") - F.col("lag"))
    acf = lagged.groupBy("activity_name", "side", "c", "lag").agg(F.sum("sum").alias("p"), F.sum("n").alias("n"), F.first("var").alias("var"))
    acf = acf.withColumn("s", F.col("p") / F.col("n") / F.when(F.abs("var") <= 1e-8, 1.0).otherwise(F.col("var")))
    wide = acf.groupBy("activity_name", "c", "lag").agg(F.max(F.when(F.col("side") == "real", F.col("s"))).alias("a"), F.max(F.when(F.col("side") == "synthetic", F.col("s"))).alias("b"))
    per = wide.groupBy("activity_name", "c").agg(F.sqrt(F.sum((F.col("a") - F.col("b")) ** 2)).alias("d"))
    return per.groupBy("activity_name").agg(F.avg("d").alias("ACD"))


def pair_distances(pairs: DataFrame) -> DataFrame:
    """ed of each pair (r, s): Euclidean over time, mean over channels."""
    per = F.zip_with("r", "s", lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, d: t + d)))
    return pairs.withColumn("ed", F.aggregate(per, F.lit(0.0), lambda t, d: t + d) / F.size("r"))


def ed(pairs: DataFrame) -> DataFrame:
    return pair_distances(pairs).groupBy("activity_name").agg(F.avg("ed").alias("ED"))


def dtw(a: np.ndarray, b: np.ndarray, window: int | None = None) -> float:
    """Time-warping distance of two series (time by channel) with L2 steps inside a Sakoe-Chiba band.

    The table is filled by anti-diagonals, whose cells do not depend on each other.
    """
    a, b = (np.asarray(x, np.float64).reshape(len(x), -1) for x in (a, b))
    n, m = len(a), len(b)
    band = max(n, m) if window is None else max(window, abs(n - m))
    cost = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    two, one = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    two[0] = 0.0
    for k in range(2, n + m + 1):
        i = np.arange(max(1, k - m), min(n, k - 1) + 1)
        i = i[np.abs(2 * i - k) <= band]
        now = np.full(n + 1, np.inf)
        now[i] = cost[i - 1, k - i - 1] + np.minimum(np.minimum(one[i - 1], one[i]), two[i - 1])
        two, one = one, now
    return float(one[n])


def autocorrelation(x: np.ndarray, max_lag: int) -> np.ndarray:
    """Lag products of a centred series over its sum of squares."""
    y = np.asarray(x, np.float64) - np.mean(x)
    whole = float(y @ y)
    lags = range(min(max_lag, len(y)))
    return np.array([float(y[: len(y) - k] @ y[k:]) / whole if whole > 0 else 1.0 for k in lags])


def _stack(windows) -> np.ndarray:
    """Windows (channel by time lists) as samples by time by channel."""
    return np.stack([np.stack([np.asarray(c, np.float64) for c in w], axis=1) for w in windows])


def pair_warps(pairs: DataFrame, window: int | None = None) -> DataFrame:
    """dtw of each pair (r, s); a pair is one row, so Arrow batches spread them freely."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = [dtw(np.stack(list(r), axis=1), np.stack(list(s), axis=1), window) for r, s in zip(pdf["r"], pdf["s"], strict=True)]
            yield pdf.drop(columns=["r", "s"]).assign(dtw=np.array(d, np.float64))

    keys = [c for c in pairs.columns if c not in ("r", "s")]
    schema = pairs.select(*keys).schema.add("dtw", "double")
    return pairs.repartition("activity_name", "rn").mapInPandas(run, schema)


def warp(pairs: DataFrame, window: int | None = None) -> DataFrame:
    return pair_warps(pairs, window).groupBy("activity_name").agg(F.avg("dtw").alias("DTW"))


def _rebuilt(shapes: np.ndarray, gain: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
    """Sums of the shapes at their offsets, a row a series."""
    count, length = shapes.shape
    place = at[:, :, None] + np.arange(length)
    series = np.broadcast_to(np.arange(len(gain))[:, None, None], place.shape)
    out = np.zeros((len(gain), steps))
    np.add.at(out, (series, place), gain[:, :, None] * shapes)
    return out


def _encode(x: np.ndarray, shapes: np.ndarray, gain: np.ndarray, at: np.ndarray, penalty: float, sweeps: int, epsilon: float) -> float:
    """Sparse codes of all series at once, by coordinate descent over the shapes in place; the objective.

    With the other shapes taken off, a shape goes where it correlates most with what is left
    of a series, with the soft-thresholded least-squares gain. Each series is done when its own
    objective settles, so codes do not depend on the series beside it.
    """
    length, energy = shapes.shape[1], np.maximum((shapes**2).sum(axis=1), 1e-12)
    reach = np.arange(length)
    left, before, live = x - _rebuilt(shapes, gain, at, x.shape[1]), np.full(len(x), np.inf), np.arange(len(x))
    for _ in range(sweeps):
        rest, g, o = left[live], gain[live], at[live]
        rows = np.arange(len(live))
        for k in range(len(shapes)):
            rest[rows[:, None], o[:, k, None] + reach] += g[:, k, None] * shapes[k]
            match = np.lib.stride_tricks.sliding_window_view(rest, length, axis=1) @ shapes[k]
            o[:, k] = np.abs(match).argmax(axis=1)
            top = match[rows, o[:, k]]
            g[:, k] = np.sign(top) * np.maximum(np.abs(top) - penalty, 0.0) / energy[k]
            rest[rows[:, None], o[:, k, None] + reach] -= g[:, k, None] * shapes[k]
        left[live], gain[live], at[live] = rest, g, o
        now = 0.5 * (rest**2).sum(axis=1) + penalty * np.abs(g).sum(axis=1)
        going = before[live] - now > epsilon * before[live]
        going |= np.isinf(before[live])
        before[live] = now
        live = live[going]
        if not len(live):
            break
    return float(before.sum())


def _refit(x: np.ndarray, shapes: np.ndarray, gain: np.ndarray, at: np.ndarray, bound: float) -> None:
    """Each shape as the least-squares fit to what the others leave of the series, its squared norm at most bound."""
    rows, reach = np.arange(len(x))[:, None], np.arange(shapes.shape[1])
    left = x - _rebuilt(shapes, gain, at, x.shape[1])
    for k in np.flatnonzero((gain**2).sum(axis=0) > 0):
        span = at[:, k, None] + reach
        left[rows, span] += gain[:, k, None] * shapes[k]
        fitted = gain[:, k] @ left[rows, span] / (gain[:, k] @ gain[:, k])
        shapes[k] = fitted * min(1.0, np.sqrt(bound / max(float(fitted @ fitted), 1e-300)))
        left[rows, span] -= gain[:, k, None] * shapes[k]


def shapelet_error(real: np.ndarray, synthetic: np.ndarray, seed: int = 42, count: int = 20, penalty: float = 0.1, ratio: float = 0.25, c: float = 100.0, epsilon: float = 1e-5, rounds: int = 1000, inner: int = 5, mode: str = "mean") -> float:
    """Mean squared error (halved) of synthetic windows coded with shapelets learnt on real ones; samples by time by channel.

    Shift-invariant dictionary learning: shapes start as pieces of real series, then sparse
    coding and least-squares refits take turns until the objective settles.
    """
    if mode == "per_channel":
        return float(np.nanmean([shapelet_error(real[:, :, [i]], synthetic[:, :, [i]], seed + i, count, penalty, ratio, c, epsilon, rounds, inner) for i in range(real.shape[2])]))
    if mode != "mean":
        raise ValueError(f"unknown channel mode: {mode}")
    if not len(real) or not len(synthetic):
        return float("nan")
    train, test = real.mean(axis=2), synthetic.mean(axis=2)
    length = max(1, min(int(np.ceil(train.shape[1] * ratio)), train.shape[1]))
    pieces = np.lib.stride_tricks.sliding_window_view(train, length, axis=1).reshape(-1, length)
    rng = np.random.default_rng(seed)
    shapes = pieces[rng.integers(0, len(pieces), count)] + rng.normal(0, 1e-3, (count, length))
    gain, at, before = np.zeros((len(train), count)), np.zeros((len(train), count), np.int64), np.inf
    for _ in range(rounds):
        now = _encode(train, shapes, gain, at, penalty, inner, epsilon)
        _refit(train, shapes, gain, at, c)
        if np.isfinite(before) and before - now <= epsilon * before:
            break
        before = now
    gain, at = np.zeros((len(test), count)), np.zeros((len(test), count), np.int64)
    _encode(test, shapes, gain, at, penalty, rounds, epsilon)
    return float(0.5 * ((test - _rebuilt(shapes, gain, at, test.shape[1])) ** 2).sum() / len(test))


def shapelets(pairs: DataFrame, max_samples: int | None = None, **options) -> DataFrame:
    """SHR of each activity's sampled pairs; the pairs of an activity, capped when sampled, meet in one task."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn").head(max_samples) if max_samples else pdf.sort_values("rn")
        return pd.DataFrame({"activity_name": [key[0]], "SHR": [shapelet_error(_stack(pdf["r"]), _stack(pdf["s"]), **options)]})

    return pairs.select("activity_name", "rn", "r", "s").groupBy("activity_name").applyInPandas(run, "activity_name string, SHR double")


def with_overall(metrics: DataFrame, means: list[str], sums: list[str]) -> DataFrame:
    """The activity rows and one more with their plain means and summed counts; NaN is skipped."""
    clean = metrics.withColumns({m: F.when(~F.isnan(m), F.col(m)) for m in means})
    row = clean.agg(*[F.avg(m).alias(m) for m in means], *[F.sum(s).alias(s) for s in sums]).withColumn("activity_name", F.lit(OVERALL))
    return clean.unionByName(row.select(*clean.columns))


def similarity(real: DataFrame, synthetic: DataFrame, pairs: DataFrame, max_lag: int = 32, bins: int = 50, dtw_window: int | None = None, shr: dict | None = None, shr_of=shapelets) -> DataFrame:
    """All metrics of the sampled pairs by activity, with the overall row; SHR is null unless asked for.

    shr_of learns and scores the shapes: `shapelets` for sampled pairs, `dictionary.shapelets` for any number.
    """
    once = pairs.persist()
    r = once.select("activity_name", F.col("r_id").alias("window_id"), F.col("r").alias("w"))
    s = once.select("activity_name", F.col("s_id").alias("window_id"), F.col("s").alias("w"))
    out = once.groupBy("activity_name").agg(F.count("*").alias("num_real"), F.count("*").alias("num_synthetic"))
    parts = [mdd(r, s, bins), autocorrelation_difference(r, s, max_lag), skewness_difference(r, s), kurtosis_difference(r, s), ed(once), warp(once, dtw_window)]
    if shr is not None:
        parts.append(shr_of(once, **shr))
    for p in parts:
        out = out.join(p, "activity_name", "left")
    if shr is None:
        out = out.withColumn("SHR", F.lit(None).cast("double"))
    return with_overall(out, ["MDD", "ACD", "SD", "KD", "ED", "DTW", "SHR"], ["num_real", "num_synthetic"])


def prototypes(windows: DataFrame) -> DataFrame:
    """activity_name, w: the mean window of each activity, cell by cell."""
    per = cells(windows).groupBy("activity_name", "c", "t").agg(F.avg("v").alias("v"))
    series = per.groupBy("activity_name", "c").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("s"))
    return series.groupBy("activity_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", F.col("s.v").alias("v")))), lambda x: x["v"]).alias("w"))


def channel_means(per_channel: DataFrame, metric: str) -> DataFrame:
    """The plain mean of a metric over the channels of each activity."""
    return per_channel.groupBy("activity_name").agg(F.avg(metric).alias(metric))
