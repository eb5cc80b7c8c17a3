"""Aggregates: window features, durations, rollups, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(x: Column, size: Column) -> dict[str, Column]:
    """mean, population std, min, max, slope, energy of an array of doubles."""
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / size
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / size
    spread = F.sqrt(F.aggregate(F.transform(x, lambda v: v - mean), F.lit(0.0), lambda a, v: a + v * v) / size)
    slope = (F.element_at(x, -1) - x[0]) / F.greatest(size - 1, F.lit(1))
    return {"mean": mean, "std": spread, "min": F.array_min(x), "max": F.array_max(x), "slope": slope, "energy": square}


def _wide(windows: DataFrame, keys: list[str], names: list[str], stats: tuple[str, ...], pattern: str) -> DataFrame:
    cols = []
    for i, c in enumerate(names):
        x = F.transform(F.col("w")[i], lambda v: v.cast("double"))
        m = moments(x, F.size(F.col("w")[i]))
        cols += [m[s].alias(pattern.format(channel=c, stat=s)) for s in stats]
    return windows.select(*keys, *cols)


def window_features(windows: DataFrame, channels: list[str], keys: list[str]) -> DataFrame:
    return _wide(windows, keys, channels, ("mean", "std", "min", "max", "slope"), "{channel}__{stat}")


def har_features(windows: DataFrame, n_channels: int, keys: list[str], prefix: str = "ch") -> DataFrame:
    return _wide(windows, keys, [f"{prefix}{i}" for i in range(n_channels)], ("mean", "std", "min", "max", "energy"), "{channel}_{stat}")


def stat_targets(windows: DataFrame, channels: list[str], keys: list[str]) -> DataFrame:
    safe = [c.replace(".", "_") for c in channels]
    return _wide(windows, keys, safe, ("mean", "std", "min", "max"), "stat_{channel}_{stat}")


def run_durations(runs: DataFrame) -> DataFrame:
    return runs.groupBy("subject_id", "activity_id", "run_id").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end")).withColumn("duration", F.col("end") - F.col("start"))


def _facts(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """One row a run with its rows, windows and duration: everything the rollups sum."""
    per_run = runs.groupBy("subject_id", "activity_id", "activity_name", "run_id").agg(F.count("*").alias("rows"), (F.max("timestamp") - F.min("timestamp")).alias("duration"))
    per_window = windows.groupBy("subject_id", "activity_id", "run_id").agg(F.count("*").alias("windows"))
    return per_run.join(per_window, ["subject_id", "activity_id", "run_id"], "left").fillna(0, ["windows"])


def _sums() -> list[Column]:
    return [F.sum("rows").alias("n_rows"), F.sum("windows").alias("n_windows"), F.sum("duration").alias("duration")]


def activity_rollup(runs: DataFrame, windows: DataFrame) -> DataFrame:
    return _facts(runs, windows).groupBy("activity_id", "activity_name").agg(*_sums())


def subject_rollup(runs: DataFrame, windows: DataFrame) -> DataFrame:
    return _facts(runs, windows).groupBy("subject_id").agg(*_sums())


def rollups(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """Activity, subject and grand totals in one pass; level names the grouping."""
    facts = _facts(runs, windows)
    sets = facts.groupingSets([["activity_id"], ["subject_id"], []], "activity_id", "subject_id").agg(F.grouping_id().alias("g"), *_sums())
    return sets.withColumn("level", F.when(F.col("g") == 1, "activity").when(F.col("g") == 2, "subject").otherwise("total")).drop("g")


def channel_summary(df: DataFrame, channels: list[str]) -> DataFrame:
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("v")) for c in channels])).alias("x")).select("x.*")
    return long.groupBy("channel").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def two_label_counts(df: DataFrame, first: str, second: str) -> DataFrame:
    """Counts of two lower-cased labels; the column is activity_name, else activity."""
    name = F.lower("activity_name" if "activity_name" in df.columns else "activity")
    return df.agg(F.count_if(name == first).alias(first), F.count_if(name == second).alias(second))
