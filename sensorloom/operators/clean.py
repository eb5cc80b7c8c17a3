"""Activity and channel selection, row validity, interpolation, gap runs, scalers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.schemas import ACTIVITIES

GROUP = ("subject_id", "activity_id")


def resolve_activities(tokens: list[str], names: dict[int, str] | None = None) -> list[int]:
    """Ids of activity tokens: digits, or names in any case with blanks as underscores."""
    by_name = {v: k for k, v in (names or ACTIVITIES).items()}
    out = []
    for t in tokens:
        key = t.strip().lower().replace(" ", "_")
        if not key.isdigit() and key not in by_name:
            raise ValueError(f"unknown activity: {t}")
        out.append(int(key) if key.isdigit() else by_name[key])
    return out


def select_activities(df: DataFrame, ids: list[int]) -> DataFrame:
    return df.where(F.col("activity_id").isin(list(ids)) & (F.col("activity_id") != 0))


def label_activities(df: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """activity_id as an integer (null is 0) and its name, or `unknown`."""
    table = F.create_map(*[F.lit(x) for kv in (names or ACTIVITIES).items() for x in kv])
    return df.withColumn("activity_id", F.coalesce("activity_id", F.lit(0)).cast("int")).withColumn("activity_name", F.coalesce(table[F.col("activity_id")], F.lit("unknown")))


def select_channels(columns: list[str], wanted: list[str] | None, default: list[str]) -> list[str]:
    """The requested channels in request order; unknown ones raise."""
    chosen = list(wanted or default)
    missing = [c for c in chosen if c not in columns]
    if missing:
        raise ValueError(f"unknown channels: {missing}")
    return chosen


def resolve_channels(names: list[str], exact: list[str] | None = None, prefixes: list[str] | None = None) -> list[str]:
    """Channels by name or prefix in source order; all when nothing is asked for."""
    if not exact and not prefixes:
        return list(names)
    chosen = [n for n in names if n in (exact or []) or n.startswith(tuple(prefixes or ["\0"]))]
    if not chosen:
        raise ValueError("no channel matches")
    return chosen


def ordered_categories(df: DataFrame, column: str, priority: list[str], lower: bool = False) -> DataFrame:
    """Distinct values: those of the priority list in its order, then the others by name."""
    value = F.lower(column) if lower else F.col(column)
    rank = F.coalesce(*[F.when(F.col(column) == p, i) for i, p in enumerate(priority)], F.lit(len(priority)))
    return df.select(value.alias(column)).where(F.col(column).isNotNull()).distinct().withColumn("rank", rank).orderBy("rank", column)


def finite(c: str) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))


def valid_rows(df: DataFrame, channels: list[str], ratio: float) -> DataFrame:
    """Rows with at least max(1, ceil(channels * ratio)) numbers; NaN and infinities become null."""
    need = max(1, -int(-len(channels) * ratio // 1))
    df = df.withColumns({c: finite(c) for c in channels})
    return df.where(sum(F.col(c).isNotNull().cast("int") for c in channels) >= need)


def interpolate(df: DataFrame, channels: list[str], order: list[str]) -> DataFrame:
    """Nulls filled linearly by row position within (subject, activity); ends take the nearest number.

    Groups without any number stay null. One exchange on the group serves all channels.
    """
    w = Window.partitionBy(*GROUP).orderBy(*order)
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = df.withColumn("__p", F.row_number().over(w))
    for c in channels:
        at = F.when(F.col(c).isNotNull(), F.col("__p"))
        a, b = F.last(c, True).over(past), F.first(c, True).over(future)
        pa, pb = F.last(at, True).over(past), F.first(at, True).over(future)
        out = out.withColumns({f"__a_{c}": a, f"__b_{c}": b, f"__s_{c}": pa, f"__t_{c}": pb})
    fill = {c: F.expr(f"coalesce(`{c}`, `__a_{c}` + (`__b_{c}` - `__a_{c}`) * (__p - `__s_{c}`) / (`__t_{c}` - `__s_{c}`), `__a_{c}`, `__b_{c}`)") for c in channels}
    return out.withColumns(fill).select(*df.columns)


def lag_delta(df: DataFrame, order: list[str]) -> DataFrame:
    w = Window.partitionBy(*GROUP).orderBy(*order)
    return df.withColumn("delta", F.col("timestamp") - F.lag("timestamp").over(w))


def assign_runs(df: DataFrame, order: list[str], gap_factor: float = 3.0) -> DataFrame:
    """run_id from 1 within (subject, activity): a new run at a null, non-positive or too large time step.

    Too large is more than gap_factor times the exact median of the group's positive steps.
    """
    w = Window.partitionBy(*GROUP).orderBy(*order)
    steps = lag_delta(df, order)
    # an aggregate, not a frame: no task buffers a whole group, and both sides are partitioned by it already
    limits = steps.groupBy(*GROUP).agg((F.median(F.when(F.col("delta") > 0, F.col("delta"))) * gap_factor).alias("__limit"))
    limits = limits.select(*[F.col(c).alias(f"__{c}") for c in GROUP], "__limit")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in GROUP]
    stepped = steps.join(limits, same[0] & same[1], "left").drop(*[f"__{c}" for c in GROUP])
    new = F.col("delta").isNull() | (F.col("delta") <= 0) | (F.col("delta") > F.coalesce("__limit", F.lit(float("inf"))))
    return stepped.withColumn("run_id", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__limit", "delta")


def channel_scaler(df: DataFrame, channels: list[str], mode: str = "global_standard") -> DataFrame:
    """(channel, mean, scale): population moments over all rows; tiny scales are 1; mode `none` is the identity."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("v")) for c in channels])).alias("x")).select("x.*")
    if mode == "none":
        return long.groupBy("channel").agg(F.lit(0.0).alias("mean"), F.lit(1.0).alias("scale"))
    if mode not in ("global_standard", "zscore"):
        raise ValueError(f"unknown normalisation: {mode}")
    spread = F.stddev_pop("v")
    return long.groupBy("channel").agg(F.avg("v").alias("mean"), F.when(spread < 1e-8, 1.0).otherwise(spread).alias("scale"))


def clean(df: DataFrame, channels: list[str], order: list[str], ratio: float = 0.8) -> DataFrame:
    """Valid rows, filled, without rows that stay null."""
    return interpolate(valid_rows(df, channels, ratio), channels, order).dropna(subset=channels)


def label_order(df: DataFrame) -> DataFrame:
    """The distinct (activity_id, activity_name) with their place by id, from 0."""
    # the labels are few whatever the rows
    labels = df.agg(F.sort_array(F.collect_set(F.struct("activity_id", "activity_name"))).alias("l"))
    return labels.select(F.posexplode("l").alias("place", "l")).select("l.activity_id", "l.activity_name", "place")
