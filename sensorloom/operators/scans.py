"""Ordered scans over long groups: filling, runs and row numbers in segments of bounded size.

A window function over a group sends the whole group to one task. Here a group of more than
`segment_rows` rows is cut into segments along its first order column, at approximate quantiles
and equal parts between them; a segment never shares a value of that column with the next one.
Rows are shuffled once, by group and segment. Each segment is scanned by itself and sums itself
up in one row: rows, first and last values, starts of runs. What a segment must know of those
before and after it (last number, next number, rows so far, runs so far) comes from a window over
these rows, one a segment, and goes back by group and segment, where the rows lie already.
The results are those of the plain forms in `clean`. A frame that `segmented` made stays in its
segments through filling and run detection, without another shuffle.

Defined cases: null times come first and share the first segment, NaN comes last; rows
of one time share a segment however many they are; groups with null keys are groups; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from sensorloom.operators.clean import GROUP
from sensorloom.operators.select import exact_quantiles
from sensorloom.tables import as_key, kept, looked_up

SEGMENT_ROWS = 1_000_000
QUANTILES = 256  # cuts of a group at most; between them segments are equal parts in time
STEP = 16  # cuts are looked up by sixteens
POINTS = 10_000  # grid points in an array


def segmented(df: DataFrame, keys: list[str], by: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """df with __g, the keys as one value, and __s, the row's segment in its group, which rises with `by`."""
    t = F.col(by).cast("double")
    rows = df.withColumn("__g", as_key(keys))
    large = kept(rows.groupBy("__g").agg(F.count("*").alias("n")).where(F.col("n") > segment_rows))
    if large.isEmpty():
        return rows.withColumn("__s", F.lit(0).cast("long"))
    cuts = looked_up(rows.select("__g", F.when(~F.isnan(t), t).alias("t")), large, "__g", "inner").groupBy("__g").agg(
        F.first("n").alias("n"), F.min("t").alias("__lo"), F.max("t").alias("__hi"), F.percentile_approx("t", [i / QUANTILES for i in range(1, QUANTILES)], 10_000).alias("q"),
    )
    parts = F.least(F.ceil(F.col("n") / segment_rows), F.lit(QUANTILES)).cast("int")
    cuts = cuts.withColumn("k", parts).withColumn("__m", F.greatest(F.ceil(F.col("n") / F.col("k") / segment_rows), F.lit(1)))
    none = F.array().cast("array<double>")
    chosen = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.element_at("q", F.floor(i * QUANTILES / F.col("k")).cast("int")))
    cuts = cuts.withColumn("__b", F.coalesce(F.when(F.col("k") > 1, chosen), none))
    sixteens = F.transform(F.sequence(F.lit(STEP), F.size("__b"), F.lit(STEP)), lambda i: F.element_at("__b", i))
    cuts = kept(cuts.select("__g", "__lo", "__hi", "__m", "__b", F.when(F.size("__b") >= STEP, sixteens).otherwise(none).alias("__c")))
    below = lambda cuts: F.size(F.filter(cuts, lambda x: x < t))
    found = looked_up(rows, cuts, "__g").withColumn("__i", below(F.col("__c")) * STEP)
    found = found.withColumn("__i", F.col("__i") + below(F.slice("__b", F.col("__i") + 1, F.lit(STEP))))
    lo = F.when(F.col("__i") > 0, F.get("__b", F.col("__i") - 1)).otherwise(F.col("__lo"))
    hi = F.coalesce(F.get("__b", F.col("__i")), F.col("__hi"))
    inside = F.least(F.greatest(F.floor((t - lo) / F.nullif(hi - lo, F.lit(0.0)) * F.col("__m")), F.lit(0)), F.col("__m") - 1)
    inside = F.when(F.isnan(t), F.col("__m") - 1).otherwise(F.coalesce(inside, F.lit(0)))
    return found.withColumn("__s", F.coalesce(F.col("__i") * F.col("__m") + inside, F.lit(0)).cast("long")).select(*df.columns, "__g", "__s")


def _segment(order: list[str]) -> WindowSpec:
    return Window.partitionBy("__g", "__s").orderBy(*order)


def _segments_before() -> WindowSpec:
    return Window.partitionBy("__g").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)


def _segments_after() -> WindowSpec:
    return Window.partitionBy("__g").orderBy("__s").rowsBetween(1, Window.unboundedFollowing)


def _cut(df: DataFrame, keys: list[str], order: list[str], segment_rows: int) -> DataFrame:
    """df in segments; a frame that has them keeps its own."""
    return df if {"__g", "__s"} <= set(df.columns) else segmented(df, keys, order[0], segment_rows)


def numbered_long(df: DataFrame, keys: list[str], order: list[str], name: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """df with the row's number in its group, from 0."""
    rows = segmented(df, keys, order[0], segment_rows)
    sizes = rows.groupBy("__g", "__s").agg(F.count("*").alias("n"))
    so_far = kept(sizes.select("__g", "__s", F.coalesce(F.sum("n").over(_segments_before()), F.lit(0)).alias("__o")))
    rows = looked_up(rows.withColumn("__p", F.row_number().over(_segment(order))), so_far, ["__g", "__s"], "inner")
    return rows.withColumn(name, F.col("__o") + F.col("__p") - 1).select(*df.columns, name)


def interpolate_long(df: DataFrame, channels: list[str], order: list[str], segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """`clean.interpolate` in segments: nulls filled linearly by row position within (subject, activity); ends take the nearest number."""
    rows = _cut(df, list(GROUP), order, segment_rows).withColumn("__p", F.row_number().over(_segment(order)).cast("long"))
    cell = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("__p").alias("p"), F.col(c).alias("v")))
    ends = rows.groupBy("__g", "__s").agg(F.count("*").alias("n"), *[F.min(cell(c)).alias(f"__f_{c}") for c in channels], *[F.max(cell(c)).alias(f"__l_{c}") for c in channels])
    ends = ends.withColumn("__o", F.coalesce(F.sum("n").over(_segments_before()), F.lit(0)))
    shifted = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(c)["p"] + F.col("__o")).alias("p"), F.col(c)["v"].alias("v")))
    before = [F.last(shifted(f"__l_{c}"), True).over(_segments_before()).alias(f"__before_{c}") for c in channels]
    after = [F.first(shifted(f"__f_{c}"), True).over(_segments_after()).alias(f"__after_{c}") for c in channels]
    carries = kept(ends.select("__g", "__s", "__o", *before, *after))
    w = _segment(order)
    for c in channels:
        rows = rows.withColumns({f"__l_{c}": F.last(cell(c), True).over(w.rowsBetween(Window.unboundedPreceding, 0)), f"__f_{c}": F.first(cell(c), True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    out = looked_up(rows, carries, ["__g", "__s"], "inner")

    def filled(c: str) -> Column:
        a, b = F.coalesce(shifted(f"__l_{c}"), F.col(f"__before_{c}")), F.coalesce(shifted(f"__f_{c}"), F.col(f"__after_{c}"))
        here = F.col("__p") + F.col("__o")
        between = a["v"] + (b["v"] - a["v"]) * (here - a["p"]) / (b["p"] - a["p"])
        return F.coalesce(F.col(c), between, a["v"], b["v"])

    return out.withColumns({c: filled(c) for c in channels}).select(*df.columns)


def _last_times(rows: DataFrame, order: list[str]) -> DataFrame:
    """For each segment __t, the time of the last row before it."""
    last = rows.groupBy("__g", "__s").agg(F.max_by("timestamp", F.struct(*order)).alias("t"))
    return kept(last.select("__g", "__s", F.lag("t").over(Window.partitionBy("__g").orderBy("__s")).alias("__t")))


def _steps(rows: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """Segmented rows with delta and what is known of their segments; a segment's first row looks back to __t."""
    w = _segment(order)
    local = rows.withColumn("__first", F.row_number().over(w) == 1).withColumn("__back", F.lag("timestamp").over(w))
    stepped = looked_up(local, known, ["__g", "__s"], "inner")
    return stepped.withColumn("delta", F.col("timestamp") - F.when(F.col("__first"), F.col("__t")).otherwise(F.col("__back"))).drop("__t", "__first", "__back")


def lag_delta_long(df: DataFrame, order: list[str], segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """`clean.lag_delta` in segments: the step from the row before in (subject, activity)."""
    rows = _cut(df, list(GROUP), order, segment_rows)
    return _steps(rows, _last_times(rows, order), order).select(*df.columns, "delta")


def runs_long(df: DataFrame, order: list[str], gap_factor: float = 3.0, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """`clean.assign_runs` in segments: run_id from 1 within (subject, activity), a new run at a null, non-positive or too large step.

    Too large is more than gap_factor times the exact median of the group's positive steps, which
    comes from counts, not from a buffer of all steps.
    """
    rows = _cut(df, list(GROUP), order, segment_rows)
    last = _last_times(rows, order)
    median = exact_quantiles(_steps(rows, last, order).where("delta > 0").select("__g", "delta"), ["__g"], "delta", [0.5])
    # the limit reaches the rows by group and segment, so that no group meets in one task
    limits = kept(last.join(median.select("__g", (F.col("q")[0] * gap_factor).alias("__limit")), "__g", "left"))

    def flagged(known: DataFrame) -> DataFrame:
        new = F.col("delta").isNull() | (F.col("delta") <= 0) | (F.col("delta") > F.coalesce("__limit", F.lit(float("inf"))))
        return _steps(rows, known, order).withColumn("__new", new.cast("long"))

    starts = flagged(limits).groupBy("__g", "__s").agg(F.sum("__new").alias("k"))
    so_far = starts.select("__g", "__s", F.coalesce(F.sum("k").over(_segments_before()), F.lit(0)).alias("__k"))
    local = F.sum("__new").over(_segment(order).rowsBetween(Window.unboundedPreceding, 0))
    return flagged(kept(limits.join(so_far, ["__g", "__s"]))).withColumn("run_id", (F.col("__k") + local).cast("int")).select(*df.columns, "run_id")


def resample(df: DataFrame, keys: list[str], time: str, channels: list[str], step: float, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """keys, point (from 0), time and channels on a grid from each group's first time on, `step` apart, to its last time: linear between the two rows about a grid point.

    Each row makes the grid points from its own time up to the next row's, so points meet their two
    neighbours without a join; the next row of a segment's last one comes with its carry. A point at a row's
    time has the row's values, of the last one where times repeat in no further order. Rows without a finite
    time take no part; a null on either side of a point makes null.
    """
    rows = df.select(*keys, F.col(time).cast("double").alias(time), *[F.col(c).cast("double").alias(c) for c in channels]).where(F.abs(time) < float("inf"))
    rows = segmented(rows, keys, time, segment_rows).withColumn("__row", F.struct(time, *channels))
    ends = rows.groupBy("__g", "__s").agg(F.min("__row").alias("first"))
    group = Window.partitionBy("__g").orderBy("__s")
    carries = kept(ends.select("__g", "__s", F.lead("first").over(group).alias("__after"), F.first("first").over(group)[time].alias("__from")))
    rows = looked_up(rows.withColumn("__next", F.lead("__row").over(_segment([time, *channels]))), carries, ["__g", "__s"], "inner")
    rows = rows.withColumn("__next", F.coalesce("__next", "__after"))

    def reached(t: Column) -> Column:
        """The number of the first grid point at or after t."""
        k = F.ceil((t - F.col("__from")) / step)
        at = lambda k: F.col("__from") + k * F.lit(float(step))
        return F.when(at(k - 1) >= t, k - 1).when(at(k) < t, k + 1).otherwise(k)

    own, end = reached(F.col(time)), F.col("__next")[time]
    # the last row of a group makes the point at its time, if there is one
    last = F.when(end.isNotNull(), reached(end) - 1).when(F.col("__from") + own * F.lit(float(step)) == F.col(time), own)
    rows = rows.withColumn("__k", own).withColumn("__l", last).where("__l >= __k")
    # long gaps make their points in lots, so that no array is long
    lots = rows.withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__l") - F.col("__k")) / POINTS))))
    low = F.col("__k") + F.col("__lot") * POINTS
    points = lots.withColumn("__k", F.explode(F.sequence(low, F.least(low + POINTS - 1, F.col("__l")))))
    points = points.withColumn("__t", F.col("__from") + F.col("__k") * F.lit(float(step)))
    share = (F.col("__t") - F.col(time)) / (end - F.col(time))
    filled = [F.when(F.col("__t") == F.col(time), F.col(c)).otherwise(F.col(c) + (F.col("__next")[c] - F.col(c)) * share).alias(c) for c in channels]
    return points.select(*keys, F.col("__k").alias("point"), F.col("__t").alias(time), *filled)
