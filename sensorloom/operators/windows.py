"""Sliding count windows over runs, window ids, and array and long forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.operators.scans import numbered_long
from sensorloom.tables import kept

RUN = ("subject_id", "activity_id", "run_id")


def number_rows(df: DataFrame, keys: list[str], name: str, within: list[str]) -> DataFrame:
    """A dense 0-based id in the order of keys, within.

    Rows are numbered inside their key group and shifted by the groups' running counts, so
    only one row for each group meets in one place.
    """
    groups = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*within)) - 1
    return df.join(groups, keys).withColumn(name, (F.col("__before") + local).cast("long")).drop("__before")


def sliding_windows(df: DataFrame, channels: list[str], size: int, stride: int, order: list[str], chunk: int | None = None, segment_rows: int | None = None) -> DataFrame:
    """One row a window: 11 metadata columns and w, an array of the channels' values.

    Starts are 0, stride, ... within each run while a whole window fits; shorter runs have none.

    Runs are cut into chunks of about `chunk` rows (32 windows' length where none is given), each
    with the size - 1 rows that follow it, and windows are sliced out of their chunk. So a row is
    shuffled once, or twice near a chunk's start, however many windows hold it. Ids come from the
    runs' lengths. With segment_rows, rows of long runs are numbered in segments of that size, so
    that no task holds a run.
    """
    chunk = max(1, -(-(chunk or 32 * size) // stride)) * stride
    rows = kept(df.where(F.col("run_id").isNotNull()))  # read several times
    runs = rows.groupBy(*RUN).agg(F.count("*").alias("n")).where(F.col("n") >= size)
    runs = runs.withColumn("k", F.floor((F.col("n") - size) / stride) + 1)
    group = Window.partitionBy(*RUN[:2]).orderBy(RUN[2]).rowsBetween(Window.unboundedPreceding, -1)
    totals = runs.groupBy(*RUN[:2]).agg(F.sum("k").alias("k"))
    before = totals.select(*RUN[:2], F.coalesce(F.sum("k").over(Window.orderBy(*RUN[:2]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))  # a row for each group
    first = runs.withColumn("__o", F.coalesce(F.sum("k").over(group), F.lit(0))).join(before, list(RUN[:2])).select(*RUN, (F.col("__b") + F.col("__o")).alias("__first"))
    if segment_rows is None:
        rows = rows.withColumn("p", F.row_number().over(Window.partitionBy(*RUN).orderBy(*order)) - 1)
    else:
        rows = numbered_long(rows.drop("p"), list(RUN), order, "p", segment_rows)
    rows = rows.join(first, list(RUN))
    own = F.floor(F.col("p") / chunk)
    halo = F.greatest(F.floor((F.col("p") - size + 1) / chunk), F.lit(0))
    rows = rows.withColumn("__c", F.explode(F.sequence(halo, own)))
    cell = F.struct("p", "timestamp", "source_file", *channels)
    chunks = rows.groupBy(*RUN, "activity_name", "__first", "__c").agg(F.array_sort(F.collect_list(cell)).alias("x"))
    last = F.least(F.size("x") - size, F.lit(chunk - 1))
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    cut = chunks.withColumn("__i", F.explode(starts)).withColumn("start_index", (F.col("__c") * chunk + F.col("__i")).cast("int")).withColumn("x", F.slice("x", F.col("__i") + 1, F.lit(size)))
    return cut.select(
        *RUN, "activity_name", "start_index", (F.col("start_index") + size - 1).cast("int").alias("end_index"), F.lit(size).alias("window_length"),
        F.col("x")[0]["timestamp"].alias("start_timestamp"), F.col("x")[size - 1]["timestamp"].alias("end_timestamp"), F.col("x")[0]["source_file"].alias("source_file"),
        F.array(*[F.col("x")[c] for c in channels]).alias("w"), (F.col("__first") + F.floor(F.col("start_index") / stride)).cast("long").alias("window_id"),
    )


def to_long(windows: DataFrame, channels: list[str], keys: list[str]) -> DataFrame:
    """keys, channel_index, channel, t, v from windows with w."""
    names = F.array(*[F.lit(c) for c in channels])
    long = windows.select(*keys, F.posexplode("w").alias("channel_index", "series")).select(*keys, "channel_index", F.posexplode("series").alias("t", "v"))
    return long.withColumn("channel", F.element_at(names, F.col("channel_index") + 1))


def zscore(windows: DataFrame, scaler: DataFrame, channels: list[str], inverse: bool = False) -> DataFrame:
    """w standardised by the scaler's row for each channel, or back."""
    table = scaler.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("mean", "scale")))).alias("__m"))
    out = windows.join(F.broadcast(table))

    def scaled(i: int, channel: str):
        mean, scale = F.col("__m")[channel]["mean"], F.col("__m")[channel]["scale"]
        return F.transform(F.col("w")[i], lambda x: x * scale + mean if inverse else (x - mean) / scale)

    return out.withColumn("w", F.array(*[scaled(i, c) for i, c in enumerate(channels)])).drop("__m")


def select_window_channels(windows: DataFrame, indexes: list[int]) -> DataFrame:
    return windows.withColumn("w", F.transform(F.array(*[F.lit(i) for i in indexes]), lambda i: F.element_at(F.col("w"), i + 1)))


def by_window_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("window_id").distinct(), "window_id", "left_semi")
