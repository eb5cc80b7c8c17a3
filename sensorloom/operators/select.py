"""Exact quantiles of groups of any size, by narrowing histograms.

The built-in exact percentile holds every distinct value of a group in one buffer. Here a
group of more than `small` rows is scanned a few times: each pass counts the values of an
interval in `bins` equal parts, and each wanted order statistic moves on to the part that
holds it, until that has one value or at most `small` rows, which are then sorted. What a
pass gathers is `bins` counts for each interval, whatever the number of rows. The values of
large groups are written once to the checkpoint folder and read by each pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.tables import as_key, kept, looked_up


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], bins: int = 1024, small: int = 10_000) -> DataFrame:
    """keys and q, an array: the quantiles of the finite values of each group, linear between neighbouring ranks.

    Groups without a finite value have no row, also when there are no keys.
    """
    v = F.col(value).cast("double")
    base = df.select(as_key(keys).alias("__g"), v.alias("v")).where(F.abs("v") < float("inf"))  # NaN is no number below infinity
    stats = base.groupBy("__g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    large = kept(stats.where(F.col("n") > small))
    plain = looked_up(base, large.select("__g"), "__g", "left_anti").groupBy("__g").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q"))
    out = plain if large.isEmpty() else plain.unionByName(_narrowed(kept(looked_up(base, large.select("__g"), "__g", "left_semi")), large, probs, bins, small))
    return out.select(*[F.col(f"__g.{k}").alias(k) for k in keys], "q")


def _narrowed(base: DataFrame, large: DataFrame, probs: list[float], bins: int, small: int) -> DataFrame:
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in at])))
    # where an order statistic lies: among the `inside` values of [lo, hi], with `below` values less than those
    spots = large.select("__g", "n", "lo", "hi", F.col("n").alias("inside"), F.lit(0).cast("long").alias("below"), F.explode(ranks).alias("rank"))
    wide = (F.col("lo") < F.col("hi")) & (F.col("inside") > small)
    while not (now := spots.where(wide)).isEmpty():
        spans = now.select("__g", "lo", "hi").distinct()
        within = looked_up(base, spans, "__g", "inner").where(F.col("v").between(F.col("lo"), F.col("hi")))
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))
        counts = within.groupBy("__g", "lo", "hi", part.alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("l"), F.max("v").alias("h"))
        before = F.sum("c").over(Window.partitionBy("__g", "lo", "hi").orderBy("part")) - F.col("c")
        found = now.join(counts.withColumn("before", before), ["__g", "lo", "hi"]).where(F.col("rank") - F.col("below") - F.col("before") >= 0).where(F.col("rank") - F.col("below") - F.col("before") < F.col("c"))
        moved = found.select("__g", "n", F.col("l").alias("lo"), F.col("h").alias("hi"), F.col("c").alias("inside"), (F.col("below") + F.col("before")).alias("below"), "rank")
        spots = kept(spots.where(~wide).unionByName(moved))
    few = spots.where("lo < hi").select("__g", "lo", "hi").distinct()
    # each interval holds at most `small` rows
    lists = looked_up(base, few, "__g", "inner").where(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("__g", "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    got = spots.join(lists, ["__g", "lo", "hi"], "left").withColumn("x", F.coalesce(F.element_at("vs", (F.col("rank") - F.col("below") + 1).cast("int")), F.col("lo")))
    by_rank = got.groupBy("__g", "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("x"))

    def between(a):
        low, high = F.floor(a), F.ceil(a)
        return F.when(low == high, F.col("x")[low]).otherwise((high - a) * F.col("x")[low] + (a - low) * F.col("x")[high])

    return by_rank.select("__g", F.array(*[between(a) for a in at]).alias("q"))
