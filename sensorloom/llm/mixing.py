"""Mixing sources to target weights by Poisson replication, in DataFrame operations.

Each source gets a mean repetition rate so that its expected share of the output equals
its target weight; each document draws its count by inverting the Poisson distribution
with that mean at a uniform number hashed from the seed and the document, is exploded
by the count, and all copies are dealt out and ordered by a hash of seed, document and
copy. The draw is a function of the document alone, so a lost task repeats it exactly.

Rates and distributions have one row for each source, with about 24 square roots of the rate
as numbers. They are broadcast when there are
no more than `broadcast_sources` of at most 400 numbers on average, so that documents are shuffled once, when their copies
are dealt out; beyond that, documents meet them by source and a salt, which splits a
source that holds a third of all rows.

Defined cases: sources without a weight share what named weights leave (all equal when
none is named); weights that are all zero, with no other source, give no rows; a negative
or non-finite weight raises ValueError; a null source is a source of its own; repeated rows
draw the same count; a null doc_id draws as the empty string; an empty table gives no
rows. Where docs has a column copy, copies or rate, it stays and the mix adds none of that name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.llm.blocks import saved

#: 13 hex digits of an MD5 make a uniform number exactly representable as a double.
HEX, SPAN = 13, float(1 << 52)


def hashed_unit(*parts: Column) -> Column:
    """Uniform number in [0, 1) from the MD5 of the parts joined with a bar."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, HEX), 16, 10).cast("long") / F.lit(SPAN)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """(source, n_docs, rate): mean repetitions so that shares meet the weights.

    total is the expected number of documents in the mix, that of the input by default.
    """
    weights = weights or {}
    if any(w < 0 or not math.isfinite(w) for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    named = F.lit(None).cast("double")
    if weights:
        named = F.element_at(F.create_map(*[F.lit(v) for k, w in sorted(weights.items()) for v in (k, float(w))]), F.coalesce("source", F.lit("")))
    sized = sizes.withColumn("named", named)
    whole = sized.agg(F.sum("n_docs").alias("all_docs"), F.coalesce(F.sum("named"), F.lit(0.0)).alias("named_sum"), F.sum(F.col("named").isNull().cast("long")).alias("unnamed"))
    rest = F.greatest(F.lit(0.0), 1 - F.col("named_sum")) / F.greatest("unnamed", F.lit(1))
    weight = F.coalesce("named", rest)
    scale = F.when(F.col("unnamed") > 0, F.greatest("named_sum", F.lit(1.0))).otherwise(F.col("named_sum"))
    wanted = F.lit(float(total)) if total is not None else F.col("all_docs")
    # whole is one row
    return sized.join(F.broadcast(whole)).select("source", "n_docs", F.when(scale > 0, weight / scale * wanted / F.col("n_docs")).otherwise(0.0).alias("rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """rates with low and cdf: the distribution's running sums from `low` on, twelve deviations about the rate.

    What lies outside has less weight than the numbers can hold. A rate has about 24 square roots of it as steps, each
    with the logarithms' sum carried on from the step before; the first comes from Stirling's series.
    """
    reach = 12 * F.sqrt("rate") + 20
    steps = rates.select("*", F.greatest(F.floor(F.col("rate") - reach), F.lit(0)).alias("low"), F.ceil(F.col("rate") + reach).alias("top"))
    n = F.col("low").cast("double")
    stirling = n * F.ln(n) - n + F.ln(2 * math.pi * n) / 2 + 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5)
    steps = steps.withColumn("k", F.explode(F.sequence("low", "top")))
    along = Window.partitionBy("source", "rate", "low").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_factorial = F.when(F.col("low") > 0, stirling).otherwise(0.0) + F.coalesce(F.sum(F.when(F.col("k") > F.col("low"), F.ln("k"))).over(along), F.lit(0.0))
    p = F.when(F.col("rate") > 0, F.exp(-F.col("rate") + F.col("k") * F.ln("rate") - log_factorial)).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    running = steps.withColumn("p", p).withColumn("c", F.sum("p").over(along))
    lists = running.groupBy("source", "rate", "low").agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("s"))
    return lists.select("source", "rate", "low", F.col("s.c").alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 1, broadcast_sources: int = 10_000, salts: int = 64) -> DataFrame:
    """docs' columns with copy (from 1), copies and rate, shuffled over all partitions."""
    clash = {"copy", "copies", "rate", "cdf"} & set(docs.columns)
    steps = poisson_steps(source_rates(docs, weights, total))
    steps = saved(steps.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"), F.col("low").alias("__low"), F.col("cdf").alias("__cdf")))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    same = F.col("source").eqNullSafe(F.col("__source"))
    sources, numbers = steps.agg(F.count("*"), F.coalesce(F.sum(F.size("__cdf")), F.lit(0))).first()
    if sources <= broadcast_sources and numbers <= 400 * broadcast_sources:
        drawn = docs.join(F.broadcast(steps), same).drop("__source")
    else:
        steps = steps.withColumn("__steps_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = docs.withColumn("__salt", F.pmod(F.xxhash64(doc), F.lit(salts)).cast("int"))
        drawn = salted.join(steps, same & (F.col("__salt") == F.col("__steps_salt"))).drop("__source", "__salt", "__steps_salt")
    unit = hashed_unit(F.lit(f"count {seed}"), doc)
    drawn = drawn.withColumn("__u", unit).withColumn("__copies", F.expr("__low + size(filter(__cdf, c -> c <= __u))").cast("long"))
    copies = drawn.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    place = hashed_unit(F.lit(f"place {seed}"), doc, F.col("__copy").cast("string"))
    dealt = copies.drop("__cdf", "__low", "__u").withColumn("__place", place)
    dealt = dealt.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__place").sortWithinPartitions("__place")
    extra = [F.col("__" + n).alias(n) for n in ("copy", "copies", "rate") if n not in clash]
    return dealt.select(*[F.col(n) for n in docs.columns], *extra)
