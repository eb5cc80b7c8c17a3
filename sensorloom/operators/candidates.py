"""Candidate filters, agreement with requested statistics, selection and lookup joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REASONS = ("missing_fields", "duplicate", "norm_filter", "kept")


def norm(values: list[str]) -> Column:
    return F.sqrt(F.aggregate(F.array(*[F.col(v).cast("double") for v in values]), F.lit(0.0), lambda a, x: a + x * x))


def missing_columns(values: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(v).isNull(), F.lit(v)) for v in values]))


def coerce(df: DataFrame, values: list[str]) -> DataFrame:
    """Text to numbers; what is no finite number becomes null."""
    number = lambda v: F.col(v).try_cast("double")
    return df.withColumns({v: F.when(~F.isnan(number(v)) & (F.abs(number(v)) < float("inf")), number(v)) for v in values})


def iqr_bounds(reference: DataFrame, values: list[str], factor: float = 3.0) -> DataFrame:
    """(low, high) around the exact quartiles of the reference norms; nulls when there is no reference."""
    q = reference.select(norm(values).alias("norm")).agg(F.percentile("norm", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    iqr = F.col("q")[1] - F.col("q")[0]
    return q.select((F.col("q")[0] - factor * iqr).alias("low"), (F.col("q")[1] + factor * iqr).alias("high"))


def mark_duplicates(df: DataFrame, values: list[str], key: str) -> DataFrame:
    """duplicate: an earlier row by key has the same values."""
    return df.withColumn("duplicate", F.row_number().over(Window.partitionBy(*values).orderBy(key)) > 1)


def filter_candidates(candidates: DataFrame, reference: DataFrame, values: list[str], key: str = "candidate_id", factor: float = 3.0, keep_duplicates: bool = False) -> DataFrame:
    """candidates with missing_numeric_fields, missing_columns, parsed_numeric_fields and filter_reason.

    In order: any missing value, a repeat of an earlier complete row, a norm outside the
    reference's bounds (inclusive, skipped without a reference), kept.
    """
    df = coerce(candidates, values).withColumn("missing_columns", missing_columns(values))
    df = df.withColumn("missing_numeric_fields", F.size("missing_columns")).withColumn("parsed_numeric_fields", F.lit(len(values)) - F.size("missing_columns"))
    complete = F.col("missing_numeric_fields") == 0
    earlier = F.row_number().over(Window.partitionBy(complete, *values).orderBy(key)) > 1
    df = df.withColumn("__dup", complete & earlier & F.lit(not keep_duplicates)).join(F.broadcast(iqr_bounds(reference, values, factor)))
    n = norm(values)
    outside = ~F.coalesce(n.between(F.col("low"), F.col("high")), F.lit(True))
    reason = F.when(~complete, REASONS[0]).when(F.col("__dup"), REASONS[1]).when(outside, REASONS[2]).otherwise(REASONS[3])
    return df.withColumn("filter_reason", reason).drop("__dup", "low", "high")


def stage_counts(filtered: DataFrame) -> DataFrame:
    """Rows left after each stage, with retention and duplicate ratios (null on an empty base)."""
    r = F.col("filter_reason")
    out = filtered.agg(
        F.count("*").alias("raw"), F.count_if(r != "missing_fields").alias("after_missing"),
        F.count_if(~r.isin("missing_fields", "duplicate")).alias("after_duplicates"), F.count_if(r == "kept").alias("after_norm"),
    )
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    out = out.withColumn("retention_rate", ratio("after_norm", "raw")).withColumn("unique_ratio", ratio("after_duplicates", "after_missing"))
    return out.withColumn("duplicate_rate", 1 - F.col("unique_ratio"))


def reasons_for(debug: DataFrame, filtered: DataFrame, key: str = "candidate_id") -> DataFrame:
    found = filtered.select(key, "filter_reason")
    return debug.join(found, key, "left").withColumn("filter_reason", F.coalesce("filter_reason", F.lit("unknown")))


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row for each key, by order."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("__r", r).where(F.col("__r") == 1).drop("__r")


def stats_scores(generated: DataFrame, targets: DataFrame, channels: list[str]) -> DataFrame:
    """Errors of each generated window's statistics against its prompt window's, and scores.

    generated: candidate_id, window_id, activity_name, stat_{channel}_{stat}; targets: window_id
    and the same statistics. Errors are in units of the target's spread, floored at 1e-6;
    the score weighs mean, spread and range errors 0.4, 0.4, 0.2.
    """
    stats = [f"stat_{c}_{s}" for c in channels for s in ("mean", "std", "min", "max")]
    wanted = targets.select("window_id", *[F.col(s).alias(f"t_{s}") for s in stats])
    df = generated.join(wanted, "window_id")
    out = {}
    for c in channels:
        own, goal = (lambda s, c=c: F.col(f"stat_{c}_{s}")), (lambda s, c=c: F.col(f"t_stat_{c}_{s}"))
        unit = F.greatest(goal("std"), F.lit(1e-6))
        out[f"{c}_mean_zerr"] = F.abs(own("mean") - goal("mean")) / unit
        out[f"{c}_std_relerr"] = F.abs(own("std") - goal("std")) / unit
        out[f"{c}_range_zerr"] = 0.5 * (F.abs(own("min") - goal("min")) + F.abs(own("max") - goal("max"))) / unit
    df = df.withColumns(out)
    weigh = lambda a, b, c: 0.4 * F.col(a) + 0.4 * F.col(b) + 0.2 * F.col(c)
    df = df.withColumns({f"{c}_stats_score": weigh(f"{c}_mean_zerr", f"{c}_std_relerr", f"{c}_range_zerr") for c in channels})
    mean = lambda kind: sum(F.col(f"{c}_{kind}") for c in channels) / len(channels)
    df = df.withColumns({f"avg_{k}": mean(k) for k in ("mean_zerr", "std_relerr", "range_zerr")})
    df = df.withColumn("stats_score", weigh("avg_mean_zerr", "avg_std_relerr", "avg_range_zerr"))
    highest = F.greatest(*[F.col(f"{c}_stats_score") for c in channels]) if len(channels) > 1 else F.col(f"{channels[0]}_stats_score")
    return df.withColumn("max_channel_stats_score", highest).drop(*[f"t_{s}" for s in stats])


def top_fraction(scored: DataFrame, fraction: float, tie: str = "candidate_id") -> DataFrame:
    """Per lower-cased activity the max(1, ceil(n * fraction)) lowest by score, then worst channel, then tie."""
    key = F.lower("activity_name")
    r = F.row_number().over(Window.partitionBy(key).orderBy("stats_score", "max_channel_stats_score", tie))
    n = F.count("*").over(Window.partitionBy(key))
    return scored.withColumn("__r", r).withColumn("__n", n).where(F.col("__r") <= F.greatest(F.lit(1), F.ceil(F.col("__n") * fraction))).drop("__r", "__n")


def parse_filter_specs(specs: list[str]) -> dict[str, float]:
    """`name:fraction` items; the fraction lies in (0, 1]."""
    out = {}
    for spec in specs:
        name, _, text = spec.partition(":")
        value = float(text)
        if not name or not 0 < value <= 1:
            raise ValueError(f"bad filter: {spec}")
        out[name] = value
    return out


def apply_filters(scored: DataFrame, filters: dict[str, float]) -> DataFrame:
    """The selections of all filters in one table, with filter_name."""
    parts = [top_fraction(scored, f).withColumn("filter_name", F.lit(n)) for n, f in filters.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def filter_summary(selected: DataFrame, scored: DataFrame) -> DataFrame:
    """kept, total, fraction, mean, median and largest score of a selection."""
    total = scored.agg(F.count("*").alias("total"))
    out = selected.agg(F.count("*").alias("kept"), F.avg("stats_score").alias("mean_score"), F.median("stats_score").alias("median_score"), F.max("stats_score").alias("max_score"))
    return out.join(F.broadcast(total)).withColumn("fraction", F.col("kept") / F.nullif(F.col("total"), F.lit(0)))


def kept_by_activity(selected: DataFrame, scored: DataFrame) -> DataFrame:
    """activity_name (lower-cased), kept and total of a selection."""
    both = selected.select(F.lower("activity_name").alias("activity_name"), F.lit(1).alias("k"), F.lit(0).alias("t")).unionByName(scored.select(F.lower("activity_name").alias("activity_name"), F.lit(0).alias("k"), F.lit(1).alias("t")))
    return both.groupBy("activity_name").agg(F.sum("k").alias("kept"), F.sum("t").alias("total"))


def parse_triples(specs: list[str]) -> list[tuple[str, str, str]]:
    """`a:b:c` items."""
    out = [tuple(spec.split(":")) for spec in specs]
    for spec, parts in zip(specs, out, strict=True):
        if len(parts) != 3 or not all(parts):
            raise ValueError(f"bad item: {spec}")
    return out


def top_k(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("activity_name").orderBy(*order))
    return df.withColumn("rank", r).where(F.col("rank") <= k)


def prompt_errors(pairs: DataFrame) -> DataFrame:
    """rmse and mae over all cells of two windows r and s (arrays of channels)."""
    d = F.flatten(F.zip_with("r", "s", lambda a, b: F.zip_with(a, b, lambda x, y: x - y)))
    size = F.size("__d")
    out = pairs.withColumn("__d", d)
    out = out.withColumn("rmse_to_prompt_real", F.sqrt(F.aggregate("__d", F.lit(0.0), lambda a, x: a + x * x) / size))
    return out.withColumn("mae_to_prompt_real", F.aggregate("__d", F.lit(0.0), lambda a, x: a + F.abs(x)) / size).drop("__d")


def fallback_join(generated: DataFrame, real: DataFrame, order: str = "window_id") -> DataFrame:
    """Each generated row with the real row of its window, else the first of its lower-cased activity, else nothing."""
    exact = real.select(F.col("window_id").alias("window_id"), F.col("real_index").alias("exact_index"))
    first = real.groupBy(F.lower("activity_name").alias("__a")).agg(F.min_by("real_index", order).alias("first_index"))
    out = generated.join(exact, "window_id", "left").withColumn("__a", F.lower("activity_name")).join(first, "__a", "left")
    return out.withColumn("real_index", F.coalesce("exact_index", "first_index")).where("real_index is not null").drop("__a", "exact_index", "first_index")


def join_scores(distances: DataFrame, scores: DataFrame | None, order: str = "stats_score") -> DataFrame:
    """distances with their scores (left); of repeated candidates the first by order; no scores, no change."""
    if scores is None:
        return distances
    r = F.row_number().over(Window.partitionBy("candidate_id").orderBy(order))
    one = scores.withColumn("__r", r).where(F.col("__r") == 1).drop("__r")
    return distances.join(one, "candidate_id", "left")
