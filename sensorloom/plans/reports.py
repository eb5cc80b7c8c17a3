"""Run registries joined with artefacts, ratios against baselines, pivots, manifest states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import metrics as metrics_of
from sensorloom.operators import split
from sensorloom.schemas import OVERALL
from sensorloom.sources import sensor


def run_summary(runs: DataFrame, similarity: DataFrame, utility: DataFrame, keep_missing: bool = True) -> DataFrame:
    """Each run with its overall similarity row and utility by setting; missing runs stay with nulls or go."""
    overall = similarity.where(F.col("activity_name") == OVERALL).drop("activity_name")
    by_setting = utility.groupBy("run_name").agg(*[F.max(F.when(F.col("setting") == s, F.col("accuracy"))).alias(f"{s}_accuracy") for s in ("real_only", "synthetic_only", "real_plus_synthetic")])
    how = "left" if keep_missing else "inner"
    out = runs.join(overall, "run_name", how).join(by_setting, "run_name", how)
    return out.withColumn("utility_gain", F.col("real_plus_synthetic_accuracy") - F.col("real_only_accuracy"))


def ratio(x: str | Column, base: str | Column) -> Column:
    """x over base; null where the base is null or zero."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return c(x) / F.nullif(c(base), F.lit(0.0))


def with_baseline(summary: DataFrame, baseline: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Ratios `{metric}_ratio` to the baseline row of the same key; both sides come from one plan."""
    base = baseline.select(key, *[F.col(m).alias(f"{m}_ref") for m in metrics])
    return summary.join(base, key, "left").withColumns({f"{m}_ratio": ratio(m, f"{m}_ref") for m in metrics})


def keyed_value(df: DataFrame, key: str, label, metric: str) -> DataFrame:
    """value of metric where key is label; null when the row or column is missing."""
    if key not in df.columns or metric not in df.columns:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("value"))
    return df.agg(F.first(F.when(F.col(key) == label, F.col(metric)), True).alias("value"))


def metric_pivot(long: DataFrame, metric: str, models: list[str]) -> DataFrame:
    return long.groupBy("activity_name").pivot("model", models).agg(F.first(metric))


def tag_union(parts: dict[str, DataFrame], column: str = "source") -> DataFrame:
    out = None
    for name, df in parts.items():
        tagged = df.withColumn(column, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def common_activities(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("activity_name").where("activity_name is not null").intersect(b.select("activity_name").where("activity_name is not null"))


def best_by(df: DataFrame, label: str, metrics: dict[str, str]) -> DataFrame:
    """metric, best: the label with the largest (`max`) or smallest (`min`) value, nulls aside, ties by label."""
    rows = None
    for m, way in metrics.items():
        order = F.desc(m) if way == "max" else F.asc(m)
        one = df.where(F.col(m).isNotNull()).orderBy(order, label).limit(1).select(F.lit(m).alias("metric"), F.col(label).alias("best"), F.col(m).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def manifest_states(manifest: DataFrame, metrics: DataFrame, errors: DataFrame, needed: list[str]) -> DataFrame:
    """status of each manifest run: read_error, missing, empty, missing_metrics or ok, and its overall row's metrics (the last row when there is none)."""
    rows = metrics.groupBy("run_name").agg(F.count("activity_name").alias("rows"), *[F.coalesce(F.max(F.when(F.col("activity_name") == OVERALL, F.col(m))), F.max_by(m, "row")).alias(m) for m in needed])
    out = manifest.join(errors.select("run_name", F.lit(True).alias("failed")), "run_name", "left").join(rows, "run_name", "left")
    lacking = F.greatest(*[F.col(m).isNull().cast("int") for m in needed], F.lit(0)) == 1
    status = F.when(F.col("failed"), "read_error").when(F.col("rows").isNull(), "missing").when(F.col("rows") == 0, "empty").when(lacking, "missing_metrics").otherwise("ok")
    return out.withColumn("status", status).drop("failed", "rows")


# The metrics of an evaluation.
METRICS = ("MDD", "ACD", "SD", "KD", "ED", "DTW", "SHR")


def summarize_manifests(spark: SparkSession, manifests: list[str], metrics: tuple[str, ...] = METRICS, name: str = "similarity_metrics.csv") -> DataFrame:
    """A row for each line of the manifests: manifest, manifest_index, run_name, metrics_path, status, error, counts, missing_metrics and the metrics.

    A line names a file of a run's folder, whose metrics lie beside it. Files are listed, opened and parsed one by one, so
    one that fails marks its own run: `missing` is not listed, `read_error` could not be opened or parsed, `empty`
    has no rows, `missing_metrics` lacks some columns, else `ok`. Metrics are those of the overall row, or of the last row.
    """
    lines = None
    for manifest in manifests:
        rows = sensor.read_manifest(spark, manifest).select(F.lit(manifest.rsplit("/", 1)[-1]).alias("manifest"), F.col("index").alias("manifest_index"), "line")
        lines = rows if lines is None else lines.unionByName(rows)
    folder = F.regexp_replace("line", "/[^/]*$", "")
    runs = lines.select("manifest", "manifest_index", F.element_at(F.split(folder, "/"), -1).alias("run_name"), F.concat(folder, F.lit(f"/{name}")).alias("metrics_path"))
    files = sensor.read_csv_files(spark, runs.select(F.col("metrics_path").alias("path")), name)
    out = runs.join(files.withColumnRenamed("path", "metrics_path"), "metrics_path", "left")
    overall = F.get(F.filter("rows", lambda r: r["activity_name"] == OVERALL), F.lit(0))
    source = F.coalesce(overall, F.try_element_at("rows", F.lit(-1)))
    there = F.coalesce(F.col("header"), F.array().cast("array<string>"))
    lacking = F.array_except(F.array(*[F.lit(m) for m in metrics]), there)
    broken = F.col("error").isNotNull()
    status = F.when(~F.coalesce(F.col("listed"), F.lit(False)), "missing").when(broken, "read_error").when(F.size("rows") == 0, "empty").when(F.size(lacking) > 0, "missing_metrics").otherwise("ok")
    number = lambda c: source[c].try_cast("double")
    whole = lambda c: F.when(~F.isnan(number(c)), number(c)).cast("long")
    return out.select(
        "manifest", "manifest_index", "run_name", "metrics_path", status.alias("status"), "error",
        F.coalesce(F.size(F.filter("rows", lambda r: ~r["activity_name"].eqNullSafe(OVERALL))), F.lit(0)).alias("num_activity_rows"),
        whole("num_real").alias("num_real"), whole("num_synthetic").alias("num_synthetic"), F.array_join(lacking, ",").alias("missing_metrics"), *[number(m).alias(m) for m in metrics],
    )


def refresh(summary: DataFrame, fresh: DataFrame, baseline: DataFrame, metrics: list[str]) -> DataFrame:
    """summary with its metrics overwritten by fresh ones, and ratios against baselines of the same plan."""
    new = fresh.select("run_name", *[F.col(m).alias(f"__{m}") for m in metrics])
    out = summary.join(new, "run_name", "left")
    for m in metrics:
        old = F.col(m) if m in summary.columns else F.lit(None).cast("double")
        out = out.withColumn(m, F.coalesce(f"__{m}", old)).drop(f"__{m}")
    return with_baseline(out.drop(*[f"{m}_ref" for m in metrics], *[f"{m}_ratio" for m in metrics]), baseline, "dataset", metrics)


def snapshot(similarity: DataFrame, utility: DataFrame) -> DataFrame:
    """The overall similarity row as a struct, utility as a map by setting."""
    s = similarity.where(F.col("activity_name") == OVERALL).agg(F.first(F.struct(*[c for c in similarity.columns])).alias("similarity"))
    u = utility.agg(F.map_from_entries(F.collect_list(F.struct("setting", F.struct("accuracy", "macro_f1", "weighted_f1")))).alias("utility"))
    return s.join(u)


def real_reference(windows: DataFrame, max_lag: int = 32, cap: int | None = 128, seed: int | None = 42) -> DataFrame:
    """ED_ref and DTW_ref: real windows against real ones, dealt to two sides in turn, as the scale of the distances."""
    sides = split.alternating_split(windows, ["window_id"])
    left, right = (sides.where(F.col("side") == s).drop("side") for s in ("left", "right"))
    overall = metrics_of.similarity(left, right, split.pair_windows(left, right, cap, seed), max_lag).where(F.col("activity_name") == OVERALL)
    return overall.select(F.col("ED").alias("ED_ref"), F.col("DTW").alias("DTW_ref"))


def run_name(name: str | Column, *parts: str | Column) -> Column:
    """The name, or where it is null its parts joined by an underscore."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return F.coalesce(c(name), F.concat_ws("_", *[c(p) for p in parts]))


def or_missing(df: DataFrame, keys: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """A row for each key with its metrics; NaN where there are none."""
    return keys.select(key).distinct().join(df, key, "left").withColumns({m: F.coalesce(F.col(m), F.lit(float("nan"))) for m in metrics})
