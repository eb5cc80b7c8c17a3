"""Command line: python -m sensorloom preprocess | dataset | filter | evaluate-similarity | evaluate-utility | summarize ...; each command is one plan and its sink."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import candidates, clean, reduce, split
from sensorloom.plans import config, evaluate, preprocess, reports
from sensorloom.schemas import DEFAULT_CHANNELS
from sensorloom.sources import sensor, sinks


# The activities kept where none are named.
ACTIVITIES = ["walking", "running", "cycling", "sitting", "standing"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sensorloom")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("preprocess", help="recordings to windows and features")
    a.add_argument("--data-dir", "--input-dir", dest="input_dir", required=True)
    a.add_argument("--output-dir", required=True)
    a.add_argument("--channels", nargs="*")
    a.add_argument("--subjects", nargs="*", type=int)
    a.add_argument("--activities", nargs="*", default=ACTIVITIES)
    a.add_argument("--window-size", type=int, default=256)
    a.add_argument("--stride", type=int, default=128)
    a.add_argument("--gap-factor", type=float, default=3.0)
    a.add_argument("--min-valid-ratio", "--valid-ratio", dest="valid_ratio", type=float, default=0.8)
    a.add_argument("--normalization", choices=["none", "zscore"], default="zscore")
    a.add_argument("--feature-reducer", choices=["none", "pca", "fastica"], default="pca")
    a.add_argument("--n-components", "--compact-components", dest="components", type=int, default=8)
    a.add_argument("--save-raw-tensor", action="store_true", help="accepted for its name; windows before normalisation are always written")
    a.add_argument("--segment-rows", type=int, help="scan recordings in segments of so many rows, for long ones")
    b = sub.add_parser("dataset", help="preprocessed windows to a split text dataset")
    b.add_argument("--config", required=True)
    b.add_argument("--channels", nargs="*")
    c = sub.add_parser("filter", help="scored candidates to the best fractions of each activity")
    c.add_argument("--scores", required=True)
    c.add_argument("--output-dir", required=True)
    c.add_argument("--filters", nargs="+", default=["p70:0.7", "p35:0.35"])
    d = sub.add_parser("evaluate-similarity", help="metrics between real and synthetic windows")
    d.add_argument("--config", required=True)
    d.add_argument("--real-windows", required=True)
    d.add_argument("--synthetic-windows", required=True)
    d.add_argument("--output-dir")
    d.add_argument("--compute-shr", action="store_true")
    e = sub.add_parser("evaluate-utility", help="forests trained on real and synthetic windows, tested on real ones")
    e.add_argument("--config", required=True)
    e.add_argument("--real-train-windows", required=True)
    e.add_argument("--real-test-windows", required=True)
    e.add_argument("--synthetic-windows", required=True)
    e.add_argument("--output-dir")
    f = sub.add_parser("summarize", help="the state and metrics of each run of some manifests")
    f.add_argument("--manifest", action="append", required=True)
    f.add_argument("--output", required=True)
    return p


def run_preprocess(spark: SparkSession, o: argparse.Namespace) -> None:
    channels = list(o.channels or DEFAULT_CHANNELS)
    rows = clean.label_activities(sensor.read_recordings(spark, o.input_dir, o.subjects))
    made = preprocess.preprocess(rows, channels, o.window_size, o.stride, activities=clean.resolve_activities(o.activities) if o.activities else None, ratio=o.valid_ratio, gap_factor=o.gap_factor, normalization=o.normalization, segment_rows=o.segment_rows)
    flat = (made.windows if made.normalized is None else made.normalized).select("window_id", "w")
    compact = None
    if o.feature_reducer != "none" and o.components:
        compact = reduce.compact_pca(flat, o.components) if o.feature_reducer == "pca" else reduce.compact(flat, o.components, "fastica")
    ids = ["window_id", "subject_id", "activity_id", "activity_name"]
    summary = made.windows.agg(F.count("*").alias("num_windows"), F.array(*[F.lit(c) for c in channels]).alias("channels"))
    sinks.write_preprocessed(made.windows, made.features, made.scaler, made.windows.select(*ids, "start_timestamp", "end_timestamp"), summary, o.output_dir, compact)
    if made.normalized is not None:
        made.normalized.write.mode("overwrite").partitionBy("subject_id").parquet(f"{o.output_dir}/normalized_windows")


def run_dataset(spark: SparkSession, o: argparse.Namespace) -> None:
    c = config.load_config(o.config)
    windows, _, _ = sensor.load_preprocessed(spark, c.data.preprocessed_dir)
    made = preprocess.build_dataset(windows, list(o.channels or DEFAULT_CHANNELS), c)
    tagged = windows.join(made.embeddings.select("window_id", "split"), "window_id")
    manifest = made.embeddings.groupBy("split").agg(F.count("*").alias("num_windows"))
    sinks.write_dataset(made.embeddings, made.texts, tagged, manifest, c.data.output_dir, reduce.summary(made.model), split.split_profile(tagged))
    sensor.save_model(made.model, f"{c.data.output_dir}/reducer")
    made.model.unpersist()


def run_filter(spark: SparkSession, o: argparse.Namespace) -> None:
    scored: DataFrame = spark.read.parquet(o.scores)
    sinks.write_filtered(candidates.apply_filters(scored, candidates.parse_filter_specs(o.filters)), o.output_dir)


def run_similarity(spark: SparkSession, o: argparse.Namespace) -> None:
    c = config.load_config(o.config)
    out = o.output_dir or c.similarity.output_dir
    report = evaluate.similarity_report(spark.read.parquet(o.real_windows), spark.read.parquet(o.synthetic_windows), c, o.compute_shr)
    sinks.write_evaluation(report, f"{out}/similarity_metrics", c)


def run_utility(spark: SparkSession, o: argparse.Namespace) -> None:
    c = config.load_config(o.config)
    out = o.output_dir or c.utility.output_dir
    report = evaluate.utility_report(*(spark.read.parquet(p) for p in (o.real_train_windows, o.real_test_windows, o.synthetic_windows)), c)
    sinks.write_evaluation(report, f"{out}/utility_metrics", c)


def run_summarize(spark: SparkSession, o: argparse.Namespace) -> None:
    sinks.save_table(reports.summarize_manifests(spark, o.manifest), o.output)


COMMANDS = {"preprocess": run_preprocess, "dataset": run_dataset, "filter": run_filter, "evaluate-similarity": run_similarity, "evaluate-utility": run_utility, "summarize": run_summarize}


def main(args: Sequence[str] | None = None) -> None:
    o = parser().parse_args(args)
    spark = SparkSession.builder.appName("sensorloom").getOrCreate()
    COMMANDS[o.command](spark, o)


if __name__ == "__main__":
    main()
