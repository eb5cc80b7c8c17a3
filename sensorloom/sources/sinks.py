"""Sinks: Parquet tables by subject or split, JSON manifests, Markdown tables, metrics with a backup, versioned tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.plans.config import PipelineConfig, resolved
from sensorloom.plans.reports import best_by


def write_preprocessed(windows: DataFrame, features: DataFrame, scaler: DataFrame, records: DataFrame, summary: DataFrame, path: str, compact: DataFrame | None = None) -> None:
    """The preprocessing tables; raw windows are always among them. The label map has the activities but for 0."""
    labels = windows.select("activity_id", "activity_name").where("activity_id <> 0").distinct()
    labels.coalesce(1).write.mode("overwrite").json(f"{path}/label_map")
    if compact is not None:
        compact.write.mode("overwrite").parquet(f"{path}/compact_embeddings")
    windows.write.mode("overwrite").partitionBy("subject_id").parquet(f"{path}/windows")
    features.write.mode("overwrite").parquet(f"{path}/window_features")
    scaler.write.mode("overwrite").parquet(f"{path}/channel_scaler")
    records.write.mode("overwrite").json(f"{path}/records")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_dataset(embeddings: DataFrame, texts: DataFrame, windows: DataFrame, manifest: DataFrame, path: str, reducer: DataFrame | None = None, profile: DataFrame | None = None) -> None:
    """Embeddings, text records and windows by split; the manifest, and those of the reducer and of the splits when given."""
    for name, df in (("reducer_manifest", reducer), ("split_manifest", profile)):
        if df is not None:
            df.write.mode("overwrite").json(f"{path}/{name}")
    for name, df in (("embeddings", embeddings), ("windows", windows)):
        df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/{name}")
    texts.write.mode("overwrite").partitionBy("split").json(f"{path}/text")
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def write_generation(kept: DataFrame, debug: DataFrame, summary: DataFrame, path: str) -> None:
    kept.write.mode("overwrite").parquet(f"{path}/generated_embeddings")
    debug.write.mode("overwrite").parquet(f"{path}/filter_debug")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_filtered(selected: DataFrame, path: str) -> None:
    """All filters' selections in one table, by filter."""
    selected.write.mode("overwrite").partitionBy("filter_name").parquet(path)


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path in any store that Spark reads."""
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), here


def _rename(spark: SparkSession, source: str, target: str) -> None:
    fs, here = _hadoop(spark, source)
    if not fs.rename(here, _hadoop(spark, target)[1]):
        raise OSError(f"{source} could not become {target}")


def write_metrics(metrics: DataFrame, path: str, backup: str) -> None:
    """Replace the metrics; what was there is kept once under backup.

    The new table is written beside the old one first and takes its place by renames. A write that
    fails leaves the old table where it was; if the job dies between the renames, `recover` finishes them.
    """
    spark = metrics.sparkSession
    staged = f"{path}.next"
    metrics.write.mode("overwrite").parquet(staged)
    _swap(spark, path, staged, backup)


def _swap(spark: SparkSession, path: str, staged: str, backup: str) -> None:
    fs, here = _hadoop(spark, path)
    if fs.exists(here):
        if fs.exists(_hadoop(spark, backup)[1]):
            fs.delete(here, True)
        else:
            _rename(spark, path, backup)
    _rename(spark, staged, path)


def recover(spark: SparkSession, path: str, backup: str) -> None:
    """Finish an interrupted write_metrics: a whole staged table takes its place, a part of one is deleted."""
    staged = f"{path}.next"
    fs, next_ = _hadoop(spark, staged)
    if fs.exists(_hadoop(spark, f"{staged}/_SUCCESS")[1]):
        _swap(spark, path, staged, backup)
    elif fs.exists(next_):
        fs.delete(next_, True)


def commit_table(df: DataFrame, path: str) -> int:
    """A new version of the table under path; its number.

    Data lie in `data/<uuid>`; a version exists once the file `versions/<number>` names them, which one
    rename puts there. Readers take the greatest number, so they see all of a version or none of it, and
    older versions stay readable. Of two writers that take the same number the second one fails.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{name}")
    fs, versions = _hadoop(spark, f"{path}/versions")
    fs.mkdirs(versions)
    number = max(table_versions(spark, path), default=0) + 1
    pending = _hadoop(spark, f"{path}/pending-{name}")[1]
    out = fs.create(pending)
    out.write(bytearray(name.encode()))
    out.close()
    target = _hadoop(spark, f"{path}/versions/{number:010d}")[1]
    if fs.exists(target) or not fs.rename(pending, target):
        fs.delete(pending, False)
        raise OSError(f"version {number} of {path} was committed by another writer")
    return number


def table_versions(spark: SparkSession, path: str) -> list[int]:
    fs, versions = _hadoop(spark, f"{path}/versions")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(versions)) if fs.exists(versions) else []


def committed_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version of a table of `commit_table`, or a given one."""
    found = table_versions(spark, path)
    if not found or version is not None and version not in found:
        raise FileNotFoundError(f"no committed version {version or ''} in {path}")
    name = spark.read.text(f"{path}/versions/{version or found[-1]:010d}").first()[0]
    return spark.read.parquet(f"{path}/data/{name}")


def write_evaluation(report: DataFrame, path: str, config: PipelineConfig) -> None:
    """An evaluation's rows as a new version of its table, as CSV beside it, and the settings they come from."""
    spark = report.sparkSession
    commit_table(report, path)
    save_table(committed_table(spark, path), f"{path}_csv")
    spark.createDataFrame([(json.dumps(resolved(config), ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}_config")


def markdown_table(df: DataFrame, digits: int = 3) -> str:
    """A small table in Markdown; nulls and NaN are blank. For reports of a row for each run only."""

    def cell(v) -> str:
        if v is None or v != v:
            return ""
        return f"{v:.{digits}f}" if isinstance(v, float) else str(v)

    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join(cell(v) for v in row) + " |\n" for row in df.toLocalIterator())


def markdown_report(df: DataFrame, label: str, best: dict[str, str], digits: int = 3) -> str:
    """Bullets of the best row by each metric (`max` or `min`), then the table."""
    rows = {r["metric"]: r for r in best_by(df, label, best).collect()}
    bullets = "".join(f"- Best {m}: {rows[m]['best']} ({rows[m]['value']:.{digits}f})\n" for m in best if m in rows)
    return f"{bullets}\n{markdown_table(df, digits)}"


def save_table(df: DataFrame, path: str) -> None:
    """A small table as CSV with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A one-row table as a single JSON document, which read_json reads back."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def as_json(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(F.to_json(F.struct(*(cols or df.columns))).alias("json"))
