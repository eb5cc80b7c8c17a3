"""Scans: recordings as text, manifests, JSON lines, training logs, models, and adapters of plain tables."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.schemas import RAW_COLUMNS


def subject_of(file_name: Column) -> Column:
    """All digits of the file's stem as one integer; null when there are none."""
    stem = F.regexp_replace(F.element_at(F.split(file_name, "/"), -1), r"\.[^.]*$", "")
    return F.regexp_replace(stem, r"\D", "").try_cast("int")


def clean_number(c: Column) -> Column:
    """Double, with text that is no number, NaN and infinities as null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def read_recordings(spark: SparkSession, path: str, subjects: list[int] | None = None) -> DataFrame:
    """Whitespace-separated `.dat` files of 54 columns with subject_id and source_file.

    Files of other subjects are pruned by their name before any is opened; rows of
    another width are refused when the plan runs.
    """
    lines = spark.read.option("pathGlobFilter", "*.dat").text(path).select("value", F.col("_metadata.file_name").alias("source_file"))
    lines = lines.withColumn("subject_id", subject_of(F.col("source_file")))
    if subjects is not None:
        lines = lines.where(F.col("subject_id").isin(list(subjects)))
    parts = lines.where(F.trim("value") != "").withColumn("p", F.split(F.trim("value"), r"\s+"))
    wrong = F.raise_error(F.concat(F.lit("expected 54 columns in "), F.col("source_file")))
    parts = parts.withColumn("p", F.when(F.size("p") == len(RAW_COLUMNS), F.col("p")).otherwise(wrong))
    cols = [clean_number(F.col("p")[i]).alias(c) for i, c in enumerate(RAW_COLUMNS)]
    return parts.select(*cols, "subject_id", "source_file").withColumn("activity_id", F.coalesce(F.col("activity_id"), F.lit(0)).cast("int"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(index, line) of the non-blank stripped lines, 0-based in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("index", "line"))
    return lines


def manifest_entry(spark: SparkSession, path: str, index: int) -> str:
    row = read_manifest(spark, path).where(F.col("index") == index).first()
    if row is None:
        raise IndexError(f"no entry {index} in {path}")
    return row["line"]


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON records, blank lines skipped."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_csv_files(spark: SparkSession, paths: DataFrame, name: str = "*.csv") -> DataFrame:
    """path, listed, error, header and rows (maps of text) of each distinct path: small CSV files with a header, each by itself.

    Only files whose name matches `name` are opened.

    The driver lists the paths' folders, so an absent file costs no failed read. A file that cannot be
    opened or is no CSV text has an error and no rows; the others are not touched by it.
    """
    wanted = paths.select("path").distinct()
    folders = [r[0] for r in wanted.select(F.regexp_replace("path", "/[^/]*$", "")).distinct().collect()]
    found = {f: n for folder in folders for f, n in _sizes(spark, f"{folder}/{name}").items()}
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/+", "/"), "/+", "/")
    schema = "path string, listed boolean, error string, header array<string>, rows array<map<string,string>>"
    listed = spark.createDataFrame(list(found.items()), "file string, size long").select(plain(F.col("file")).alias("key"), "size")
    filled = [f for f, n in found.items() if n]
    opened = spark.createDataFrame([], "key string, content binary")
    if filled:
        opened = spark.read.format("binaryFile").option("ignoreCorruptFiles", True).load(filled).select(plain(F.col("path")).alias("key"), "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, size, content in zip(pdf["asked"], pdf["size"], pdf["content"], strict=True):
                header, rows, error = None, None, None
                if size == 0:
                    error = "the file has no content"
                elif size > 0 and content is None:
                    error = "the file could not be opened"
                elif size > 0:
                    try:
                        header, *lines = [r for r in csv.reader(content.decode("utf-8").splitlines(), strict=True) if r]
                        if any(len(r) > len(header) for r in lines):
                            raise ValueError("a row has more fields than the header")
                        rows = [dict(zip(header, r, strict=False)) for r in lines]
                    except (UnicodeDecodeError, ValueError, csv.Error) as e:
                        header, error = None, str(e) or type(e).__name__
                out.append((path, size >= 0, error, header, rows))
            yield pd.DataFrame(out, columns=["path", "listed", "error", "header", "rows"])

    names = wanted.select(F.col("path").alias("asked"), plain(F.col("path")).alias("key"))
    met = names.join(listed, "key", "left").join(opened, "key", "left").select("asked", F.coalesce("size", F.lit(-1)).alias("size"), "content")
    return met.mapInPandas(parse, schema)


def _sizes(spark: SparkSession, pattern: str) -> dict[str, int]:
    """Files that match the pattern, in any store that Spark reads, with their lengths."""
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(here)
    return {f.getPath().toString(): f.getLen() for f in found or () if f.isFile()}


def read_training_log(spark: SparkSession, csv: str, state: str, checkpoints: list[str] = ()) -> DataFrame:
    """step, loss, eval_loss from the first source that has rows: CSV, trainer state, checkpoint states."""
    schema = T.StructType([T.StructField("step", T.LongType()), T.StructField("loss", T.DoubleType()), T.StructField("eval_loss", T.DoubleType())])
    logs = T.StructType([T.StructField("log_history", T.ArrayType(schema))])
    for path in (csv, state, *checkpoints):
        try:
            if path == csv:
                names = spark.read.option("header", True).csv(path)
                found = names.select(*[names[c].cast(schema[c].dataType).alias(c) if c in names.columns else F.lit(None).cast(schema[c].dataType).alias(c) for c in schema.names])
            else:
                found = spark.read.schema(logs).option("multiLine", True).json(path).select(F.inline("log_history"))
            if not found.isEmpty():
                return found
        except Exception as e:  # a source that is absent is passed over
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.createDataFrame([], schema)


def split_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a training loss, rows with an evaluation loss."""
    return log.where("loss is not null"), log.where("eval_loss is not null")


def save_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """Reducer states, one row a channel; columns of older files that are missing are null."""
    model = spark.read.parquet(path)
    for name, kind in (("mixing", "array<array<double>>"), ("explained_variance_ratio", "array<double>")):
        if name not in model.columns:
            model = model.withColumn(name, F.lit(None).cast(kind))
    return model


def load_preprocessed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows, window features and summary, as write_preprocessed left them."""
    return spark.read.parquet(f"{path}/windows"), spark.read.parquet(f"{path}/window_features"), read_json(spark, f"{path}/summary")


def channel_names(spark: SparkSession, path: str) -> list[str]:
    return read_json(spark, path).select("channel_schema.selected_channels").first()[0]


def load_config_file(path: str) -> dict:
    """A configuration file in JSON, or in the YAML subset of nested mappings, lists and scalars."""
    text = Path(path).read_text(encoding="utf-8")
    return json.loads(text) if text.lstrip().startswith("{") else _yaml(text)


def _scalar(v: str):
    v = v.strip().strip("'\"")
    known = {"true": True, "false": False, "null": None, "~": None, "": None}
    if v.lower() in known:
        return known[v.lower()]
    if v.startswith("["):
        return [_scalar(x) for x in v[1:-1].split(",") if x.strip()]
    for kind in (int, float):
        try:
            return kind(v)
        except ValueError:
            pass
    return v


def _yaml(text: str) -> dict:
    root: dict = {}
    stack: list[tuple[int, object, object, str]] = [(-1, root, None, "")]
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        indent = len(body) - len(body.lstrip())
        item = body.strip()
        while stack[-1][0] >= indent and not (item.startswith("- ") and stack[-1][0] == indent):
            stack.pop()
        _, here, parent, name = stack[-1]
        if item.startswith("- "):
            if not isinstance(here, list):
                here = []
                parent[name] = here
                stack[-1] = (stack[-1][0], here, parent, name)
            here.append(_scalar(item[2:]))
            continue
        key, _, value = item.partition(":")
        if value.strip():
            here[key.strip()] = _scalar(value)
        else:
            here[key.strip()] = {}
            stack.append((indent, here[key.strip()], here, key.strip()))
    return root


#: Event types in sensor roles: activity ids by name.
EVENT_ACTIVITIES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
EVENT_CHANNELS = ["value", "k"]


def events_as_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table in sensor roles: user, type, time in seconds, channels value and k; every seventh value is null."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ids = F.create_map(*[F.lit(x) for kv in EVENT_ACTIVITIES.items() for x in kv])
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / 1e6
    return ev.select(
        "event_id", F.col("user_id").cast("int").alias("subject_id"), ids[F.col("event_type")].alias("activity_id"), F.col("event_type").alias("activity_name"), seconds.alias("timestamp"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.get_json_object("props", "$.k").cast("double").alias("k"), F.concat(F.lit("user"), F.col("user_id"), F.lit(".dat")).alias("source_file"),
    )


def vectors_as_windows(spark: SparkSession, sf_dir: str, channels: int = 4) -> DataFrame:
    """The embedding table as windows: window_id, activity_name, generated (odd ids) and w, an array of channels."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    width = F.size("embedding") / channels
    w = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.transform(F.slice("embedding", (c * width + 1).cast("int"), width.cast("int")), lambda x: x.cast("double")))
    return e.select(F.col("vec_id").alias("window_id"), F.concat(F.lit("a"), F.col("label")).alias("activity_name"), F.col("label").alias("activity_id"), (F.col("vec_id") % 2 == 1).alias("generated"), w.alias("w"))
