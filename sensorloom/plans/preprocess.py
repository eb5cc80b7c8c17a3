"""Whole plans: recordings to windows and features, windows to a split text dataset, text to kept windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import text as tx
from sensorloom.operators import candidates, clean, features, reduce, scans, split, windows
from sensorloom.plans.config import PipelineConfig
from sensorloom.schemas import value_columns

ORDER = ["timestamp", "event_id"]


@dataclass
class Preprocessed:
    runs: DataFrame
    windows: DataFrame
    features: DataFrame
    scaler: DataFrame
    normalized: DataFrame | None


def preprocess(recordings: DataFrame, channels: list[str], size: int = 256, stride: int = 128, order: list[str] | None = None, activities: list[int] | None = None, ratio: float = 0.8, gap_factor: float = 3.0, normalization: str = "none", segment_rows: int | None = None) -> Preprocessed:
    """Clean, fill, split into runs, cut windows, compute features; one lazy plan for each table.

    Filling and run detection share the (subject, activity) exchange. Windows and features hold the channels'
    values; with normalization `zscore` there are also windows in units of the scaler. With segment_rows,
    groups of more rows are scanned in segments, and no task holds a whole recording.
    """
    order = order or ["timestamp"]
    rows = recordings if activities is None else clean.select_activities(recordings, activities)
    if segment_rows is None:
        filled = clean.clean(rows, channels, order, ratio)
        runs = clean.assign_runs(filled, order, gap_factor)
    else:
        cut = scans.segmented(clean.valid_rows(rows, channels, ratio), list(clean.GROUP), order[0], segment_rows)
        filled = scans.interpolate_long(cut, channels, order).dropna(subset=channels)
        runs = scans.runs_long(filled, order, gap_factor).drop("__g", "__s")
        filled = filled.drop("__g", "__s")
    cut = windows.sliding_windows(runs, channels, size, stride, order, segment_rows=segment_rows)
    ids = ["window_id", "subject_id", "activity_id", "activity_name"]
    scaler = clean.channel_scaler(filled, channels)
    if normalization not in ("none", "zscore"):
        raise ValueError(f"unknown normalisation: {normalization}")
    return Preprocessed(runs, cut, features.window_features(cut, channels, ids), scaler, windows.zscore(cut, scaler, channels) if normalization == "zscore" else None)


@dataclass
class Dataset:
    model: DataFrame
    embeddings: DataFrame
    texts: DataFrame
    profile: DataFrame


def build_dataset(cut: DataFrame, channels: list[str], config: PipelineConfig) -> Dataset:
    """Split windows, fit the reducer on train, embed all splits, write them as text."""
    d, e = config.data, config.embedding
    chosen = clean.resolve_channels(channels, d.selected_channels, d.selected_channel_prefixes)
    cut = windows.select_window_channels(cut, [channels.index(c) for c in chosen])
    if d.selected_activities:
        cut = cut.where(F.lower("activity_name").isin([a.lower() for a in d.selected_activities]))
    options = dict(train=d.train_subjects, val=d.val_subjects, test=d.test_subjects) if d.split_strategy == "subject" else dict(train=d.train_ratio, val=d.val_ratio, seed=d.random_seed)
    tagged = split.split_windows(cut, d.split_strategy, **options)
    model = reduce.fit(tagged.where("split = 'train'"), chosen, e.method, e.n_components, e.standardization, e.fastica_max_iter, e.fastica_tol).persist()
    width = model.agg(F.sum("n_components")).first()[0]
    ids = ["window_id", "subject_id", "activity_id", "activity_name", "split"]
    embedded = reduce.expand_values(reduce.transform(tagged.select(*ids, "w"), model), width)
    values = value_columns(embedded.columns)
    names = [*ids[:4], *values]
    text = tx.permuted_record(names, values, e.input_tokens_precision, template=e.text_template) if e.permute_columns else tx.record(names, values, e.text_template, e.input_tokens_precision)
    return Dataset(model, embedded, embedded.select(text.alias("text"), *embedded.columns), split.split_profile(tagged))


def prompts(embeddings: DataFrame, config: PipelineConfig) -> DataFrame:
    """Prompt rows of the prompt split, in window order up to the limit."""
    values = value_columns(embeddings.columns)
    rows = split.prefix(embeddings.where(F.col("split") == config.generation.prompt_split), config.generation.max_prompts)
    return rows.select("window_id", "subject_id", "activity_id", "activity_name", tx.prompt(values, config.embedding.text_template).alias("prompt"))


@dataclass
class Generation:
    debug: DataFrame
    kept: DataFrame
    windows: DataFrame
    summary: DataFrame


def generated_to_windows(generated: DataFrame, reference: DataFrame, model: DataFrame, config: PipelineConfig) -> Generation:
    """Parse generated_text rows, filter them against the reference embeddings, decode what is kept.

    generated: candidate_id, window_id, subject_id, activity_id, activity_name, generated_text.
    """
    values = value_columns(reference.columns)
    parsed = tx.parse(generated, "generated_text", values)
    marked = candidates.filter_candidates(parsed, reference, values, factor=config.generation.norm_filter_iqr_factor, keep_duplicates=not config.generation.deduplicate)
    kept = marked.where("filter_reason = 'kept'").select("candidate_id", "window_id", "subject_id", "activity_id", "activity_name", *values)
    packed = kept.select("candidate_id", "window_id", "activity_name", F.array(*values).cast("array<double>").alias("values"))
    return Generation(marked, kept, reduce.inverse(packed, model), candidates.stage_counts(marked))
