"""Evaluation of synthetic windows by a run's settings: similarity to real ones, and use as training data."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sensorloom.operators import classify, dictionary, features, metrics, split
from sensorloom.plans.config import PipelineConfig

FOREST_DEPTH = 30  # for settings without a limit


def similarity_report(real: DataFrame, synthetic: DataFrame, config: PipelineConfig, compute_shr: bool = False) -> DataFrame:
    """All similarity metrics by activity with the overall row, of pairs sampled as the `similarity` section says.

    SHR is null unless the section or compute_shr asks for it. Windows: window_id, activity_name, w.
    """
    s = config.similarity
    shr = None
    if compute_shr or s.compute_shr:
        shr = dict(max_samples=s.shr_max_samples_per_activity, seed=s.shr_seed, count=s.shr_basis_count, penalty=s.shr_lambda, ratio=s.shr_basis_ratio, c=s.shr_c, epsilon=s.shr_epsilon, rounds=s.shr_max_iter, inner=s.shr_max_inner_iter, mode=s.shr_channel_mode)
    pairs = split.pair_windows(real, synthetic, s.max_samples_per_activity, s.random_seed)
    of = metrics.shapelets if s.max_samples_per_activity else dictionary.shapelets  # without a limit no activity fits a task
    return metrics.similarity(real, synthetic, pairs, s.max_lag, s.mdd_bins, s.dtw_window, shr, of)


def utility_report(real_train: DataFrame, real_test: DataFrame, synthetic: DataFrame, config: PipelineConfig) -> DataFrame:
    """setting, accuracy, macro_f1, weighted_f1 of forests trained on real, synthetic and both, as the `utility` section says.

    Windows: activity_id, w, all with the same number of channels, which the first training window tells.
    """
    u = config.utility
    if u.classifier != "random_forest":
        raise ValueError(f"unknown classifier: {u.classifier}")
    first = real_train.selectExpr("size(w) AS n").first()
    if first is None:
        raise ValueError("no real windows to train on")
    wide = lambda df: features.har_features(df.withColumnRenamed("activity_id", "label"), first.n, ["label"])
    train, test, made = wide(real_train), wide(real_test), wide(synthetic)
    columns = [c for c in train.columns if c != "label"]
    return classify.forest_utility(train, made, test, columns, u.n_estimators, FOREST_DEPTH if u.max_depth is None else u.max_depth, u.random_seed)
