"""Settings of a run, read from JSON or simple YAML: named sections of keys with defaults.

Keys of a section that this engine does not know raise TypeError, or are kept in `unread`
with strict=False; a missing `data` section or a missing required
key raises. Other top-level sections are passed over.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, make_dataclass
from pathlib import Path

from sensorloom.sources.sensor import load_config_file

REQUIRED = object()

# Sections, keys and defaults of run files.
KEYS = {
    "data": {
        "preprocessed_dir": REQUIRED, "output_dir": REQUIRED, "selected_channels": None, "selected_channel_prefixes": None, "selected_activities": None,
        "split_strategy": "subject", "train_subjects": None, "val_subjects": None, "test_subjects": None, "train_ratio": 0.8, "val_ratio": 0.1, "random_seed": 42,
    },
    "embedding": {
        "method": "fastica", "n_components": 3, "variance_explained": 0.7, "standardization": "legacy_timepoint", "fastica_max_iter": 1000, "fastica_tol": 1e-4,
        "input_tokens_precision": 4, "permute_columns": True, "text_template": "fim_template_textual_encoding", "include_context_columns": True,
        "include_window_stats_prompt": False, "window_stats_source": "raw_window", "window_stats": ["mean", "std", "min", "max"], "window_stats_precision": 3,
        "reducer_artifact_name": "reducer.pkl", "scaler_artifact_name": "channel_scaler.json",
    },
    "training": {
        "model_id_or_path": "openai-community/gpt2", "output_dir": "outputs/checkpoints/gpt2", "learning_rate": 8e-5, "num_train_epochs": 10, "per_device_train_batch_size": 8,
        "per_device_eval_batch_size": 8, "gradient_accumulation_steps": 1, "warmup_ratio": 0.03, "weight_decay": 0.01, "logging_steps": 10, "eval_steps": 100, "save_steps": 100,
        "save_total_limit": 3, "seed": 42, "max_seq_length": 1024, "use_fp16": False, "use_bf16": False, "gradient_checkpointing": False, "early_stopping_patience": 5,
        "dataloader_num_workers": 2, "report_to": ["tensorboard"], "peft": {},
    },
    "generation": {
        "prompt_split": "test", "max_new_tokens": 256, "min_new_tokens": 0, "num_return_sequences": 1, "temperature": 1.1, "top_p": 0.95, "top_k": 50, "do_sample": True,
        "repetition_penalty": 1.0, "batch_size": 8, "max_prompts": None, "auto_token_budget": True, "prompt_stats_source": "metadata", "prompt_stats_seed": 42,
        "norm_filter_iqr_factor": 3.0, "deduplicate": True, "output_dir": "outputs/generated/default",
    },
    "similarity": {
        "max_lag": 32, "max_samples_per_activity": 128, "dtw_window": None, "random_seed": 42, "output_dir": "outputs/evaluation/similarity", "mdd_bins": 50, "compute_shr": False,
        "shr_seed": 42, "shr_basis_count": 20, "shr_lambda": 0.1, "shr_basis_ratio": 0.25, "shr_c": 100.0, "shr_epsilon": 1e-5, "shr_max_iter": 1000, "shr_max_inner_iter": 5,
        "shr_max_samples_per_activity": None, "shr_channel_mode": "mean",
    },
    "utility": {"classifier": "random_forest", "random_seed": 42, "output_dir": "outputs/evaluation/utility", "n_estimators": 300, "max_depth": None},
    "plots": {"output_dir": "outputs/plots", "max_examples_per_activity": 3, "embedding_scatter_max_points": 1000},
}


def _section(name: str, keys: dict) -> type:
    made = []
    for key, default in keys.items():
        if default is REQUIRED:
            made.append((key, object))
        elif isinstance(default, (list, dict)):
            made.append((key, object, field(default_factory=lambda d=default: d.copy())))
        else:
            made.append((key, object, field(default=default)))
    return make_dataclass(f"{name.title()}Config", made, module=__name__)


DataConfig, EmbeddingConfig, TrainingConfig, GenerationConfig, SimilarityConfig, UtilityConfig, PlotsConfig = (_section(n, k) for n, k in KEYS.items())
SECTIONS = dict(zip(KEYS, (DataConfig, EmbeddingConfig, TrainingConfig, GenerationConfig, SimilarityConfig, UtilityConfig, PlotsConfig), strict=True))


@dataclass
class PipelineConfig:
    data: DataConfig
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    training: TrainingConfig = field(default_factory=TrainingConfig)
    generation: GenerationConfig = field(default_factory=GenerationConfig)
    similarity: SimilarityConfig = field(default_factory=SimilarityConfig)
    utility: UtilityConfig = field(default_factory=UtilityConfig)
    plots: PlotsConfig = field(default_factory=PlotsConfig)
    unread: dict = field(default_factory=dict)


def from_dict(raw: dict, strict: bool = True) -> PipelineConfig:
    if "data" not in raw:
        raise KeyError("data")
    made, unread = {}, {}
    for name, kind in SECTIONS.items():
        values, known = raw.get(name) or {}, {f.name for f in fields(kind)}
        extra = {k: v for k, v in values.items() if k not in known}
        if extra and strict:
            raise TypeError(f"unknown keys in {name}: {sorted(extra)}")
        unread |= {f"{name}.{k}": v for k, v in extra.items()}
        made[name] = kind(**{k: v for k, v in values.items() if k in known})
    return PipelineConfig(**made, unread=unread)


def load_config(path: str, strict: bool = True) -> PipelineConfig:
    return from_dict(load_config_file(path), strict)


def resolved(config: PipelineConfig) -> dict:
    """All settings with their values, as from_dict takes them."""
    return {k: v for k, v in asdict(config).items() if k != "unread"}


def save_config(config: PipelineConfig, path: str) -> None:
    """The resolved settings as JSON, which load_config reads back."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(resolved(config), indent=2, ensure_ascii=False), encoding="utf-8")
