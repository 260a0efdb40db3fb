"""Settings of a run: a YAML file with defaults, environment overrides and coercion.

Numbers may come as texts (YAML 1.1 reads ``1e-3`` as one); a value that is no number is an error, except for the
clustering sizes, which fall back to their defaults.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any


def number(kind: type) -> Callable[[Any], Any]:
    def read(x: Any) -> Any:
        if isinstance(x, bool):
            return kind(x)
        try:
            return kind(x) if isinstance(x, (int, float)) else kind(str(x).strip())
        except (TypeError, ValueError):
            raise ValueError(f"expected {kind.__name__}, got {x!r}") from None

    return read


def flag(x: Any) -> bool:
    return str(x).strip().lower() in ("1", "true", "yes", "y", "t")


def optional(read: Callable[[Any], Any]) -> Callable[[Any], Any]:
    return lambda x: None if x is None or str(x).strip().lower() in ("", "null", "none") else read(x)


def lenient(read: Callable[[Any], Any], other: Any) -> Callable[[Any], Any]:
    def run(x: Any) -> Any:
        try:
            return read(x)
        except ValueError:
            return other

    return run


REQUIRED = object()
#: Section, key, environment variable, default (REQUIRED if there is none), reader.
FIELDS: tuple[tuple[str, str, str | None, Any, Callable[[Any], Any]], ...] = (
    ("train", "lr", "LR", REQUIRED, number(float)),
    ("train", "weight_decay", "WEIGHT_DECAY", 0.0, number(float)),
    ("train", "epochs", "EPOCHS", REQUIRED, number(int)),
    ("train", "batch_size", "BATCH_SIZE", REQUIRED, number(int)),
    ("train", "num_workers", "NUM_WORKERS", 0, number(int)),
    ("train", "pin_memory", "PIN_MEMORY", False, flag),
    ("data", "window", "WINDOW", REQUIRED, number(int)),
    ("data", "stride", "STRIDE", REQUIRED, number(int)),
    ("data", "val_size", "VAL_SIZE", REQUIRED, number(float)),
    ("data", "test_size", "TEST_SIZE", REQUIRED, number(float)),
    ("data", "train_size", "TRAIN_SIZE", None, optional(number(float))),
    ("data", "data_dir", "DATA_DIR", REQUIRED, str),
    ("run", "seed", "SEED", REQUIRED, number(int)),
    ("run", "device", "DEVICE", "auto", str),
    ("cluster", "enabled", "CLUSTER_ENABLED", False, flag),
    ("cluster", "source", None, "all", str),
    ("cluster", "vectorizer", None, "tfidf-eid", str),
    ("cluster", "min_cluster_size", None, 10, lenient(number(int), 10)),
    ("cluster", "min_samples", None, None, lenient(optional(number(int)), None)),
    ("cluster", "metric", None, "cosine", str),
    ("cluster", "select_k", None, 3, lenient(number(int), 3)),
    ("distill", "enabled", None, False, flag),
    ("distill", "lambda", None, 0.3, number(float)),
    ("distill", "source", None, "session", str),
    ("distill", "threshold", None, 0.5, number(float)),
    ("distill", "min_conf", None, 0.0, number(float)),
    ("distill", "use_soft", None, False, flag),
    ("llm", "enabled", None, True, flag),
    ("llm", "session_preview_k", None, 20, number(int)),
    ("llm", "max_sessions", None, None, optional(number(int))),
    ("llm", "max_clusters", None, None, optional(number(int))),
    ("llm", "sleep_s", None, 0.0, number(float)),
    ("llm", "use_cache", None, True, flag),
    ("llm", "cross_run_cache", None, True, flag),
    ("llm", "export_prompts", None, False, flag),
)
SECTIONS = ("run", "data", "model", "train", "eval", "cluster", "logrobust", "distill", "llm")


@dataclass(frozen=True)
class Config:
    run: dict = field(default_factory=dict)
    data: dict = field(default_factory=dict)
    model: dict = field(default_factory=dict)
    train: dict = field(default_factory=dict)
    eval: dict = field(default_factory=dict)
    cluster: dict = field(default_factory=dict)
    logrobust: dict = field(default_factory=dict)
    distill: dict = field(default_factory=dict)
    llm: dict = field(default_factory=dict)


def coerced(raw: Mapping[str, Any] | None, env: Mapping[str, str] | None = None) -> Config:
    env = os.environ if env is None else env
    out = {s: dict((raw or {}).get(s) or {}) for s in SECTIONS}
    for section, key, variable, default, read in FIELDS:
        given = env.get(variable) if variable else None
        value = given if given is not None else out[section].get(key, default)
        if value is REQUIRED:
            raise ValueError(f"{section}.{key} is missing")
        out[section][key] = value if value is None else read(value)
    return Config(**out)


def load(path: str, env: Mapping[str, str] | None = None) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return coerced(yaml.safe_load(f), env)
