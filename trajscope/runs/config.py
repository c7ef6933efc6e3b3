"""What a run is asked to do: a closed set of fields, checked before anything starts."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from ..sources.documents import read_mapping
from .registry import METRICS, predictor_class

REQUIRED = ("model", "data", "output", "metrics", "tasks")
OPTIONAL = ("model_options", "metric_tasks", "candidate_tasks", "checkpoint", "batch_size", "chunk_rows")
DOMAINS = ("id", "env", "emb")


@dataclass(frozen=True)
class RunConfig:
    model: str
    data: str
    output: str
    metrics: dict[str, tuple[str, tuple[str, ...]]]
    tasks: tuple[str, ...]
    model_options: dict = field(default_factory=dict)
    metric_tasks: dict[str, tuple[str, ...]] = field(default_factory=dict)
    candidate_tasks: dict[str, tuple[str, ...]] = field(default_factory=dict)
    checkpoint: str | None = None
    batch_size: int = 1
    #: Queries of a chunk of answers, the most that a killed run loses.
    chunk_rows: int = 1_000_000

    def tasks_of(self, metric: str) -> list[str]:
        """The tasks of a metric: all, or those its scope names."""
        own = self.metric_tasks.get(metric)
        return [t for t in self.tasks if own is None or t in own]


class ConfigError(ValueError):
    pass


def _names(value: object, where: str) -> tuple[str, ...]:
    if not isinstance(value, list) or not value or not all(isinstance(x, str) and x.strip() for x in value) or len(set(value)) != len(value):
        raise ConfigError(f"{where}: a list of different names is wanted")
    return tuple(value)


def _fields(row: dict, required: tuple[str, ...], optional: tuple[str, ...], where: str) -> None:
    missing, unknown = sorted(set(required) - set(row)), sorted(set(row) - set(required) - set(optional))
    if missing or unknown:
        raise ConfigError(f"{where}: missing {missing}, unknown {unknown}")


def _metrics(value: object, where: str) -> dict[str, tuple[str, tuple[str, ...]]]:
    if not isinstance(value, dict) or not value:
        raise ConfigError(f"{where}: metrics with mode and domains are wanted")
    out = {}
    for name, own in value.items():
        if name not in METRICS:
            raise ConfigError(f"{where}: unknown metric {name}")
        if not isinstance(own, dict):
            raise ConfigError(f"{where}.{name}: mode and domains are wanted")
        _fields(own, ("mode", "domains"), (), f"{where}.{name}")
        domains = _names(own["domains"], f"{where}.{name}.domains")
        if own["mode"] not in ("base", "native") or set(domains) - set(METRICS[name].domains if name == "csvc" else DOMAINS):
            raise ConfigError(f"{where}.{name}: mode {own['mode']} or domains {list(domains)} do not exist")
        out[name] = own["mode"], domains
    return out


def _scopes(value: object, known: set[str], where: str) -> dict[str, tuple[str, ...]]:
    if value is None:
        return {}
    if not isinstance(value, dict) or set(value) - known:
        raise ConfigError(f"{where}: lists of tasks for {sorted(known)} are wanted")
    return {m: _names(tasks, f"{where}.{m}") for m, tasks in value.items()}


def parse(row: dict, where: str = "config", base: str = ".") -> RunConfig:
    """A checked configuration; relative paths are meant from `base`."""
    _fields(row, REQUIRED, OPTIONAL, where)
    for name in ("model", "data", "output"):
        if not isinstance(row[name], str) or not row[name].strip():
            raise ConfigError(f"{where}.{name}: a text is wanted")
    try:
        predictor = predictor_class(row["model"])
    except ValueError as e:
        raise ConfigError(f"{where}.model: {e}") from None
    options = row.get("model_options") or {}
    if not isinstance(options, dict):
        raise ConfigError(f"{where}.model_options: settings are wanted")
    _fields(options, predictor.required, predictor.fields, f"{where}.model_options")
    sizes = {name: row.get(name, default) for name, default in (("batch_size", 1), ("chunk_rows", 1_000_000))}
    for name, size in sizes.items():
        if isinstance(size, bool) or not isinstance(size, int) or size < 1:
            raise ConfigError(f"{where}.{name}: a positive whole number is wanted")
    metrics = _metrics(row["metrics"], f"{where}.metrics")
    place = lambda p: p if p is None or "://" in p or os.path.isabs(p) else os.path.normpath(os.path.join(base, p))
    return RunConfig(
        row["model"], place(row["data"]), place(row["output"]), metrics, _names(row["tasks"], f"{where}.tasks"), options,
        _scopes(row.get("metric_tasks"), set(metrics), f"{where}.metric_tasks"), _scopes(row.get("candidate_tasks"), set(metrics) & {"tga_easy", "tga_hard"}, f"{where}.candidate_tasks"), place(row.get("checkpoint")), **sizes,
    )


def load(path: str) -> RunConfig:
    return parse(read_mapping(path), path, os.path.dirname(os.path.abspath(path)))
