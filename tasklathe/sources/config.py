"""Settings: defaults, then a TOML file, then ``TASKLATHE_``-prefixed variables with ``__`` between levels."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Matching:
    num_partitions: int = 4
    branching_factor: int = 3
    max_buffer_per_partition: int = 1000
    task_reader_batch_size: int = 50


@dataclass(frozen=True)
class Scheduler:
    reaper_interval_secs: int = 10
    retry_base_delay_secs: int = 1
    retry_max_delay_secs: int = 3600
    dlq_check_interval_secs: int = 30
    delayed_check_interval_secs: int = 5


@dataclass(frozen=True)
class LogIngester:
    batch_size: int = 100
    flush_interval_ms: int = 500


@dataclass(frozen=True)
class Config:
    matching: Matching = field(default_factory=Matching)
    scheduler: Scheduler = field(default_factory=Scheduler)
    log_ingester: LogIngester = field(default_factory=LogIngester)


def load(path: str | None = None, environ: Mapping[str, str] | None = None, prefix: str = "TASKLATHE_") -> Config:
    """The settings; unknown names are left aside, a value of the wrong kind is an error."""
    told: dict = {}
    if path:
        with open(path, "rb") as file:
            told = tomllib.load(file)
    for key, value in (os.environ if environ is None else environ).items():
        if key.startswith(prefix) and "__" in key[len(prefix) :]:
            section, name = key[len(prefix) :].lower().split("__", 1)
            told.setdefault(section, {})[name] = value
    parts = {}
    for part in fields(Config):
        kind = part.default_factory
        parts[part.name] = kind(**{f.name: int(told[part.name][f.name]) for f in fields(kind) if f.name in told.get(part.name, {})})
    return Config(**parts)
