"""Settings that are checked when they are made: a wrong one raises with the name of what is wrong."""

from __future__ import annotations

import json
import logging
import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

_SEMVER = re.compile(r"\d+\.\d+\.\d+")
TOLERANCE = 1e-6


def weights(of: Mapping[str, float], what: str = "weights") -> dict[str, float]:
    """Weights that are not negative and sum to 1."""
    if any(w < 0 or not math.isfinite(w) for w in of.values()):
        raise ValueError(f"{what} must not be negative")
    if abs(sum(of.values()) - 1) > TOLERANCE:
        raise ValueError(f"{what} must sum to 1")
    return dict(of)


def increasing(of: Sequence[float], what: str = "thresholds") -> tuple[float, ...]:
    if any(not a < b for a, b in zip(of, of[1:])):
        raise ValueError(f"{what} must be strictly increasing")
    return tuple(of)


def windows(of: Sequence[int], what: str = "windows") -> tuple[int, ...]:
    """Positive, different and ascending numbers of matches; at least one."""
    if not of or any(n < 1 for n in of):
        raise ValueError(f"{what} must be positive")
    return tuple(int(n) for n in increasing(of, what))


def version(text: str, what: str = "version") -> str:
    if not _SEMVER.fullmatch(text):
        raise ValueError(f"{what} must be three numbers joined by dots, not {text!r}")
    return text


@dataclass(frozen=True)
class FeatureSettings:
    """What feature snapshots, datasets and their export are made with."""

    windows: tuple[int, ...] = (5, 10, 20)
    half_life_days: float = 90.0
    min_observations: int = 1
    train: float = 0.6
    validation: float = 0.2
    test: float = 0.2
    export_precision: int = 6
    schema_version: str = "1.0.0"
    builder_version: str = "1.0.0"

    def __post_init__(self) -> None:
        windows(self.windows)
        weights({"train": self.train, "validation": self.validation, "test": self.test}, "shares of a split")
        for name in ("schema_version", "builder_version"):
            version(getattr(self, name), name)
        if self.half_life_days <= 0 or self.min_observations < 1 or self.export_precision < 0:
            raise ValueError("half_life_days, min_observations and export_precision must be positive")


@dataclass(frozen=True)
class ImportSettings:
    """How an import validates, and what it does with what it can't accept."""

    batch_size: int = 100
    strict: bool = True
    warnings: str = "accept"
    allow_future: bool = False
    tolerance_seconds: int = 60
    window_seconds: int = 300
    checkpoint_version: str = "1.0.0"
    statuses: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        version(self.checkpoint_version, "checkpoint_version")
        if self.warnings not in ("accept", "warn", "reject"):
            raise ValueError("warnings is accept, warn or reject")
        if self.batch_size < 1 or self.tolerance_seconds < 0 or self.window_seconds < 0:
            raise ValueError("batch_size must be positive, tolerances not negative")


class JsonLog(logging.Formatter):
    """Log records as JSON: timestamp (UTC), level, logger, message and, if there is one, exception."""

    def format(self, record: logging.LogRecord) -> str:
        from datetime import datetime, timezone

        out = {"timestamp": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out, ensure_ascii=False)
