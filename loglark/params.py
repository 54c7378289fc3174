"""Validation and defaults of the user-facing parameters."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults of the reports and summaries.
DEFAULT_K = 10
DEFAULT_RATE_SECONDS = 60
DEFAULT_RETENTION = 300
DEFAULT_CMS_WIDTH = 1 << 14
DEFAULT_CMS_DEPTH = 4
DEFAULT_CAPACITY = 1_024


def _whole(name: str, value) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError(f"{name} must be a whole number, got {value!r}")
    if value < 0:
        raise ValueError(f"{name} must not be negative, got {value}")
    return value


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


def top_k(k: int | None = None) -> int:
    """None or 0 means the default. There is no upper limit."""
    return DEFAULT_K if k is None else _whole("k", k) or DEFAULT_K


def report_k(k: int | None = None) -> int:
    return DEFAULT_K if k is None else max(1, _whole("k", k))


def rate_seconds(n: int | None = None) -> int:
    return DEFAULT_RATE_SECONDS if n is None else _whole("n", n)


def report_seconds(n: int | None = None) -> int:
    return max(1, rate_seconds(n))


def retention(seconds: int | None = None, least: int = 0) -> int:
    """Seconds to keep. The default grows to ``least``, the seconds that a rate needs; fewer than that are an error."""
    seconds = 0 if seconds is None else _whole("retention", seconds)
    if seconds and seconds < least:
        raise ValueError(f"a rate over {least} seconds needs a retention of as many, got {seconds}")
    return seconds or max(DEFAULT_RETENTION, least)


def capacity(value: int | None = None) -> int:
    """Summary capacity; 0 becomes 1."""
    value = DEFAULT_CAPACITY if value is None else _whole("capacity", value)
    return value or 1


def positive(name: str, value: int) -> int:
    if _whole(name, value) == 0:
        raise ValueError(f"{name} must be at least 1")
    return value


@dataclass(frozen=True)
class CmsParams:
    width: int = DEFAULT_CMS_WIDTH
    depth: int = DEFAULT_CMS_DEPTH
    seed: int = 0

    def __post_init__(self):
        positive("width", self.width)
        positive("depth", self.depth)
        _whole("seed", self.seed)

    @property
    def cells(self) -> int:
        return self.width * self.depth
