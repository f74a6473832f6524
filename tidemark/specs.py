"""Request objects and the argument rules every query enforces at call time."""

from __future__ import annotations

import datetime as dt
import zoneinfo
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUBJECT = ("subject_id",)

FIELDS = ("value", "start_time_of_day", "end_time_of_day", "interval_minutes")
AGGREGATES = ("mean", "sum", "min", "max", "count", "median", "duration_in_range", "longest_run_in_range")
RANGE_AGGREGATES = ("duration_in_range", "longest_run_in_range")
BUCKETS = ("none", "hour", "day", "week", "month", "day_of_week", "episode")
PAIRING_BUCKETS = ("hour", "day", "week", "month", "episode")


@dataclass(frozen=True)
class Coding:
    """Identity of a signal; both parts are always compared."""

    system: str
    code: str

    def matches(self) -> SparkColumn:
        return (F.col("coding_system") == self.system) & (F.col("coding_code") == self.code)


@dataclass(frozen=True)
class EpisodeSpec:
    """The interval signal whose gap-chained episodes become the buckets."""

    coding: Coding
    gap_seconds: int = 0

    def __post_init__(self) -> None:
        if self.gap_seconds < 0:
            raise ValueError("episode gap_seconds must be >= 0")


@dataclass(frozen=True)
class Column:
    """One column of an aligned table."""

    coding: Coding
    aggregate: str = "mean"
    field: str = "value"
    value_min: float | None = None
    value_max: float | None = None
    gap_seconds: int | None = None
    name: str | None = None

    def __post_init__(self) -> None:
        one_of("aggregate", self.aggregate, AGGREGATES)
        one_of("field", self.field, FIELDS)
        bounds = (self.value_min, self.value_max)
        if self.aggregate in RANGE_AGGREGATES:
            if None in bounds:
                raise ValueError(f"aggregate {self.aggregate!r} requires value_min and value_max")
            if self.value_min > self.value_max:
                raise ValueError("value_min must be <= value_max")
        elif bounds != (None, None):
            raise ValueError(f"value_min/value_max need one of the aggregates {RANGE_AGGREGATES}")
        if self.gap_seconds is not None:
            if self.aggregate != "longest_run_in_range":
                raise ValueError("gap_seconds needs the aggregate 'longest_run_in_range'")
            if self.gap_seconds < 0:
                raise ValueError("gap_seconds must be >= 0")


def keys_of(df: DataFrame, keys: Sequence[str] | None) -> list[str]:
    """The given key columns; by default the subject's, where the table has it."""
    return [k for k in SUBJECT if k in df.columns] if keys is None else list(keys)


def one_of(what: str, value: str, allowed: Sequence[str]) -> None:
    if value not in allowed:
        raise ValueError(f"invalid {what} {value!r}; expected one of {', '.join(allowed)}")


def check_bucket(bucket: str, episode: EpisodeSpec | None, allowed: Sequence[str] = BUCKETS) -> None:
    one_of("bucket", bucket, allowed)
    if bucket == "episode" and episode is None:
        raise ValueError("bucket 'episode' needs an episode spec")
    if bucket != "episode" and episode is not None:
        raise ValueError("an episode spec is only valid with bucket 'episode'")


def check_zone(tz: str) -> str:
    zones = zoneinfo.available_timezones()
    if zones and tz not in zones:
        raise ValueError(f"unknown time zone {tz!r}")
    return tz


def instant(value: str | dt.datetime | SparkColumn) -> SparkColumn:
    """A timestamp column for a request bound; naive datetimes are UTC."""
    if isinstance(value, dt.datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=dt.timezone.utc)
        value = value.isoformat()
    if isinstance(value, str):
        return F.lit(value).cast("timestamp")
    return value


def in_window(start, end, column: str = "effective_start") -> SparkColumn | None:
    """Half-open window predicate on the start instant; an omitted bound is open."""
    parts = []
    if start is not None:
        parts.append(F.col(column) >= instant(start))
    if end is not None:
        parts.append(F.col(column) < instant(end))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0] & parts[1]
