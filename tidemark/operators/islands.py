"""Episodes, in-range runs and point-in-episode assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import floor_div
from tidemark.operators.ordered import merged_islands, merged_runs, next_within, positions
from tidemark.sources.heart_rate import DEFAULT_INTERVAL_SECONDS, GAP_CAP_SECONDS, interval_end
from tidemark.specs import SUBJECT


#: Width of the slices under which episodes are listed for points to be looked up.
TIME_SLICE_SECONDS = 6 * 3600


def _tolerance(gap_seconds: int) -> int:
    """The gap counts whole seconds, so a row joins while the difference stays below one second more."""
    if gap_seconds < 0:
        raise ValueError("gap_seconds must be >= 0")
    return (gap_seconds + 1) * 1_000_000


def _micros(df: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    return df.where(F.col("effective_start").isNotNull() & F.col("effective_end").isNotNull()).select(
        *keys,
        *more,
        F.unix_micros("effective_start").alias("_s"),
        F.unix_micros("effective_end").alias("_e"),
    )


def detect_episodes(
    intervals: DataFrame,
    gap_seconds: int = 0,
    keys: Sequence[str] = SUBJECT,
) -> DataFrame:
    """Chain intervals into episodes: ``keys, episode_start, episode_end``.

    An interval joins while its start is at most ``gap_seconds`` after the
    *largest* end seen so far, so overlapping rows never shrink an episode.
    Rows with no end are not intervals and are left out.
    """
    merged = merged_islands(_micros(intervals, keys), keys, _tolerance(gap_seconds))
    return merged.select(
        *keys,
        F.timestamp_micros("_island").alias("episode_start"),
        F.timestamp_micros("_end").alias("episode_end"),
    )


def runs(
    intervals: DataFrame,
    gap_seconds: int = 0,
    keys: Sequence[str] = SUBJECT,
    ties: Sequence[str] = ("archive_key", "seq"),
) -> DataFrame:
    """Chain intervals into runs: ``keys, run_start, run_end, minutes``.

    Unlike an episode, a run compares with and reports the end of the *last*
    row in start order, not the largest end. Equal starts are ordered by
    ``ties``; within such a tie only the last end is visible to the next row.
    """
    ties = [t for t in ties if t in intervals.columns]
    merged = merged_runs(_micros(intervals, keys, *ties), keys, ties, _tolerance(gap_seconds))
    return merged.select(
        *keys,
        F.timestamp_micros("_island").alias("run_start"),
        F.timestamp_micros("_end").alias("run_end"),
        ((F.col("_end") - F.col("_island")) / 60_000_000.0).alias("minutes"),
    )


def assign_episodes(
    points: DataFrame,
    episodes: DataFrame,
    keys: Sequence[str] = SUBJECT,
    ts: str = "effective_start",
) -> DataFrame:
    """Keep the points inside an episode (both ends inclusive), adding ``episode_start``.

    Episodes of a subject are disjoint, so each is listed under the time slices
    it touches and the range condition runs inside an equi-join on the slice.
    A crowded slice is split by the adaptive skew join, since no window needs
    all its points together.
    """
    width = TIME_SLICE_SECONDS
    first = floor_div(F.unix_seconds("episode_start"), width)
    last = floor_div(F.unix_seconds("episode_end"), width)
    listed = episodes.select(
        *keys, "episode_start", "episode_end",
        F.explode(F.sequence(first, F.greatest(first, last))).alias("_slice"),
    )
    at = F.col(ts)
    return (
        points.withColumn("_slice", floor_div(F.unix_seconds(at), width))
        .join(listed, [*keys, "_slice"])
        .where((at >= F.col("episode_start")) & (at <= F.col("episode_end")))
        .drop("_slice", "episode_end")
    )


def number_rows(df: DataFrame, order: str, out: str, keys: Sequence[str] = SUBJECT) -> DataFrame:
    """Add the zero-based position of each row in ``order`` within ``keys``.

    ``order`` is a long column of microseconds without ties.
    """
    return positions(df, keys, order, out)


def next_sample_intervals(
    samples: DataFrame,
    keys: Sequence[str] = ("subject_id", "archive_key"),
    order: str = "seq",
    *,
    cap_seconds: int = GAP_CAP_SECONDS,
    default_seconds: int = DEFAULT_INTERVAL_SECONDS,
) -> DataFrame:
    """Set ``effective_end`` of point samples: the next sample's start when near enough.

    Samples of ``keys`` are ordered by start, then ``order`` (a number). The gap
    counts whole seconds up to ``cap_seconds``; beyond it, and for the last
    sample, the interval has the default length.
    """
    cap = _tolerance(cap_seconds)
    rows = next_within(samples, keys, [F.col(order)], F.unix_micros("effective_start"), cap, "_next")
    end = interval_end(F.col("effective_start"), F.timestamp_micros("_next"), cap_seconds, default_seconds)
    return rows.withColumn("effective_end", end).drop("_next")
