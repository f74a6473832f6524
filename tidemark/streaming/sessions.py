"""Episodes of a stream of intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.specs import SUBJECT


def episode_stream(
    intervals: DataFrame, gap_seconds: int = 0, keys: Sequence[str] = SUBJECT, watermark: str = "1 day"
) -> DataFrame:
    """``keys, episode_start, episode_end``, emitted once the watermark has passed an episode.

    A session window whose gap is the interval's own length plus the tolerance
    merges on the largest end. The tolerance counts whole seconds, as in the
    batch operator: it lasts to the last microsecond before one second more.
    """
    if not keys:
        raise ValueError("a streamed session needs at least one key column")
    length = F.unix_micros("effective_end") - F.unix_micros("effective_start")
    gap = F.concat((length + (gap_seconds + 1) * 1_000_000 - 1).cast("string"), F.lit(" microseconds"))
    return (
        intervals.where(F.col("effective_end").isNotNull())
        .withWatermark("effective_start", watermark)
        .groupBy(*keys, F.session_window("effective_start", gap).alias("_session"))
        .agg(F.max("effective_end").alias("episode_end"))
        .select(*keys, F.col("_session.start").alias("episode_start"), "episode_end")
    )
