"""Provisional / confirmed status of source days, documents and result rows.

Wearable sources keep revising recent days. A day of the heart-rate source is
settled by stability (two equal pulls, data past the day's end), a day of the
sleep source by elapsed time; every other source is confirmed by policy.
``now`` is always an argument, so results repeat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.buckets import DAY_SECONDS
from tidemark.functions.numbers import epoch_date, floor_div
from tidemark.specs import SUBJECT, instant

# Source names as they appear in manifests, and the rule windows.
HEART_RATE_SOURCE = "fitbit"
SLEEP_SOURCE = "oura"
FORCE_REFRESH_DAYS = 5
DAY_END_BUFFER_HOURS = 36
SLEEP_SETTLE_HOURS = 24


def _utc_date(ts: Column) -> Column:
    return epoch_date(floor_div(F.unix_seconds(ts), DAY_SECONDS))


def stability_provisional(
    now, date: Column, frontier: Column, samples: Column, samples_prev: Column
) -> Column:
    """Heart-rate rule: recent, unreached, unseen twice or still changing."""
    day_start = F.unix_date(date).cast("bigint") * (DAY_SECONDS * 1_000_000)
    reached = F.unix_micros(frontier) >= day_start + DAY_END_BUFFER_HOURS * 3_600_000_000
    stable = samples == samples_prev
    return (
        (F.datediff(_utc_date(instant(now)), date) < FORCE_REFRESH_DAYS)
        | ~F.coalesce(reached, F.lit(False))
        | ~F.coalesce(stable, F.lit(False))
    )


def elapsed_provisional(now, date: Column) -> Column:
    """Sleep rule: provisional until a day after the date has ended."""
    until = (F.unix_date(date).cast("bigint") + 1) * DAY_SECONDS + SLEEP_SETTLE_HOURS * 3600
    return F.unix_micros(instant(now)) < until * 1_000_000


def day_confidence(
    docs: DataFrame,
    source_state: DataFrame,
    day_state: DataFrame,
    now,
    keys: Sequence[str] = SUBJECT,
    *,
    stability_sources: Sequence[str] = (HEART_RATE_SOURCE,),
    elapsed_sources: Sequence[str] = (SLEEP_SOURCE,),
) -> DataFrame:
    """``keys, source, document_date, is_provisional`` for every wearable source day."""
    days = (
        docs.where(F.col("source").isin(*stability_sources, *elapsed_sources))
        .where(F.col("document_date").isNotNull())
        .select(*keys, "source", "document_date")
        .distinct()
    )
    frontier = source_state.select(
        *keys, F.col("source_name").alias("source"), "freshness_frontier_at"
    )
    counts = day_state.select(
        *keys, F.col("source_name").alias("source"), F.col("date").alias("document_date"),
        "samples_count", "samples_count_prev",
    )
    rule = F.when(
        F.col("source").isin(*elapsed_sources), elapsed_provisional(now, F.col("document_date"))
    ).otherwise(
        stability_provisional(
            now, F.col("document_date"), F.col("freshness_frontier_at"),
            F.col("samples_count"), F.col("samples_count_prev"),
        )
    )
    return (
        days.join(counts, [*keys, "source", "document_date"], "left")
        .join(frontier, [*keys, "source"], "left")
        .select(*keys, "source", "document_date", rule.alias("is_provisional"))
    )


def provisional_documents(
    docs: DataFrame, days: DataFrame, keys: Sequence[str] = SUBJECT
) -> DataFrame:
    """``keys, archive_key`` of documents on provisional days.

    Only provisional documents are listed: they are the recent few, and absence
    means confirmed, so the join to observations stays small on this side.
    """
    open_days = days.where("is_provisional").select(*keys, "source", "document_date")
    return docs.join(open_days, [*keys, "source", "document_date"], "left_semi").select(
        *keys, "archive_key"
    )


def flag_provisional(
    rows: DataFrame, confidence: DataFrame | None, keys: Sequence[str] = SUBJECT
) -> DataFrame:
    """Add the boolean ``_provisional`` from a ``provisional_documents`` result."""
    if confidence is None:
        return rows.withColumn("_provisional", F.lit(False))
    marked = confidence.select(*keys, "archive_key").distinct().withColumn("_mark", F.lit(True))
    return (
        rows.join(marked, [*keys, "archive_key"], "left")
        .withColumn("_provisional", F.col("_mark").isNotNull())
        .drop("_mark")
    )


def confidence_label(provisional: Column) -> Column:
    return F.when(provisional, "provisional").otherwise("confirmed")


def days_to_fetch(
    requested: DataFrame, covered: DataFrame, settled: DataFrame, keys: Sequence[str] = SUBJECT
) -> DataFrame:
    """Requested days that are not both covered and settled.

    ``requested`` has ``keys, source, start_date, end_date`` (inclusive);
    ``covered`` and ``settled`` have ``keys, source, date``.
    """
    on = [*keys, "source", "date"]
    days = requested.select(
        *keys, "source", F.explode(F.sequence("start_date", "end_date")).alias("date")
    )
    done = covered.select(*on).join(settled.select(*on), on, "left_semi")
    return days.join(done, on, "left_anti")
