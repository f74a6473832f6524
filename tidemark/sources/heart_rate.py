"""Heart-rate day payloads: pages of samples turned into interval rows.

A payload is one day of one subject, so its samples are ordered inside the
row with array functions and no shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.clinical import HEART_RATE_CODE, LOINC

# How a sample becomes an interval.
GAP_CAP_SECONDS = 90
DEFAULT_INTERVAL_SECONDS = 60


def parse_pages(text: Column) -> Column:
    """Nested pages; null unless the payload is a JSON array."""
    return F.from_json(F.when(F.ltrim(text).startswith("["), text), schemas.HEART_RATE_PAGES)


def beats(value: Column) -> Column:
    """Beats per minute of an integer, an integer string or a truncated decimal."""
    return value.try_cast("double").try_cast("bigint")


def samples(pages: Column) -> Column:
    """``array<struct<at, pos, bpm>>`` in time order; a page without points is empty."""
    empty = F.array().cast("array<struct<heartRate: struct<sampleTime: struct<physicalTime: string>, beatsPerMinute: string>>>")
    points = F.flatten(F.transform(pages, lambda p: F.coalesce(p["dataPoints"], empty)))
    listed = F.transform(
        points,
        lambda p, i: F.struct(
            p["heartRate"]["sampleTime"]["physicalTime"].try_cast("timestamp").alias("at"),
            i.alias("pos"),
            beats(p["heartRate"]["beatsPerMinute"]).alias("bpm"),
        ),
    )
    return F.array_sort(listed)


def reject_reason(pages: Column, listed: Column, date: Column) -> Column:
    return (
        F.when(date.isNull(), "manifest has no date")
        .when(pages.isNull(), "not an array of pages")
        .when(F.exists(listed, lambda s: s["at"].isNull()), "invalid sample time")
        .when(F.exists(listed, lambda s: s["bpm"].isNull()), "invalid beats per minute")
    )


def interval_end(start: Column, following: Column, cap_seconds: int, default_seconds: int) -> Column:
    """Next sample's time when it is near enough, else a fixed length after the start."""
    gap = (F.unix_micros(following) - F.unix_micros(start)) < (cap_seconds + 1) * 1_000_000
    return F.when(gap, following).otherwise(start + F.make_dt_interval(secs=F.lit(default_seconds)))


def observations(listed: Column) -> Column:
    """Observation structs: each sample lasts until the next one."""
    return F.transform(
        listed,
        lambda s, i: F.struct(
            i.cast("bigint").alias("seq"),
            F.lit(LOINC).alias("coding_system"),
            F.lit(HEART_RATE_CODE).alias("coding_code"),
            F.lit("Heart rate").alias("coding_display"),
            s["at"].alias("effective_start"),
            interval_end(
                s["at"], F.get(listed, i + 1)["at"], GAP_CAP_SECONDS, DEFAULT_INTERVAL_SECONDS
            ).alias("effective_end"),
            s["bpm"].cast("double").alias("value_quantity"),
            F.lit(None).cast("string").alias("value_string"),
            F.lit("/min").alias("value_unit"),
        ),
    )
