"""Calendar buckets in a time zone.

A bucket is carried through the plan as integers (``bucket_sort`` and, for
hours, ``bucket_offset``), so grouping hashes longs instead of strings and
ordering is by instant. The readable key is built after aggregation. All local
times are integer arithmetic on epoch seconds, so they do not depend on the
session time zone.

====================  ===========================================
bucket                ``bucket_sort``
====================  ===========================================
none                  0
hour                  epoch second of the local top of the hour
day / week            epoch day (of the Monday, for weeks)
month                 year * 12 + month - 1
day_of_week           0 (Monday) .. 6
episode               epoch microsecond of the episode start
====================  ===========================================
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import epoch_date, floor_div, two_digits

DAY_SECONDS = 86_400
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def local_seconds(ts: Column, tz: str) -> Column:
    """Wall-clock seconds since 1970-01-01T00:00 local, for an instant."""
    if tz == "UTC":
        return F.unix_seconds(ts)
    return F.unix_seconds(F.from_utc_timestamp(ts, tz))


def bucket_columns(bucket: str, ts: Column, tz: str) -> dict[str, Column]:
    """Integer grouping columns of the calendar bucket that holds ``ts``."""
    if bucket == "none":
        return {"bucket_sort": F.lit(0).cast("bigint")}
    local = local_seconds(ts, tz)
    if bucket == "hour":
        seconds = F.unix_seconds(ts)
        return {
            "bucket_sort": seconds - F.pmod(local, F.lit(3600).cast("bigint")),
            "bucket_offset": local - seconds,
        }
    day = floor_div(local, DAY_SECONDS)
    weekday = F.pmod(day + 3, F.lit(7).cast("bigint"))  # day 0 was a Thursday
    if bucket == "day":
        return {"bucket_sort": day}
    if bucket == "week":
        return {"bucket_sort": day - weekday}
    if bucket == "month":
        date = epoch_date(day)
        return {"bucket_sort": (F.year(date) * 12 + F.month(date) - 1).cast("bigint")}
    if bucket == "day_of_week":
        return {"bucket_sort": weekday}
    raise ValueError(f"{bucket!r} is not a calendar bucket")


def sort_columns(bucket: str) -> list[str]:
    return ["bucket_sort", "bucket_offset"] if bucket == "hour" else ["bucket_sort"]


def bucket_key(bucket: str, sort: str = "bucket_sort", offset: str = "bucket_offset") -> Column:
    """Readable key of the integer bucket columns."""
    s = F.col(sort)
    if bucket == "none":
        return F.lit(None).cast("string")
    if bucket in ("day", "week"):
        return epoch_date(s).cast("string")
    if bucket == "month":
        return F.concat(
            F.lpad(floor_div(s, 12).cast("string"), 4, "0"),
            F.lit("-"),
            two_digits(F.pmod(s, F.lit(12).cast("bigint")) + 1),
        )
    if bucket == "day_of_week":
        return F.element_at(F.array(*map(F.lit, WEEKDAYS)), (s + 1).cast("int"))
    if bucket == "episode":
        return utc_key(floor_div(s, 1_000_000))
    o = F.col(offset)
    label = s + o
    minutes = floor_div(F.abs(o), 60)
    suffix = F.when(o == 0, "Z").otherwise(
        F.concat(
            F.when(o < 0, "-").otherwise("+"),
            two_digits(floor_div(minutes, 60)),
            F.lit(":"),
            two_digits(F.pmod(minutes, F.lit(60).cast("bigint"))),
        )
    )
    hour = floor_div(F.pmod(label, F.lit(DAY_SECONDS).cast("bigint")), 3600)
    return F.concat(
        epoch_date(floor_div(label, DAY_SECONDS)).cast("string"),
        F.lit("T"), two_digits(hour), F.lit(":00:00"), suffix,
    )


def utc_key(seconds: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of an epoch second."""
    in_day = F.pmod(seconds, F.lit(DAY_SECONDS).cast("bigint"))
    return F.concat(
        epoch_date(floor_div(seconds, DAY_SECONDS)).cast("string"),
        F.lit("T"), two_digits(floor_div(in_day, 3600)),
        F.lit(":"), two_digits(F.pmod(floor_div(in_day, 60), F.lit(60).cast("bigint"))),
        F.lit(":"), two_digits(F.pmod(in_day, F.lit(60).cast("bigint"))),
        F.lit("Z"),
    )


def shifted(bucket: str, lag: int, tz: str) -> dict[str, Column]:
    """Bucket columns moved by ``lag`` buckets; hours are re-labelled in ``tz``."""
    if bucket == "hour":
        return bucket_columns("hour", F.timestamp_seconds(F.col("bucket_sort") + lag * 3600), tz)
    step = 7 if bucket == "week" else 1
    return {"bucket_sort": F.col("bucket_sort") + lag * step}


def noon_minutes(ts: Column, tz: str) -> Column:
    """Minutes since local noon, in [0, 1440), so that nights stay linear."""
    in_day = F.pmod(local_seconds(ts, tz), F.lit(DAY_SECONDS).cast("bigint"))
    return F.pmod(in_day / 60.0 - 720.0, F.lit(1440.0))


def interval_seconds() -> Column:
    return F.unix_seconds(F.col("effective_end")) - F.unix_seconds(F.col("effective_start"))


def field_value(field: str, tz: str) -> Column:
    """The numeric input of an aggregate; null where the row lacks the field."""
    if field == "value":
        return F.col("value_quantity")
    if field == "start_time_of_day":
        return noon_minutes(F.col("effective_start"), tz)
    if field == "end_time_of_day":
        return noon_minutes(F.col("effective_end"), tz)
    return interval_seconds() / 60.0
