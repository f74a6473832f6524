"""Descriptive statistics of one signal per bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.buckets import bucket_columns, bucket_key, field_value, sort_columns
from tidemark.operators.confidence import confidence_label, flag_provisional
from tidemark.operators.islands import assign_episodes, detect_episodes
from tidemark.operators.ranks import Percentiles, aggregate
from tidemark.plans.observations import select_codings
from tidemark.specs import FIELDS, SUBJECT, Coding, EpisodeSpec, check_bucket, check_zone, in_window, one_of

QUARTILES = (0.25, 0.5, 0.75)


def episodes_of(obs: DataFrame, spec: EpisodeSpec, start=None, end=None, keys: Sequence[str] = SUBJECT) -> DataFrame:
    """Episodes of the spec's coding, from all its intervals in the window."""
    rows = select_codings(obs, [spec.coding])
    window = in_window(start, end)
    if window is not None:
        rows = rows.where(window)
    return detect_episodes(rows, spec.gap_seconds, keys)


def stats(
    obs: DataFrame,
    coding: Coding,
    *,
    start=None,
    end=None,
    field: str = "value",
    bucket: str = "none",
    tz: str = "UTC",
    thresholds: Sequence[float] = (),
    episode: EpisodeSpec | None = None,
    confidence: DataFrame | None = None,
    keys: Sequence[str] = SUBJECT,
    ordered: bool = False,
) -> DataFrame:
    """count, mean, sd, min, max, quartiles and threshold counts per bucket.

    Rows lacking the field are left out; empty buckets do not appear, except
    that bucket ``none`` reports a subject with rows but no values as count 0
    (and one row over no input when there are no keys).
    """
    check_bucket(bucket, episode)
    one_of("field", field, FIELDS)
    check_zone(tz)
    keys = list(keys)

    rows = select_codings(obs, [coding])
    window = in_window(start, end)
    if window is not None:
        rows = rows.where(window)
    needed = [*keys, "effective_start", "effective_end", "value_quantity"]
    if confidence is not None:
        needed.append("archive_key")
    rows = rows.select(*needed)
    rows = flag_provisional(rows, confidence, keys)
    rows = rows.withColumn("_x", field_value(field, tz))
    if bucket != "none":
        rows = rows.where(F.col("_x").isNotNull())
    if bucket == "episode":
        rows = assign_episodes(rows, episodes_of(obs, episode, start, end, keys), keys)
        rows = rows.withColumn("bucket_sort", F.unix_micros("episode_start"))
    else:
        rows = rows.withColumns(bucket_columns(bucket, F.col("effective_start"), tz))
    groups = keys if bucket == "none" else [*keys, *sort_columns(bucket)]
    rows = rows.select(*groups, "_x", "_provisional")

    aggs = [
        F.count("_x").alias("count"),
        F.avg("_x").alias("mean"),
        F.stddev_samp("_x").alias("sd"),
        F.min("_x").alias("min"),
        F.max("_x").alias("max"),
        F.bool_or(F.col("_provisional") & F.col("_x").isNotNull()).alias("_open"),
        *(F.count_if(F.col("_x") < float(t)).alias(f"_below{i}") for i, t in enumerate(thresholds)),
    ]
    out = aggregate(rows, groups, aggs, {"_q": Percentiles("_x", QUARTILES)})

    columns = [F.col(k) for k in keys]
    if bucket != "none":
        columns += [bucket_key(bucket).alias("bucket_key"), F.col("bucket_sort")]
    columns += [F.col(c) for c in ("count", "mean", "sd", "min", "max")]
    columns += [F.col("_q")[i].alias(name) for i, name in enumerate(("p25", "p50", "p75"))]
    if thresholds:
        columns.append(
            F.array(*(
                F.struct(
                    F.lit(float(t)).alias("threshold"),
                    F.col(f"_below{i}").alias("n_below"),
                    (F.col("count") - F.col(f"_below{i}")).alias("n_at_or_above"),
                )
                for i, t in enumerate(thresholds)
            )).alias("thresholds")
        )
    columns.append(confidence_label(F.col("_open")).alias("confidence"))
    out = out.select(*columns)
    if ordered:
        out = out.orderBy(*keys, *(["bucket_sort"] if bucket != "none" else []))
    return out
