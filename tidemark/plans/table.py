"""Several signals aligned on the same buckets, one row per bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.buckets import bucket_columns, bucket_key, field_value, interval_seconds, sort_columns
from tidemark.operators.confidence import confidence_label, flag_provisional
from tidemark.operators.islands import assign_episodes, runs
from tidemark.operators.ranks import Percentiles, aggregate
from tidemark.plans.observations import select_codings
from tidemark.plans.stats import episodes_of
from tidemark.specs import SUBJECT, Column, EpisodeSpec, check_bucket, check_zone, in_window


def value_name(column: Column, index: int) -> str:
    return column.name or f"value_{index}"


def aligned_table(
    obs: DataFrame,
    columns: Sequence[Column],
    *,
    start=None,
    end=None,
    bucket: str = "day",
    tz: str = "UTC",
    episode: EpisodeSpec | None = None,
    confidence: DataFrame | None = None,
    keys: Sequence[str] = SUBJECT,
    ordered: bool = False,
) -> DataFrame:
    """One value per requested column and bucket, from a single scan.

    Calendar rows exist where any column has observations, episode rows for
    every episode. All columns are conditional aggregates of one grouping, so
    more columns add no scan and no shuffle; only longest-run columns read
    their own intervals once more.
    """
    if not columns:
        raise ValueError("at least one column is required")
    check_bucket(bucket, episode)
    check_zone(tz)
    keys = list(keys)
    episodes = episodes_of(obs, episode, start, end, keys) if bucket == "episode" else None

    rows = select_codings(obs, [c.coding for c in columns])
    window = in_window(start, end)
    if window is not None:
        rows = rows.where(window)

    def bucketed(df: DataFrame, ts: str) -> DataFrame:
        if episodes is not None:
            placed = assign_episodes(df, episodes, keys, ts)
            return placed.withColumn("bucket_sort", F.unix_micros("episode_start"))
        return df.withColumns(bucket_columns(bucket, F.col(ts), tz))

    groups = [*keys, *sort_columns(bucket)]
    inputs = bucketed(flag_provisional(rows, confidence, keys), "effective_start").select(
        *groups,
        "_provisional",
        F.lit(True).alias("_seen"),
        *(expr.alias(name) for name, expr in _inputs(columns, tz).items()),
    )
    for i, c in enumerate(columns):
        if c.aggregate == "longest_run_in_range":
            chained = runs(
                rows.where(c.coding.matches() & F.col("value_quantity").between(c.value_min, c.value_max)),
                c.gap_seconds or 0,
                keys,
            )
            longest = bucketed(chained, "run_start").select(*groups, F.col("minutes").alias(f"_run{i}"))
            inputs = inputs.unionByName(longest, allowMissingColumns=True)

    medians = [i for i, c in enumerate(columns) if c.aggregate == "median"]
    aggs = [
        F.bool_or("_provisional").alias("_open"),
        F.count("_seen").alias("_seen"),
        *(_reduced(c, i).alias(f"_v{i}") for i, c in enumerate(columns) if i not in medians),
    ]
    if medians:
        out = aggregate(inputs, groups, aggs, {f"_m{i}": Percentiles(f"_x{i}", (0.5,), f"_p{i}_") for i in medians})
        out = out.withColumns({f"_v{i}": F.col(f"_m{i}")[0] for i in medians})
    else:
        out = inputs.groupBy(*groups).agg(*aggs)
    out = out.where(F.col("_seen") > 0)

    if episodes is not None:
        every = episodes.select(*keys, F.unix_micros("episode_start").alias("bucket_sort"))
        out = every.join(out, groups, "left")
    result = out.select(
        *keys,
        bucket_key(bucket).alias("bucket_key"),
        *sort_columns(bucket),
        *(F.col(f"_v{i}").alias(value_name(c, i)) for i, c in enumerate(columns)),
        confidence_label(F.col("_open")).alias("confidence"),
    )
    return result.orderBy(*groups) if ordered else result


def _inputs(columns: Sequence[Column], tz: str) -> dict[str, SparkColumn]:
    """Per column ``i``: ``_r{i}`` marks its rows, ``_x{i}`` holds its aggregate input."""
    has_end = F.col("effective_end").isNotNull()
    out: dict[str, SparkColumn] = {}
    for i, c in enumerate(columns):
        mine = c.coding.matches()
        if c.aggregate in ("duration_in_range", "longest_run_in_range"):
            out[f"_r{i}"] = F.when(mine & has_end, F.lit(True))
        else:
            out[f"_r{i}"] = F.when(mine, F.lit(True))
        if c.aggregate == "duration_in_range":
            in_range = F.col("value_quantity").between(c.value_min, c.value_max)
            out[f"_x{i}"] = F.when(mine & in_range & has_end, interval_seconds())
        elif c.aggregate == "longest_run_in_range":
            out[f"_run{i}"] = F.lit(None).cast("double")
        else:
            out[f"_x{i}"] = F.when(mine, field_value(c.field, tz))
    return out


def _reduced(c: Column, i: int) -> SparkColumn:
    """Aggregate of one column: null without rows, zero where rows exist but none count."""
    x = F.col(f"_x{i}")
    has_rows = F.count(f"_r{i}") > 0
    simple = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    if c.aggregate in simple:
        return simple[c.aggregate](x)
    if c.aggregate == "count":
        return F.when(has_rows, F.count(x).cast("double"))
    if c.aggregate == "duration_in_range":
        return F.when(has_rows, F.coalesce(F.sum(x), F.lit(0)) / 60.0)
    # a run never counts as shorter than nothing
    return F.when(has_rows, F.greatest(F.max(f"_run{i}"), F.lit(0.0)))
