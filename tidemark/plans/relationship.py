"""How two signals move together, bucket by bucket and with a lag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.buckets import shifted, sort_columns
from tidemark.operators.islands import number_rows
from tidemark.operators.lineage import stored
from tidemark.operators.ranks import Percentiles, aggregate, average_ranks
from tidemark.plans.table import aligned_table
from tidemark.specs import PAIRING_BUCKETS, SUBJECT, Column, EpisodeSpec, check_bucket


def lagged_pairs(
    obs: DataFrame,
    x: Column,
    y: Column,
    *,
    start=None,
    end=None,
    bucket: str = "day",
    tz: str = "UTC",
    lag: int = 0,
    episode: EpisodeSpec | None = None,
    keys: Sequence[str] = SUBJECT,
) -> DataFrame:
    """``keys, x, y`` for each bucket's x with the y of the bucket ``lag`` later.

    Buckets without a partner keep a row with both values null, so that a
    subject never disappears from a summary. Calendar buckets pair by key,
    episodes by their position among all episodes, the empty ones included.
    """
    check_bucket(bucket, episode, PAIRING_BUCKETS)
    keys = list(keys)
    table = aligned_table(
        obs, [x, y], start=start, end=end, bucket=bucket, tz=tz, episode=episode, keys=keys
    )
    vx, vy = (c for c in table.columns if c not in {*keys, "bucket_key", "bucket_sort", "bucket_offset", "confidence"})
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    if lag == 0:
        pairs = table.select(*keys, F.col(vx).alias("_x"), F.col(vy).alias("_y"))
        return pairs.select(*keys, F.when(both, F.col("_x")).alias("x"), F.when(both, F.col("_y")).alias("y"))

    if bucket == "episode":
        table = number_rows(table, "bucket_sort", "_at", keys)
        at, moved = {"_at": F.col("_at")}, {"_at": F.col("_at") + lag}
    else:
        at = {f"_{c}": F.col(c) for c in sort_columns(bucket)}
        moved = {f"_{name}": column for name, column in shifted(bucket, lag, tz).items()}

    def entry(where: dict[str, SparkColumn], is_x: bool) -> SparkColumn:
        none = F.lit(None).cast("double")
        return F.struct(
            *(column.alias(name) for name, column in where.items()),
            (F.col(vx) if is_x else none).alias("_x"),
            (none if is_x else F.col(vy)).alias("_y"),
        )

    # each bucket lists its x under the shifted key and its y under its own,
    # so that pairing is one grouping and the table is computed once
    listed = table.select(*keys, F.inline(F.array(entry(moved, True), entry(at, False))))
    # two hours can share a shifted label only where a zone moves by less than an hour
    matched = listed.groupBy(*keys, *at).agg(
        F.collect_list("_x").alias("_xs"), F.max("_y").alias("_y")
    )
    pairs = matched.select(*keys, F.explode_outer("_xs").alias("_x"), "_y")
    return pairs.select(*keys, F.when(both, F.col("_x")).alias("x"), F.when(both, F.col("_y")).alias("y"))


def relationship(
    obs: DataFrame,
    x: Column,
    y: Column,
    *,
    start=None,
    end=None,
    bucket: str = "day",
    tz: str = "UTC",
    lag: int = 0,
    threshold: float | None = None,
    episode: EpisodeSpec | None = None,
    keys: Sequence[str] = SUBJECT,
) -> DataFrame:
    """n_pairs, Pearson and Spearman correlation, means and deviations per subject.

    With ``threshold`` the y values are also summarised for x below it and for
    x at or above it. A correlation is null for fewer than two pairs or a
    constant signal.
    """
    keys = list(keys)
    pairs = lagged_pairs(
        obs, x, y, start=start, end=end, bucket=bucket, tz=tz, lag=lag, episode=episode, keys=keys
    )
    # pairs are read for each ranking and each percentile; the table they come from is built once
    pairs = stored(pairs, "pairs")
    ranked = average_ranks(pairs, keys, {"x": "_rx", "y": "_ry"})

    aggs = [
        F.count("x").alias("n_pairs"),
        _correlation("x", "y").alias("pearson_r"),
        _correlation("_rx", "_ry").alias("spearman_r"),
        F.avg("x").alias("x_mean"), F.stddev_samp("x").alias("x_sd"),
        F.avg("y").alias("y_mean"), F.stddev_samp("y").alias("y_sd"),
    ]
    sides = {}
    if threshold is not None:
        sides = {"x_below": F.col("x") < threshold, "x_at_or_above": F.col("x") >= threshold}
        for side, condition in sides.items():
            value = F.when(condition, F.col("y"))
            aggs += [
                F.count(value).alias(f"{side}_count"),
                F.avg(value).alias(f"{side}_mean"),
                F.stddev_samp(value).alias(f"{side}_sd"),
                F.min(value).alias(f"{side}_min"),
                F.max(value).alias(f"{side}_max"),
            ]
    out = ranked.groupBy(*keys).agg(*aggs)
    if not sides:
        return out
    halves = {f"_{side}": Percentiles(f"_y_{side}", (0.5,), f"_p_{side}_") for side in sides}
    sided = pairs.select(*keys, *(F.when(condition, F.col("y")).alias(f"_y_{side}") for side, condition in sides.items()))
    middle = aggregate(sided, keys, [], halves)
    columns = [c for c in out.columns if not c.startswith(tuple(sides))]
    if keys:
        out = out.join(middle, keys, "left")
    else:
        out = out.withColumn("_middle", middle.select(F.struct(*halves)).scalar()).select("*", "_middle.*")
    for side in sides:
        out = out.withColumn(f"{side}_p50", F.col(f"_{side}")[0])
        columns += [f"{side}_{name}" for name in ("count", "mean", "sd", "min", "max", "p50")]
    return out.select(*columns)


def _correlation(x: str, y: str) -> SparkColumn:
    """Covariance over deviations; the built-in ``corr`` fails on a constant signal."""
    deviations = F.sqrt(F.var_pop(x) * F.var_pop(y))
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), deviations))
