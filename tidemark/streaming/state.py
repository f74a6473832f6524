"""Keyed state tables that a stream rewrites batch by batch.

A state table is a folder of complete versions, ``version=<batch id>``. A batch
reads the newest version older than itself and writes its own, so a replayed
batch starts from the same state and a half-written version is never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Ids of the complete versions, ascending."""
    root, fs = _folder(spark, path)
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(done):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def read_state(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The newest complete version (older than ``before``); empty when there is none."""
    usable = [v for v in versions(spark, path) if before is None or v < before]
    if not usable:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/version={usable[-1]}")


def write_state(df: DataFrame, path: str, version: int, keep: int = 3) -> None:
    """Write one version and drop those no replay can need."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/version={version}")
    root, fs = _folder(spark, path)
    for old in [v for v in versions(spark, path) if v < version][:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"version={old}"), True)


def advance_frontier(state: DataFrame, pulled: DataFrame, now, keys=("subject_id",)) -> DataFrame:
    """Move each source's frontier to its newest sample; it never moves back.

    ``pulled``: ``keys, source_name, newest_sample``. ``frontier_last_advanced_at``
    is stamped only where the frontier moved.
    """
    from tidemark.specs import instant

    on = [*keys, "source_name"]
    fresh = pulled.groupBy(*on).agg(F.max("newest_sample").alias("_new"))
    joined = state.join(fresh, on, "full_outer")
    old, new = F.col("freshness_frontier_at"), F.col("_new")
    moved = new.isNotNull() & (old.isNull() | (new > old))
    columns = {
        "freshness_frontier_at": F.greatest(old, new),
        "frontier_last_advanced_at": F.when(moved, instant(now)).otherwise(F.col("frontier_last_advanced_at")),
        "consecutive_sync_failures": F.coalesce("consecutive_sync_failures", F.lit(0).cast("bigint")),
    }
    return joined.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in state.columns))


def fold_outcomes(state: DataFrame, outcomes: DataFrame, keys=("subject_id",)) -> DataFrame:
    """Fold sync outcomes into the source state; frontier and window columns stay.

    ``outcomes``: ``keys, source_name, at, ok, error_message, error_reason``. A
    success resets the failure count, each later error adds one.
    """
    on = [*keys, "source_name"]
    last = outcomes.groupBy(*on).agg(
        F.max(F.when(F.col("ok"), F.col("at"))).alias("_ok_at"),
        F.max_by(F.struct("at", "ok", "error_message", "error_reason"), F.struct("at", "ok")).alias("_last"),
    )
    later = (F.col("_ok_at").isNull() | (F.col("at") > F.col("_ok_at"))) & ~F.col("ok")
    failed = outcomes.join(last.select(*on, "_ok_at"), on).groupBy(*on).agg(F.count_if(later).alias("_errors"))
    joined = state.join(last.join(failed, on), on, "full_outer")
    seen, ok = F.col("_last").isNotNull(), F.col("_last.ok")
    before = F.when(F.col("_ok_at").isNull(), F.coalesce("consecutive_sync_failures", F.lit(0))).otherwise(0)
    columns = {
        "last_sync_at": F.when(seen, F.col("_last.at")).otherwise(F.col("last_sync_at")),
        "last_sync_status": F.when(seen, F.when(ok, "success").otherwise("error")).otherwise(F.col("last_sync_status")),
        "last_error_message": F.when(seen, F.when(~ok, F.col("_last.error_message"))).otherwise(F.col("last_error_message")),
        "last_error_reason": F.when(seen, F.when(~ok, F.col("_last.error_reason"))).otherwise(F.col("last_error_reason")),
        "consecutive_sync_failures": F.when(seen, before + F.col("_errors"))
        .otherwise(F.col("consecutive_sync_failures")).cast("bigint"),
    }
    return joined.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in state.columns))
