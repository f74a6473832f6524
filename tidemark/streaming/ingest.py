"""Continuous ingest: new archive blobs become rows, the newest pull of a day wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import schemas
from tidemark.functions.clinical import STAGE_SYSTEM
from tidemark.operators.dedup import day_states, supersede
from tidemark.plans.rebuild import accepted, parse_blobs, rows_of, stage
from tidemark.sources import archive as A
from tidemark.sources.archive import KEY
from tidemark.specs import instant
from tidemark.streaming.state import advance_frontier, read_state, write_state

ARCHIVE_ROWS = schemas.ARCHIVE + ", has_manifest boolean"
DAY = ["source", "document_date"]
PULLS = """
    subject_id string, archive_key string, kind string, source string, original_filename string,
    archived_at timestamp, document_date date, samples_count bigint
"""
ROWS = schemas.OBSERVATIONS + ", source string, document_date date"


def ingest_batch(batch: DataFrame, batch_id: int, root: str, now=None, stage_system: str = STAGE_SYSTEM) -> None:
    """Merge one batch of archive rows into the tables under ``root``.

    ``pulls`` keeps every accepted blob's day and sample count, so day states
    and winners follow from history and a replayed batch changes nothing. Only
    the ``(source, document_date)`` partitions the batch touches are rewritten; each gets
    a row without a key as well, so that a day pulled again without samples loses its rows.
    """
    spark = batch.sparkSession
    if batch.isEmpty():
        return
    parsed = stage(parse_blobs(A.one_per_key(batch), stage_system=stage_system), f"{root}/staging")
    pulls = accepted(
        parsed.where(F.col("route") != A.EXTRACTION),
        "kind", "source", "original_filename", "archived_at", "document_date", "samples_count")

    known = read_state(spark, f"{root}/pulls", PULLS, before=batch_id)
    merged = known.unionByName(pulls).dropDuplicates(KEY)
    write_state(merged, f"{root}/pulls", batch_id)
    merged = read_state(spark, f"{root}/pulls", PULLS, before=batch_id + 1)
    current = supersede(merged)

    days = pulls.select(*DAY).distinct()
    stored = read_rows(spark, root)
    if stored is not None:
        # the stored rows of the touched days, without those the batch brings again
        kept = (
            stored.join(days, [stored[c].eqNullSafe(days[c]) for c in DAY], "left_semi")
            .join(pulls.select(*KEY), KEY, "left_anti")
        )
    fresh = rows_of(parsed, "observations").join(pulls.select(*KEY, *DAY), KEY)
    columns = [c for c in fresh.columns if c not in KEY]
    rows = fresh if stored is None else kept.select(*KEY, *columns).unionByName(fresh)
    rows = rows.join(current.select(*KEY), KEY, "left_semi")
    emptied = days.select(*(F.col(c) if c in DAY else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    rows = rows.unionByName(emptied)
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*DAY).parquet(f"{root}/observations")
    )
    write_state(current, f"{root}/source_documents", batch_id)
    write_state(day_states(merged.where(F.col("samples_count").isNotNull())), f"{root}/source_day_state", batch_id)

    newest = fresh.groupBy("subject_id", F.col("source").alias("source_name")).agg(
        F.max("effective_start").alias("newest_sample"))
    state = read_state(spark, f"{root}/source_state", schemas.SOURCE_STATE, before=batch_id)
    stamp = instant(now) if now is not None else F.current_timestamp()
    write_state(advance_frontier(state, newest, stamp), f"{root}/source_state", batch_id)


def read_rows(spark: SparkSession, root: str) -> DataFrame | None:
    """The stored observations with their source day; None before the first batch."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/observations")
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return None
    return spark.read.schema(ROWS).parquet(f"{root}/observations").where(F.col("archive_key").isNotNull())


def sync_tally(pulls: DataFrame) -> DataFrame:
    """Per subject and source: days pulled and samples seen."""
    return pulls.groupBy("subject_id", "source").agg(
        F.count_distinct("document_date").alias("days_synced"), F.sum("samples_count").alias("total_samples"))


def start_ingest_stream(
    spark: SparkSession, landing: str, root: str, checkpoint: str, now=None, stage_system: str = STAGE_SYSTEM, **trigger
) -> StreamingQuery:
    """Watch a folder of archive rows (Parquet) and merge every batch.

    ``trigger`` is passed on, e.g. ``availableNow=True`` or ``processingTime="5 minutes"``.
    """
    blobs = spark.readStream.schema(ARCHIVE_ROWS).parquet(landing)
    return (
        blobs.writeStream.foreachBatch(lambda df, i: ingest_batch(df, i, root, now, stage_system))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
