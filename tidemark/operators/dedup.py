"""Which row wins: supersession, replacement and upserts of keyed state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.confidence import HEART_RATE_SOURCE
from tidemark.specs import SUBJECT


def newest(df: DataFrame, keys: Sequence[str], *order: str, keep: int = 1, rank: str = "_rank") -> DataFrame:
    """The ``keep`` last rows per key by ``order``.

    A rank filter is applied before the shuffle too, so a key with very many
    rows sends at most ``keep`` of them per input partition.
    """
    latest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn(rank, F.row_number().over(latest)).where(F.col(rank) <= keep)


def supersede(
    docs: DataFrame, sources: Sequence[str] = (HEART_RATE_SOURCE,), keys: Sequence[str] = SUBJECT
) -> DataFrame:
    """Drop every pull of a source day but the newest.

    Applies to ``sources`` only; documents without a date have no day to be
    superseded by. Equal archive times are decided by the archive key.
    """
    pulled = F.col("source").isin(*sources) & F.col("document_date").isNotNull()
    winners = newest(
        docs.where(pulled), [*keys, "source", "document_date"], "archived_at", "archive_key"
    ).drop("_rank")
    return docs.where(~F.coalesce(pulled, F.lit(False))).unionByName(winners)


def day_states(
    pulls: DataFrame,
    keys: Sequence[str] = SUBJECT,
    sources: Sequence[str] = (HEART_RATE_SOURCE,),
) -> DataFrame:
    """Sample count of the newest and the previous pull of every source day.

    ``pulls``: ``keys, source, document_date, archived_at, archive_key,
    samples_count``. Only ``sources`` track the previous count.
    """
    day = [*keys, "source", "document_date"]
    last_two = newest(
        pulls.where(F.col("document_date").isNotNull()), day, "archived_at", "archive_key", keep=2
    )
    previous = F.max(F.when(F.col("_rank") == 2, F.col("samples_count")))
    return (
        last_two.groupBy(*day)
        .agg(
            F.max(F.when(F.col("_rank") == 1, F.col("samples_count"))).alias("samples_count"),
            previous.alias("samples_count_prev"),
            F.max("archived_at").alias("last_pulled_at"),
        )
        .select(
            *keys, F.col("source").alias("source_name"), F.col("document_date").alias("date"),
            "samples_count",
            F.when(F.col("source").isin(*sources), F.col("samples_count_prev")).alias("samples_count_prev"),
            "last_pulled_at",
        )
    )


def replace_rows(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows of other keys plus all incoming rows (a full-row upsert)."""
    kept = stored.join(incoming.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(incoming)


def merge_columns(
    stored: DataFrame, incoming: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Upsert that overwrites only ``columns``; the other stored columns survive.

    ``incoming`` holds one row per key.
    """
    fresh = incoming.select(*keys, F.struct(*columns).alias("_new"))
    joined = stored.join(fresh, list(keys), "full_outer")
    return joined.select(*(
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
        if c in columns else F.col(c)
        for c in stored.columns
    ))
