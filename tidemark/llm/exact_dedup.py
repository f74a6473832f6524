"""Exact deduplication by an extendible-hash index on shared files (DataFrame functions only).

1. One pass counts bytes per cell of a hash directory of ``2**MAX_DEPTH`` cells. A bucket is a
   prefix of the hash; buckets above the capacity are split, each split doubling the
   directory's resolution there, until they fit or the directory is at its full depth.
2. A bucket that still does not fit, such as one holding a text with very many copies, gets
   overflow pages. One task owns a page: it compares whole texts byte by byte, so that texts
   whose hashes collide are chained as entries of their own.
3. The entries of all pages are merged and written to the shared folder as the index.

The directory has at most ``2**MAX_DEPTH`` rows whatever the input, which is what allows it
to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import fresh, sha256_hex, stored, text_or_empty

MAX_DEPTH = 14
CELLS = 1 << MAX_DEPTH
#: Bytes of text that one owner task is given at most, one longer text aside.
BUCKET_BYTES = 32 << 20


def _cell(hash_column: Column) -> Column:
    return F.shiftrightunsigned(hash_column, 64 - MAX_DEPTH).cast("int")


def directory(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Cells of the directory: ``cell``, local ``depth``, ``bucket`` (a prefix), ``pages``.

    All cells of a bucket of depth d share the upper d bits. An empty input has no cells.
    """
    weights = (
        docs.select(_cell(F.xxhash64(text_or_empty())).alias("cell"), (F.octet_length(text_or_empty()) + 64).alias("weight"))
        .groupBy("cell").agg(F.sum("weight").alias("weight"))
    )
    weights = stored(weights, "dedup-directory")
    sums = weights.select("cell", *(
        F.sum("weight").over(Window.partitionBy(F.shiftright("cell", MAX_DEPTH - d))).alias(f"at_{d}")
        for d in range(1, MAX_DEPTH + 1)
    ))
    depth = F.coalesce(*(F.when(F.col(f"at_{d}") <= bucket_bytes, d) for d in range(1, MAX_DEPTH + 1)), F.lit(MAX_DEPTH))
    pages = F.ceil(F.col(f"at_{MAX_DEPTH}") / bucket_bytes).cast("int")
    return sums.select("cell", depth.alias("depth"), F.greatest(pages, F.lit(1)).alias("pages")).withColumn(
        "bucket", F.expr(f"shiftright(cell, {MAX_DEPTH} - depth)"))


def build_index(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The index of all distinct texts of ``docs(doc_id, text)``, stored in the shared folder.

    Rows: ``bucket``, ``depth``, ``hash``, ``chain`` (0, or more where different texts have one
    hash), ``text_sha256``, ``keep_id`` (largest ``doc_id``; null if all are), ``group_size``.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("hash", F.xxhash64("text"))
    rows = rows.withColumn("cell", _cell(F.col("hash"))).join(F.broadcast(directory(docs, bucket_bytes)), "cell")
    page = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("pages")).cast("int")
    owned = (
        rows.withColumn("page", page).repartition("bucket", "depth", "page")
        .groupBy("bucket", "depth", "page", "hash", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    entries = (
        owned.withColumn("text_sha256", sha256_hex(F.col("text")))
        .groupBy("bucket", "depth", "hash", "text_sha256")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    # Only texts whose 64-bit hashes collide share a window.
    chain = F.row_number().over(Window.partitionBy("bucket", "depth", "hash").orderBy("text_sha256")) - 1
    return stored(entries.withColumn("chain", chain), "dedup-index")


def assign(docs: DataFrame, index: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    A null text counts as empty. Of rows that repeat both id and text one is kept. A null id
    loses against any other; if all ids of a group are null, one of its rows is kept.
    """
    keys = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("hash"), sha256_hex(text_or_empty()).alias("text_sha256"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("hash"))
    return keys.withColumn("nth", nth).join(
        index.select("hash", "text_sha256", "keep_id", "group_size"), ["hash", "text_sha256"],
    ).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256",
    )


def keep_one(docs: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The join is on the id that stays, so that the copies of a frequent text, having other ids,
    are spread over all tasks and find no partner.
    """
    sha, keep, nth = fresh(docs, "text_sha256", "keep_id", "nth")
    stays = index.select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep))
    left = docs.withColumn(sha, sha256_hex(text_or_empty()))
    joined = left.join(stays.withColumnRenamed(sha, sha + "_of"), (F.col(sha) == F.col(sha + "_of")) & F.col("doc_id").eqNullSafe(F.col(keep)))
    once = joined.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", sha).orderBy(keep)))
    return once.filter(F.col(nth) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def exact_dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Which document of each group of equal texts stays; see :func:`assign`."""
    return assign(docs, build_index(docs, bucket_bytes))
