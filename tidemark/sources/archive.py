"""The content-addressed archive: blobs named by their SHA-256, with manifests.

Layout: ``<root>/[subject_id=<id>/]<sha256>`` next to ``<sha256>.meta.json``.
Archive rows have the columns of ``schemas.ARCHIVE``; they can be kept as a
Parquet table as well, which suits many small blobs better than files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.lineage import stored
from tidemark.specs import SUBJECT

KEY_PATTERN = "^[0-9a-f]{64}$"
KEY = ["subject_id", "archive_key"]

# Manifest types.
CLINICAL_XML = "ccda"
HEART_RATE_DAY = "fitbit-intraday-hr-day"
SLEEP_SESSION = "oura-sleep-session"
NARRATIVE = "clinical-pdf"
EXTRACTION = "narrative-extraction"
KINDS = (CLINICAL_XML, HEART_RATE_DAY, SLEEP_SESSION, NARRATIVE, EXTRACTION)
#: Source recorded for a blob that has no manifest.
REBUILD_SOURCE = "rebuild"


def content_key(content: Column) -> Column:
    return F.sha2(content, 256)


def is_key(name: Column) -> Column:
    return name.rlike(KEY_PATTERN)


def scan_blobs(spark: SparkSession, root: str, subject: str = "default") -> DataFrame:
    """``subject_id, archive_key, content, modified_at`` of every well-named blob."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*[0-9a-f]")  # leaves the manifests unread
        .load(root)
    )
    name = F.regexp_extract("path", "([^/]+)$", 1)
    who = F.col("subject_id").cast("string") if "subject_id" in files.columns else F.lit(subject)
    return files.where(is_key(name)).select(
        who.alias("subject_id"), name.alias("archive_key"), "content",
        F.col("modificationTime").alias("modified_at"),
    )


def scan_manifests(spark: SparkSession, root: str, subject: str = "default") -> DataFrame:
    """One row per manifest file, keyed by the blob it sits next to."""
    files = (
        spark.read.schema(schemas.MANIFEST)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.meta.json")
        .json(root)
    )
    who = F.col("subject_id").cast("string") if "subject_id" in files.columns else F.lit(subject)
    return files.select(
        who.alias("subject_id"),
        F.regexp_extract("_metadata.file_name", r"^([0-9a-f]{64})\.meta\.json$", 1).alias("archive_key"),
        F.col("type").alias("kind"),
        "source",
        F.col("subject").alias("manifest_subject"),
        F.col("time").try_cast("timestamp").alias("archived_at"),
        F.col("originalfilename").alias("original_filename"),
        F.lit(True).alias("has_manifest"),
    )


def attach_manifests(blobs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Archive rows; a blob without manifest counts as clinical XML of unknown source.

    Its archive time is the file's modification time, so a rebuild repeats.
    """
    joined = blobs.join(manifests, KEY, "left")
    missing = F.col("has_manifest").isNull()
    return joined.select(
        *KEY, "content", "modified_at",
        F.when(missing, CLINICAL_XML).otherwise(F.col("kind")).alias("kind"),
        F.when(missing, REBUILD_SOURCE).otherwise(F.col("source")).alias("source"),
        "manifest_subject",
        F.coalesce("archived_at", "modified_at").alias("archived_at"),
        "original_filename",
        F.coalesce("has_manifest", F.lit(False)).alias("has_manifest"),
    )


def scan_archive(spark: SparkSession, root: str, subject: str = "default") -> DataFrame:
    return attach_manifests(scan_blobs(spark, root, subject), scan_manifests(spark, root, subject))


def new_blobs(incoming: DataFrame, stored_keys: DataFrame, row_id: str, keys: Sequence[str] = SUBJECT) -> DataFrame:
    """Incoming rows keyed by content, one per new key.

    ``row_id`` names a column that is unique in ``incoming`` (a path, say). The
    copy to keep is chosen on keys alone and found again by (key, row id), so
    the bytes of a heavily copied blob are never gathered in one task.
    """
    keyed = incoming.withColumn("archive_key", content_key(F.col("content")))
    on = [*keys, "archive_key"]
    kept = (
        keyed.select(*on, row_id).groupBy(*on).agg(F.min(row_id).alias(row_id))
        .join(stored_keys.select(*on), on, "left_anti")
    )
    return keyed.join(kept, [*on, row_id], "left_semi")


def copy_groups(texts: DataFrame, content: str, row_id: str) -> DataFrame:
    """Content key, number of copies and first row id of every distinct content."""
    return (
        texts.select(content_key(F.col(content)).alias("archive_key"), row_id)
        .groupBy("archive_key")
        .agg(F.count("*").alias("copies"), F.min(row_id).alias("first_id"))
    )


def one_per_key(blobs: DataFrame) -> DataFrame:
    """Blobs with one row per key: of repeated ones the first archived, ties by manifest.

    A first pass over the keys, which leaves payloads unread, finds the repeated ones and stores
    them. Only rows of those keys are shuffled; where there are none, the blobs pass as they are.
    """
    repeated = stored(blobs.groupBy(*KEY).agg(F.count("*").alias("_n")).where("_n > 1").select(*KEY), "repeated-keys")
    if repeated.isEmpty():
        return blobs
    first = F.struct("archived_at", *(c for c in ("kind", "source", "manifest_subject", "original_filename") if c in blobs.columns))
    rest = [c for c in blobs.columns if c not in KEY]
    again = blobs.join(repeated, KEY, "left_semi").groupBy(*KEY).agg(F.min_by(F.struct(*rest), first).alias("_row"))
    return blobs.join(repeated, KEY, "left_anti").unionByName(again.select(*KEY, "_row.*"))
