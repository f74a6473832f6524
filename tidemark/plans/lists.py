"""Deduplicated problem and medication lists with provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.specs import SUBJECT


def _current(
    rows: DataFrame, docs: DataFrame, details: Sequence[str], keys: Sequence[str], *, labels: bool, ordered: bool
) -> DataFrame:
    """One row per coding, from its newest document; a missing date is oldest.

    Equal dates are decided by archive time, then archive key, then the row's
    position. Rows are grouped by document first, where they lie together after the
    caller's joins, so that counting documents moves no row again; dates and the
    subject's newest one reach the rows with the document's.
    """
    keys = list(keys)
    on, coding = [*keys, "archive_key"], [*keys, "coding_system", "coding_code"]
    aggs = [F.max_by(F.struct(*details), F.struct("seq")).alias("_details")]
    if labels:
        aggs.append(F.sort_array(F.collect_set("section_label")).alias("_labels"))
    listed = rows.groupBy(*on, "coding_system", "coding_code").agg(*aggs)
    dates = docs.groupBy(*on).agg(
        F.max(F.struct("document_date", "archived_at")).alias("_at"), F.min("document_date").alias("_first"))
    dated = listed.join(with_latest_document_date(dates, docs, keys), on)
    aggs = [
        F.max_by("_details", F.struct("_at", "archive_key")).alias("_newest"),
        F.count("archive_key").alias("document_count"),
        F.min("_first").alias("first_seen"),
        F.max("_at.document_date").alias("last_seen"),
    ]
    if labels:
        aggs.append(F.sort_array(F.array_distinct(F.flatten(F.collect_set("_labels")))).alias("section_labels"))
    out = dated.groupBy(*coding).agg(*aggs, F.max("latest_document_date").alias("latest_document_date")).select(
        *coding, "_newest.*", "document_count", "first_seen", "last_seen",
        *(["section_labels"] if labels else []), "latest_document_date",
    )
    return out.orderBy(*coding) if ordered else out


def with_latest_document_date(df: DataFrame, docs: DataFrame, keys: Sequence[str] = SUBJECT) -> DataFrame:
    """Add the subject's newest document date over all its documents."""
    newest = docs.groupBy(*keys).agg(F.max("document_date").alias("latest_document_date"))
    if keys:
        return df.join(newest, list(keys), "left")
    return df.withColumn("latest_document_date", newest.scalar())


def current_problems(
    problems: DataFrame, docs: DataFrame, keys: Sequence[str] = SUBJECT, *, ordered: bool = False
) -> DataFrame:
    """Problems by coding: newest display, status and onset, documents, first and last seen, section labels."""
    details = ("coding_display", "status", "onset_date")
    return _current(problems, docs, details, keys, labels=True, ordered=ordered)


def current_medications(
    medications: DataFrame, docs: DataFrame, keys: Sequence[str] = SUBJECT, *, ordered: bool = False
) -> DataFrame:
    """Medications by coding: newest display, status, dose, route and period, with provenance."""
    details = ("coding_display", "status", "dose", "route", "start_date", "end_date")
    return _current(medications, docs, details, keys, labels=False, ordered=ordered)
