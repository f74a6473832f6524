"""Narrative texts, frozen extraction artifacts and claim verification.

The text of a narrative arrives as text; decoding a file format is not done here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.clinical import ICD10_CM
from tidemark.functions.text import any_anchored, date_spellings, normalize_space
from tidemark.sources.archive import KEY
from tidemark.specs import keys_of


def parse_artifact(text: Column) -> Column:
    return F.from_json(text, schemas.EXTRACTION_ARTIFACT)


def artifact_problem(artifact: Column) -> Column:
    missing = artifact.isNull()
    for name in ("document", "codings", "extractor", "extracted_at"):
        missing = missing | artifact[name].isNull()
    return F.when(missing, "malformed extraction artifact")


def newest_artifacts(artifacts: DataFrame) -> DataFrame:
    """One artifact per referenced document: the latest archived.

    ``artifacts`` has ``subject_id, archive_key, archived_at, artifact``; the
    result is keyed by the *document's* archive key.
    """
    return (
        artifacts.groupBy("subject_id", F.col("artifact.document").alias("document_key"))
        .agg(F.max_by("artifact", F.struct("archived_at", "archive_key")).alias("artifact"))
        .select("subject_id", F.col("document_key").alias("archive_key"), "artifact")
    )


def artifact_problems(applied: DataFrame) -> DataFrame:
    """Problem rows of applied artifacts; the status of an extracted coding is unknown."""
    return applied.select(
        *KEY, F.col("artifact.document_date").alias("_onset"), F.posexplode("artifact.codings").alias("seq", "_c")
    ).select(
        *KEY, F.col("seq").cast("bigint").alias("seq"),
        F.col("_c.system").alias("coding_system"), F.col("_c.code").alias("coding_code"),
        F.col("_c.display").alias("coding_display"), F.lit("unknown").alias("status"),
        F.col("_onset").alias("onset_date"), F.col("_c.section_label").alias("section_label"),
    )


def verify_claims(
    claims: DataFrame, texts: DataFrame, on: str = "archive_key", keys: Sequence[str] | None = None
) -> DataFrame:
    """Check coded claims against the text they cite.

    ``claims``: ``keys, on, code, quote`` (+ anything); ``texts``: ``keys, on, text``, where ``keys`` are
    the subject's by default, if the texts have it. Adds
    ``verified``, ``reject_reason`` and, for verified claims, ``coding_system``.
    Claims of a document that is absent are rejected as unsupported quotes.
    """
    # the shorter column travels normalised; the document is matched whole
    both = [*keys_of(texts, keys), on]
    joined = claims.join(texts.select(*both, normalize_space(F.col("text")).alias("_text")), both, "left")
    code, quote = F.col("code"), normalize_space(F.col("quote"))
    reason = (
        F.when(code.isNull() | (normalize_space(code) == ""), "empty code")
        .when(quote.isNull() | (quote == ""), "empty quote")
        .when(~F.coalesce(F.col("_text").contains(quote), F.lit(False)), "quote not in text")
        .when(~quote.contains(code), "code not in quote")
    )
    return (
        joined.withColumn("reject_reason", reason)
        .withColumn("verified", F.col("reject_reason").isNull())
        .withColumn("coding_system", F.when(F.col("verified"), F.lit(ICD10_CM)))
        .drop("_text")
    )


def verify_dates(
    claims: DataFrame, texts: DataFrame, on: str = "archive_key", keys: Sequence[str] | None = None
) -> DataFrame:
    """Check claimed document dates: ``on, document_date, document_date_quote``.

    The quote has to be in the text and to spell the date, not as a part of a
    longer number. Adds ``reject_reason`` (null for no claim) and ``verified``.
    """
    both = [*keys_of(texts, keys), on]
    joined = claims.join(texts.select(*both, normalize_space(F.col("text")).alias("_text")), both, "left")
    date, quote = F.col("document_date"), normalize_space(F.col("document_date_quote"))
    supported = F.coalesce(F.col("_text").contains(quote), F.lit(False)) & F.coalesce(
        any_anchored(quote, date_spellings(date)), F.lit(False))
    reason = F.when(date.isNotNull() & quote.isNull(), "no supporting quote").when(
        date.isNotNull() & ~supported, "quote not in text or date not in quote")
    return (
        joined.withColumn("reject_reason", reason)
        .withColumn("verified", date.isNotNull() & F.col("reject_reason").isNull())
        .drop("_text")
    )
