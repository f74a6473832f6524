"""Discovery, latest and history reads over coded observations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clinical import coding_values
from tidemark.operators.confidence import confidence_label, flag_provisional
from tidemark.specs import SUBJECT, Coding, in_window


def select_codings(obs: DataFrame, codings: Sequence[Coding]) -> DataFrame:
    """Rows of any of the codings; a coding listed twice counts once."""
    codings = list(dict.fromkeys(codings))
    if not codings:
        raise ValueError("at least one coding is required")
    # the plain code list is what prunes partitions and row groups
    by_code = F.col("coding_code").isin(sorted({c.code for c in codings}))
    return obs.where(by_code).where(reduce(or_, (c.matches() for c in codings)))


def codings(obs: DataFrame, keys: Sequence[str] = SUBJECT, *, ordered: bool = False) -> DataFrame:
    """Per coding: row count, earliest and latest start."""
    out = obs.groupBy(*keys, "coding_system", "coding_code").agg(
        F.count("*").alias("count"),
        F.min("effective_start").alias("earliest"),
        F.max("effective_start").alias("latest"),
    )
    return out.orderBy(*keys, "coding_system", "coding_code") if ordered else out


def latest(
    obs: DataFrame,
    coding: Coding | None = None,
    keys: Sequence[str] = SUBJECT,
    confidence: DataFrame | None = None,
) -> DataFrame:
    """The newest observation per coding; ties go to the greatest (archive_key, seq)."""
    if coding is not None:
        obs = select_codings(obs, [coding])
    rest = [c for c in obs.columns if c not in {*keys, "coding_system", "coding_code"}]
    newest = obs.groupBy(*keys, "coding_system", "coding_code").agg(
        F.max_by(F.struct(*rest), F.struct("effective_start", "archive_key", "seq")).alias("_row")
    )
    rows = newest.select(*keys, "coding_system", "coding_code", "_row.*")
    return _with_confidence(rows, confidence, keys)


def history(
    obs: DataFrame,
    codings: Sequence[Coding],
    start=None,
    end=None,
    keys: Sequence[str] = SUBJECT,
    confidence: DataFrame | None = None,
    *,
    ordered: bool = True,
) -> DataFrame:
    """Every row of the codings in the half-open window, by coding and start."""
    rows = select_codings(obs, codings)
    window = in_window(start, end)
    if window is not None:
        rows = rows.where(window)
    rows = _with_confidence(rows, confidence, keys)
    if ordered:
        rows = rows.orderBy(*keys, "coding_system", "coding_code", "effective_start", "archive_key", "seq")
    return rows


def with_labels(obs: DataFrame, stage_system: str | None = None) -> DataFrame:
    """Add ``value_label`` from the value dictionary of the package's own codings."""
    values = coding_values(obs.sparkSession, stage_system).select(
        "coding_system", "coding_code", "value_quantity", F.col("label").alias("value_label")
    )
    return obs.join(
        F.broadcast(values), ["coding_system", "coding_code", "value_quantity"], "left"
    )  # five fixed rows


def _with_confidence(rows: DataFrame, confidence: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    return flag_provisional(rows, confidence, keys).withColumn(
        "confidence", confidence_label(F.col("_provisional"))
    ).drop("_provisional")
