"""Archive to row tables: one pure function of the stored blobs.

Every blob is routed, parsed and flattened into nested rows within the scan
stage (no shuffle). The result can be staged as a table, so that writing five
row tables reads and parses each blob once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clinical import STAGE_SYSTEM
from tidemark.operators.dedup import day_states, supersede
from tidemark.operators.lineage import stored
from tidemark.sources import archive as A
from tidemark.session import send_package
from tidemark.sources import clinical_scan, clinical_xml, heart_rate, narrative, sleep
from tidemark.sources.archive import KEY


def parse_blobs(blobs: DataFrame, *, derived: bool = False, stage_system: str = STAGE_SYSTEM) -> DataFrame:
    """One nested row per blob: ``reject_reason`` or the rows it holds.

    A blob of the derived store is only ever an extraction artifact; anything
    else there is rejected, never guessed at.
    """
    send_package(blobs.sparkSession)
    kind = F.col("kind")
    route = F.when(kind.isin(*A.KINDS), kind).otherwise("unknown")
    if derived:
        route = F.when((kind == A.EXTRACTION) & F.col("has_manifest"), kind).otherwise("unknown")
    text = F.col("content").cast("string")
    df = blobs.select(
        *KEY, "kind", "source", "manifest_subject", "archived_at", "original_filename",
        route.alias("route"),
        F.when(F.is_valid_utf8(text), text).alias("_text"),
    )

    def of(kind_name: str):
        return F.when(F.col("route") == kind_name, F.col("_text"))

    df = df.withColumn("_scanned", clinical_scan.scan(of(A.CLINICAL_XML)))
    scanned = F.col("_scanned")
    plain = clinical_xml.is_plain(scanned)
    df = df.withColumns({
        "_xml": clinical_xml.parse_document(of(A.CLINICAL_XML), scanned),
        "_pages": heart_rate.parse_pages(of(A.HEART_RATE_DAY)),
        "_session": sleep.parse_session(of(A.SLEEP_SESSION)),
        "artifact": narrative.parse_artifact(of(A.EXTRACTION)),
    })
    df = df.withColumns({
        "_root": clinical_xml.root_tag(F.when((F.col("route") == A.CLINICAL_XML) & ~plain, F.col("_text"))),
        "_sections": clinical_xml.sections(F.col("_xml")),
        "_samples": heart_rate.samples(F.col("_pages")),
    })
    s = F.col("_sections")
    df = df.withColumns({
        "_vitals": clinical_xml.vitals(s, scanned), "_results": clinical_xml.results(s, scanned),
        "_problems": clinical_xml.problems(s, scanned), "_medications": clinical_xml.medications(s, scanned),
        "_date": F.col("manifest_subject").try_cast("date"),
    })
    on = F.col("route")
    reason = (
        F.when(on == "unknown", "unknown type")
        .when(F.col("_text").isNull(), "not valid UTF-8")
        .when(
            on == A.CLINICAL_XML,
            F.coalesce(
                clinical_xml.document_problem(F.col("_root"), F.col("_xml"), plain),
                clinical_xml.first_error(*(F.col(c) for c in ("_vitals", "_results", "_problems", "_medications"))),
            ),
        )
        .when(on == A.HEART_RATE_DAY, heart_rate.reject_reason(F.col("_pages"), F.col("_samples"), F.col("_date")))
        .when(on == A.SLEEP_SESSION, sleep.reject_reason(F.col("_session")))
        .when(on == A.EXTRACTION, narrative.artifact_problem(F.col("artifact")))
    )
    observations = (
        F.when(
            on == A.CLINICAL_XML,
            clinical_xml.observation_rows(F.col("_vitals"), F.col("_results")).cast(_OBSERVATION_ROWS),
        )
        .when(on == A.HEART_RATE_DAY, _in_order(heart_rate.observations(F.col("_samples"))))
        .when(on == A.SLEEP_SESSION, _in_order(sleep.observations(F.col("_session"), stage_system)))
    )
    date = (
        F.when(on == A.CLINICAL_XML, clinical_xml.document_date(F.col("_xml"), scanned))
        .when(on == A.SLEEP_SESSION, F.col("_session.day").try_cast("date"))
        .otherwise(F.col("_date"))
    )
    filename = F.coalesce(
        F.col("original_filename"),
        F.when(on == A.HEART_RATE_DAY, F.concat(F.lit("fitbit-hr-"), F.col("manifest_subject"), F.lit(".json")))
        .when(
            on == A.SLEEP_SESSION,
            F.concat(F.lit("oura-sleep-"), F.col("_session.day"), F.lit("-"), F.col("_session.id"), F.lit(".json")),
        ),
    )
    df = df.withColumn("reject_reason", reason)
    good = F.col("reject_reason").isNull()
    return df.select(
        *KEY, "kind", "source", "archived_at", filename.alias("original_filename"), "route", "reject_reason",
        date.alias("document_date"),
        F.when(good, observations).alias("observations"),
        F.when(good, clinical_xml.problem_rows(F.col("_problems"))).alias("problems"),
        F.when(good, clinical_xml.medication_rows(F.col("_medications"))).alias("medications"),
        F.when(good & (on == A.NARRATIVE), F.col("_text")).alias("text"),
        F.when(on == A.SLEEP_SESSION, F.length("_session.sleep_phase_5_min"))
        .when(on == A.HEART_RATE_DAY, F.size("_samples")).cast("bigint").alias("samples_count"),
        F.when(good, F.col("artifact")).alias("artifact"),
    )


_OBSERVATION_FIELDS = (
    "coding_system", "coding_code", "coding_display", "effective_start", "effective_end",
    "value_quantity", "value_string", "value_unit", "seq",
)
_OBSERVATION_ROWS = (
    "array<struct<coding_system: string, coding_code: string, coding_display: string,"
    " effective_start: timestamp, effective_end: timestamp, value_quantity: double,"
    " value_string: string, value_unit: string, seq: bigint>>"
)


def _in_order(rows):
    """Observation structs with the common field order."""
    return F.transform(rows, lambda r: F.struct(*(r[f].alias(f) for f in _OBSERVATION_FIELDS))).cast(
        _OBSERVATION_ROWS)


def stage(parsed: DataFrame, path: str) -> DataFrame:
    """Write the nested rows and read them back, so no later step parses again."""
    parsed.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return parsed.sparkSession.read.schema(parsed.schema).parquet(path)


def rebuild(
    blobs: DataFrame,
    derived: DataFrame | None = None,
    *,
    stage_path: str | None = None,
    stage_system: str = STAGE_SYSTEM,
) -> Mapping[str, DataFrame]:
    """Row tables plus ``rejects`` and ``tally``.

    Superseded pulls of a heart-rate day contribute to the day state only. A
    clinical document with one bad row is rejected as a whole. The newest
    artifact per document sets its date, its title and its coded problems. A blob given
    more than once counts once. Tables that artifacts change read parsed rows twice; these
    are stored then, so each table parses a blob once, and an archive without artifacts
    stores nothing.
    """
    parsed = parse_blobs(A.one_per_key(blobs), stage_system=stage_system)
    if derived is not None:
        parsed = parsed.unionByName(parse_blobs(A.one_per_key(derived), derived=True, stage_system=stage_system))
    if stage_path is not None:
        parsed = stage(parsed, stage_path)

    def of(*routes: str, rows: DataFrame = parsed) -> DataFrame:
        return rows.where(F.col("route").isin(*routes))

    slim = ("kind", "source", "original_filename", "archived_at", "document_date")

    @cache
    def cited() -> bool:
        """Whether there can be artifacts; the kinds alone are read."""
        given = blobs if stage_path is None else parsed
        return derived is not None or not given.where(F.col("kind") == A.EXTRACTION).select("kind").isEmpty()

    @cache
    def shared(*columns: str) -> DataFrame:
        """The parsed rows for a table that reads them more than once."""
        if stage_path is not None or not cited():
            return parsed
        return stored(
            parsed.select(*KEY, *slim, "route", "reject_reason", "samples_count", "artifact", *columns), "parsed")

    def days(rows: DataFrame = parsed):
        return accepted(of(A.HEART_RATE_DAY, rows=rows), *slim, "samples_count")

    def sessions(rows: DataFrame = parsed):
        return accepted(of(A.SLEEP_SESSION, rows=rows), *slim, "samples_count")

    def docs(rows: DataFrame):
        return (
            supersede(days(rows)).select(*KEY, *slim)
            .unionByName(sessions(rows).select(*KEY, *slim))
            .unionByName(accepted(of(A.CLINICAL_XML, A.NARRATIVE, rows=rows), *slim))
        )

    def artifacts(rows: DataFrame):
        found = accepted(of(A.EXTRACTION, rows=rows), "archived_at", "artifact")
        return narrative.newest_artifacts(found).join(docs(rows).select(*KEY), KEY, "left_semi")

    def dated(rows: DataFrame):
        return artifacts(rows).select(
            *KEY, F.col("artifact.document_date").try_cast("date").alias("_date"), F.col("artifact.title").alias("title"))

    def source_documents():
        if not cited():
            return docs(parsed)
        return (
            docs(shared()).join(dated(shared()).drop("title"), KEY, "left")
            .withColumn("document_date", F.coalesce("_date", "document_date"))
            .drop("_date")
        )

    def observations():
        # only heart-rate days can be superseded, so only they are matched again
        current = supersede(days()).select(*KEY)
        day_rows = of(A.HEART_RATE_DAY).select(*KEY, "observations").join(current, KEY, "left_semi")
        found = rows_of(day_rows, "observations").unionByName(
            rows_of(of(A.CLINICAL_XML, A.SLEEP_SESSION), "observations"))
        return found.select(*KEY, "seq", *(f for f in _OBSERVATION_FIELDS if f != "seq"))

    def problems():
        fields = ("seq", "coding_system", "coding_code", "coding_display", "status", "onset_date", "section_label")
        rows = shared("problems")
        listed = rows_of(of(A.CLINICAL_XML, rows=rows), "problems").select(*KEY, *fields)
        return listed.unionByName(narrative.artifact_problems(artifacts(rows))) if cited() else listed

    def medications():
        return rows_of(of(A.CLINICAL_XML), "medications").select(
            *KEY, "seq", "coding_system", "coding_code", "coding_display", "status", "dose", "route",
            "frequency", "start_date", "end_date")

    def narrative_texts():
        texts = accepted(of(A.NARRATIVE), "text")
        titled = (
            texts.join(dated(shared()).drop("_date"), KEY, "left") if cited()
            else texts.withColumn("title", F.lit(None).cast("string"))
        )
        return titled.select(*KEY, "title", "text")

    return Tables(
        source_documents=source_documents,
        observations=observations,
        problems=problems,
        medications=medications,
        narrative_texts=narrative_texts,
        source_day_state=lambda: day_states(days().unionByName(sessions())),
        rejects=lambda: _kept(parsed, F.col("reject_reason").isNotNull(), "kind", "source", "reject_reason"),
        tally=lambda: tally(shared(), docs(shared()) if cited() else None),
    )


class Tables(Mapping):
    """Tables by name, each planned when it is first asked for."""

    def __init__(self, **builders: Callable[[], DataFrame]) -> None:
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def _kept(parsed: DataFrame, condition, *columns: str) -> DataFrame:
    """Rows that satisfy a condition on parsed columns, parsing each blob once.

    A plain filter would be pushed down to the scan together with the parse
    expressions behind it and run them a second time. Here the condition picks
    a one-row list, and the outer generator keeps the filter above it.
    """
    row = F.struct(*KEY, *columns)
    listed = parsed.select(F.inline_outer(F.when(condition, F.array(row))))
    return listed.where(F.col("archive_key").isNotNull())


def accepted(parsed: DataFrame, *columns: str) -> DataFrame:
    return _kept(parsed, F.col("reject_reason").isNull(), *columns)


def rows_of(parsed: DataFrame, column: str) -> DataFrame:
    """The nested rows of accepted blobs; a rejected blob has none."""
    return parsed.select(*KEY, F.inline_outer(column)).where(F.col("coding_code").isNotNull())


def tally(parsed: DataFrame, docs: DataFrame | None) -> DataFrame:
    """Per subject: blobs found, ingested per kind, skipped, artifacts applied.

    A newest artifact whose document is missing counts as skipped; an older
    artifact of the same document counts as neither. ``docs`` is None where
    there are no artifacts.
    """
    good = F.col("reject_reason").isNull()
    ingested = {
        "ccda_ingested": A.CLINICAL_XML, "fitbit_ingested": A.HEART_RATE_DAY,
        "oura_ingested": A.SLEEP_SESSION, "narratives_ingested": A.NARRATIVE,
    }
    counts = parsed.groupBy("subject_id").agg(
        F.count("*").alias("blobs_found"),
        *(F.count_if(good & (F.col("route") == kind)).alias(name) for name, kind in ingested.items()),
        F.count_if(~good).alias("_rejected"),
    )
    none = F.lit(0).cast("bigint")
    if docs is None:
        return counts.select(
            "subject_id", "blobs_found", *ingested, F.col("_rejected").alias("blobs_skipped"), none.alias("extractions_applied"))
    newest = narrative.newest_artifacts(
        accepted(parsed.where(F.col("route") == A.EXTRACTION), "archived_at", "artifact"))
    known = docs.select(*KEY).withColumn("_known", F.lit(True))
    applied = newest.join(known, KEY, "left").groupBy("subject_id").agg(
        F.count("_known").alias("extractions_applied"),
        F.count_if(F.col("_known").isNull()).alias("_orphans"),
    )
    return counts.join(applied, "subject_id", "left").select(
        "subject_id", "blobs_found", *ingested,
        (F.col("_rejected") + F.coalesce("_orphans", none)).alias("blobs_skipped"),
        F.coalesce("extractions_applied", none).alias("extractions_applied"),
    )
