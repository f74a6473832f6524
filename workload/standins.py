"""The test tables seen as observations, documents, lists, payloads and state.

Every function is a plain projection of whole tables (with a grouping where a
per-day table is needed), so the work of a query grows with its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dedup import day_states
from tidemark.operators.islands import next_sample_intervals
from tidemark.specs import Coding

SYSTEM = "urn:events"
NOW = "2024-01-25T12:00:00Z"
CLICK, ERROR, PURCHASE, SIGNUP, VIEW = (
    Coding(SYSTEM, t) for t in ("click", "error", "purchase", "signup", "view"))
INTERVAL_CAP, INTERVAL_DEFAULT = 6 * 3600, 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as point observations of the user."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject_id"),
        F.concat_ws("/", "user_id", "event_type", ts.cast("date")).alias("archive_key"),
        F.col("event_id").alias("seq"),
        F.lit(SYSTEM).alias("coding_system"),
        F.col("event_type").alias("coding_code"),
        ts.alias("effective_start"),
        F.lit(None).cast("timestamp").alias("effective_end"),
        F.col("value").alias("value_quantity"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as intervals, each lasting until the user's next of its type."""
    return next_sample_intervals(
        observations(spark, sf_dir), ("subject_id", "coding_code"),
        cap_seconds=INTERVAL_CAP, default_seconds=INTERVAL_DEFAULT,
    )


def source_of(event_type) -> F.Column:
    return F.when(event_type == "click", "fitbit").when(event_type == "view", "oura").otherwise("clinic")


def pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pulls of every (user, type, day): the morning's samples, then all of them."""
    obs = observations(spark, sf_dir)
    days = obs.groupBy("subject_id", "archive_key", "coding_code", F.to_date("effective_start").alias("document_date")).agg(
        F.count_if(F.hour("effective_start") < 12).alias("_morning"), F.count("*").alias("_all"))
    pull = lambda name, hours, count: F.struct(
        F.lit(name).alias("pull"),
        F.timestamp_seconds(F.unix_date("document_date") * 86400 + hours * 3600).alias("archived_at"),
        F.col(count).alias("samples_count"),
    )
    return days.select(
        "subject_id", F.col("archive_key").alias("_doc"), source_of(F.col("coding_code")).alias("source"), "document_date",
        F.inline(F.array(pull("first", 12, "_morning"), pull("second", 30, "_all"))),
    ).select(
        "subject_id", F.concat_ws("#", "_doc", "pull").alias("archive_key"), "source", "document_date", "archived_at", "samples_count")


def documents_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per (user, type, day), matching ``archive_key`` of the observations."""
    return observations(spark, sf_dir).select(
        "subject_id", "archive_key", source_of(F.col("coding_code")).alias("source"),
        F.to_date("effective_start").alias("document_date"),
    ).distinct()


def source_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and source: the newest sample is the frontier, errors count as failures."""
    obs = observations(spark, sf_dir).withColumn("source_name", source_of(F.col("coding_code")))
    failing = F.count_if((F.col("coding_code") == "error") & (F.col("value_quantity") > 150))
    return obs.groupBy("subject_id", "source_name").agg(
        F.max("effective_start").alias("freshness_frontier_at"),
        F.max("effective_start").alias("frontier_last_advanced_at"),
        failing.alias("consecutive_sync_failures"),
        F.when(F.max("value_quantity") > 300, "reauth_required").alias("last_error_reason"),
    )


def day_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_states(pulls(spark, sf_dir))


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clinical documents of the customer."""
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("archive_key"),
        F.lit("ccda").alias("kind"),
        F.col("o_orderpriority").alias("source"),
        at.alias("archived_at"), at.cast("date").alias("document_date"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as coded list entries; the brand is the code."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name", "p_type")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("subject_id"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return lines.join(parts, "l_partkey").join(orders, "l_orderkey").select(
        "subject_id", F.col("l_orderkey").alias("archive_key"), line.alias("seq"),
        F.lit("urn:brand").alias("coding_system"), F.col("p_brand").alias("coding_code"),
        F.col("p_name").alias("coding_display"), F.col("l_linestatus").alias("status"),
        F.col("l_shipdate").cast("date").cast("string").alias("onset_date"),
        F.col("l_returnflag").alias("section_label"),
        F.concat_ws(" ", F.col("l_quantity").cast("int"), F.lit("mg")).alias("dose"),
        F.col("p_type").alias("route"), F.col("l_shipdate").cast("date").cast("string").alias("start_date"),
        F.lit(None).cast("string").alias("end_date"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as narratives."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the narratives; the date is derived from the id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("kind"), "source",
        F.when(F.col("doc_id") % 7 != 0, day).alias("document_date"),
        F.timestamp_seconds(F.col("doc_id")).alias("archived_at"),
    )


# Payloads: one archive blob per table row ----------------------------------


def _blobs(df: DataFrame, subject, kind: str, source: str, manifest_subject, archived_at, payload) -> DataFrame:
    return df.select(
        subject.cast("string").alias("subject_id"),
        F.sha2(payload, 256).alias("archive_key"),
        payload.cast("binary").alias("content"),
        F.lit(kind).alias("kind"), F.lit(source).alias("source"),
        manifest_subject.cast("string").alias("manifest_subject"),
        archived_at.alias("archived_at"),
        F.lit(None).cast("string").alias("original_filename"), F.lit(True).alias("has_manifest"),
    )


def heart_rate_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a day payload of two samples 30 s apart (the value as the rate)."""
    events = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    iso = lambda shift: F.date_format(at + F.make_dt_interval(secs=F.lit(shift)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    point = lambda shift, bpm: F.struct(F.struct(
        F.struct(iso(shift).alias("physicalTime")).alias("sampleTime"), bpm.alias("beatsPerMinute")).alias("heartRate"))
    bpm = F.floor("value").cast("bigint")
    payload = F.to_json(F.array(
        F.struct(F.array(point(30, bpm + 1)).alias("dataPoints")), F.struct(F.array(point(0, bpm)).alias("dataPoints"))))
    return _blobs(
        events, F.col("user_id"), "fitbit-intraday-hr-day", "fitbit", F.to_date("ts"), at, payload)


def sleep_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a sleep session; the digits of id and value become stages."""
    events = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    digits = F.concat(F.col("event_id").cast("string"), F.floor(F.col("value") * 100).cast("bigint").cast("string"))
    iso = lambda shift: F.date_format(at + F.make_dt_interval(secs=F.lit(shift)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    payload = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("id"), F.to_date("ts").cast("string").alias("day"),
        iso(0).alias("bedtime_start"), iso(28_800).alias("bedtime_end"),
        F.when(F.col("event_type") == "signup", "late_nap").otherwise("long_sleep").alias("type"),
        F.translate(digits, "0123456789", "4121314234").alias("sleep_phase_5_min"),
        F.when(F.col("event_type") != "error", F.floor(F.col("value") * 60).cast("bigint")).alias("total_sleep_duration"),
    ))
    return _blobs(events, F.col("user_id"), "oura-sleep-session", "oura", F.to_date("ts"), at, payload)


def clinical_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a clinical XML document with all four coded sections."""
    lines = table(spark, sf_dir, "lineitem")
    day = F.date_format(F.col("l_shipdate"), "yyyyMMdd")
    loinc, snomed, rxnorm = (f"2.16.840.1.113883.6.{n}" for n in (1, 96, 88))
    section = lambda code, *entries: [
        f'<component><section><code code="{code}" codeSystem="{loinc}"/>', *entries, "</section></component>"]
    observation = lambda code, *value: [
        f'<observation><code code="{code}" codeSystem="{loinc}" displayName="{code}"/><effectiveTime value="', day, '"/>',
        *value, "</observation>"]
    unknown = F.when(F.col("l_returnflag") == "R", "9.9.9").otherwise(snomed)
    parts = [
        '<?xml version="1.0"?><ClinicalDocument xmlns="urn:hl7-org:v3"'
        ' xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><templateId root="1"/><effectiveTime value="', day,
        '"/><id extension="', F.concat_ws("-", *lines.columns[:4]), '"/><component><structuredBody>',
        *section("8716-3", "<entry><organizer><component>",
                 *observation("qty", '<value xsi:type="PQ" unit="kg" value="', F.col("l_quantity").cast("string"), '"/>'),
                 "</component></organizer></entry>"),
        *section("30954-2", "<entry>",
                 *observation("disc", '<value xsi:type="IVL_PQ"><low value="', F.col("l_discount").cast("string"), '" unit="u"/></value>'),
                 "</entry>"),
        *section("11450-4", '<entry><act><entryRelationship><observation><statusCode code="', F.col("l_linestatus"),
                 '"/><effectiveTime><low value="', day, '"/></effectiveTime><value xsi:type="CD" code="',
                 F.col("l_partkey").cast("string"), '" codeSystem="', unknown, '"/></observation></entryRelationship></act></entry>'),
        *section("10160-0", '<entry><substanceAdministration><statusCode code="active"/><doseQuantity value="',
                 F.col("l_linenumber").cast("string"), '" unit="mg"/><consumable><manufacturedProduct><manufacturedMaterial>'
                 '<code code="', F.col("l_suppkey").cast("string"), f'" codeSystem="{rxnorm}"/></manufacturedMaterial>'
                 "</manufacturedProduct></consumable></substanceAdministration></entry>"),
        "</structuredBody></component></ClinicalDocument>",
    ]
    payload = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return _blobs(
        lines, F.col("l_orderkey"), "ccda", "clinic", F.lit(None).cast("string"),
        F.col("l_shipdate").cast("timestamp"), payload)


def narrative_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _blobs(
        docs, F.lit("all"), "clinical-pdf", "notes", F.lit("2024-01-01"), F.timestamp_seconds("doc_id"), F.col("text"))


def artifact_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extraction artifact per labelled document: its labels are the codings."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    coding = lambda name: F.struct(
        F.lit("urn:label").alias("system"), F.concat(F.lit(f"{name}-"), F.col(name).cast("string")).alias("code"),
        F.lit(name).alias("display"), F.lit(name).alias("quote"), F.lit("labels").alias("section_label"))
    both = docs.join(labels, "doc_id")
    payload = F.to_json(F.struct(
        F.sha2("text", 256).alias("document"), F.lit("2024-02-02").alias("document_date"),
        F.lit(None).cast("string").alias("document_date_quote"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
        F.array(coding("quality"), coding("toxic")).alias("codings"),
        F.struct(F.lit("m").alias("model"), F.lit(1).alias("prompt_version")).alias("extractor"),
        F.lit("2024-02-02T00:00:00Z").alias("extracted_at")))
    return _blobs(
        both, F.lit("all"), "narrative-extraction", "derived", F.lit(None).cast("string"), F.timestamp_seconds("doc_id"), payload)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on every document: a quote from its middle, one of them altered by a third of the ids."""
    text = F.col("text")
    middle = F.substring(text, (F.length(text) / 2).cast("int") + 1, F.lit(60))
    quote = F.when(F.col("doc_id") % 3 == 0, F.concat(middle, F.lit(" zq"))).otherwise(middle)
    code = F.when(F.col("doc_id") % 5 == 0, "Q0").otherwise(F.substring(F.trim(F.regexp_replace(middle, r"(?U)\s+", " ")), 1, 4))
    return table(spark, sf_dir, "documents").select("doc_id", code.alias("code"), quote.alias("quote"))
