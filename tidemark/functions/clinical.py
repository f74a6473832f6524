"""Clinical codes: coding systems, sleep stages, HL7 times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Coding systems and the identifiers they have in clinical XML.
LOINC = "http://loinc.org"
RXNORM = "http://www.nlm.nih.gov/research/umls/rxnorm"
ICD10_CM = "http://hl7.org/fhir/sid/icd-10-cm"
SNOMED_CT = "http://snomed.info/sct"
LOINC_OID = "2.16.840.1.113883.6.1"
SYSTEM_BY_OID = {
    "2.16.840.1.113883.6.1": LOINC,
    "2.16.840.1.113883.6.88": RXNORM,
    "2.16.840.1.113883.6.90": ICD10_CM,
    "2.16.840.1.113883.6.96": SNOMED_CT,
}

# Codes the wearable sources write.
HEART_RATE_CODE = "8867-4"
SLEEP_DURATION_CODE = "93832-4"
WAKE_AFTER_ONSET_CODE = "103215-0"
STAGE_CODE = "aasm-sleep-stage"
#: Default system of the sleep-stage coding; every user of it takes another.
STAGE_SYSTEM = "urn:coding:aasm:sleep-stage"

# The sleep-stage vocabulary, in numeric order.
STAGES = (
    (0.0, "wake", "awake"),
    (1.0, "n1", "light sleep (N1, transition)"),
    (2.0, "n2", "light sleep (N2)"),
    (3.0, "n3", "deep / slow-wave sleep (N3)"),
    (4.0, "rem", "REM"),
)
# Stage letter of a five-minute epoch -> stage number.
STAGE_BY_EPOCH_CHAR = {"1": 3.0, "2": 2.0, "3": 4.0, "4": 0.0}


def literal_lookup(key: Column, table: dict) -> Column:
    """Value of a small fixed dictionary, null for an unknown key."""
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), key)


def system_for_oid(oid: Column) -> Column:
    return literal_lookup(oid, SYSTEM_BY_OID)


def stage_name(value: Column) -> Column:
    return literal_lookup(value, {number: name for number, name, _ in STAGES})


def coding_values(spark: SparkSession, stage_system: str | None = None) -> DataFrame:
    """Value dictionary of the codings this package mints: one row per value."""
    system = stage_system or STAGE_SYSTEM
    return spark.createDataFrame(
        [(system, STAGE_CODE, number, name, label) for number, name, label in STAGES],
        "coding_system string, coding_code string, value_quantity double, value_string string, label string",
    )


def coding_definitions(spark: SparkSession, stage_system: str | None = None) -> DataFrame:
    """One row per minted coding with its meaning, its values and usage hints."""
    about = F.struct(
        F.lit("What a sleeper did in one epoch of a night; an observation spans its epoch.").alias("description"),
        F.lit("Code of the state, ascending from wake.").alias("value_quantity_meaning"),
        F.lit("Name that goes with the code.").alias("value_string_meaning"),
        F.array(F.lit("aligned_table: duration_in_range over the sleeping codes sums a night's sleep.")).alias("hints"),
    )
    values = coding_values(spark, stage_system)
    return (
        values.groupBy("coding_system", "coding_code")
        .agg(F.sort_array(F.collect_list(F.struct("value_quantity", "value_string", "label"))).alias("values"))
        .withColumn("_about", about)
        .select("coding_system", "coding_code", "_about.*", "values")
    )


def hl7_timestamp(text: Column) -> Column:
    """Instant of an HL7 time: date, date-time (UTC) or date-time with offset; null if malformed."""
    length = F.length(text)
    day = [F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2), F.lit("-"), F.substring(text, 7, 2)]
    date_time = [
        *day, F.lit("T"), F.substring(text, 9, 2), F.lit(":"), F.substring(text, 11, 2), F.lit(":"),
        F.substring(text, 13, 2),
    ]
    offset = [F.substring(text, 15, 3), F.lit(":"), F.substring(text, 18, 2)]
    iso = (
        F.when((length == 8) & text.rlike("^[0-9]{8}$"), F.concat(*day, F.lit("T00:00:00Z")))
        .when((length == 14) & text.rlike("^[0-9]{14}$"), F.concat(*date_time, F.lit("Z")))
        .when((length == 19) & text.rlike("^[0-9]{14}[+-][0-9]{4}$"), F.concat(*date_time, *offset))
    )
    return iso.try_cast("timestamp")


def hl7_date(text: Column) -> Column:
    """``YYYY-MM-DD`` from the first eight characters; null when there are fewer."""
    return F.when(
        F.length(text) >= 8,
        F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)),
    )
