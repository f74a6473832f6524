"""Explicit schemas of every stored table and every raw payload.

Nothing in the package infers a schema: raw JSON and XML are read through the
shapes below, and the row tables are written with them.
"""

from __future__ import annotations

SOURCE_DOCUMENTS = """
    subject_id string, archive_key string, kind string, source string,
    original_filename string, archived_at timestamp, document_date date
"""

OBSERVATIONS = """
    subject_id string, archive_key string, seq bigint,
    coding_system string, coding_code string, coding_display string,
    effective_start timestamp, effective_end timestamp,
    value_quantity double, value_string string, value_unit string
"""

PROBLEMS = """
    subject_id string, archive_key string, seq bigint,
    coding_system string, coding_code string, coding_display string,
    status string, onset_date string, section_label string
"""

MEDICATIONS = """
    subject_id string, archive_key string, seq bigint,
    coding_system string, coding_code string, coding_display string,
    status string, dose string, route string, frequency string,
    start_date string, end_date string
"""

NARRATIVE_TEXTS = "subject_id string, archive_key string, title string, text string"

SOURCE_STATE = """
    subject_id string, source_name string, last_sync_at timestamp,
    last_sync_status string, last_error_message string, last_error_reason string,
    last_synced_window_end timestamp, freshness_frontier_at timestamp,
    frontier_last_advanced_at timestamp, consecutive_sync_failures bigint
"""

SOURCE_DAY_STATE = """
    subject_id string, source_name string, date date, samples_count bigint,
    samples_count_prev bigint, last_pulled_at timestamp
"""

NOTIFICATION_STATE = "subject_id string, condition_id string, last_fired_at timestamp, last_state string"

NOTIFICATION_LOG = """
    subject_id string, condition_id string, fired_at timestamp,
    severity string, title string, message string
"""

# Raw payloads -------------------------------------------------------------

ARCHIVE = """
    subject_id string, archive_key string, content binary, modified_at timestamp,
    kind string, source string, manifest_subject string, archived_at timestamp,
    original_filename string
"""

MANIFEST = """
    specversion string, id string, source string, type string,
    datacontenttype string, subject string, time string, originalfilename string
"""

HEART_RATE_PAGES = """
    array<struct<
        dataPoints: array<struct<
            heartRate: struct<
                sampleTime: struct<physicalTime: string>,
                beatsPerMinute: string>>>,
        nextPageToken: string>>
"""

SLEEP_SESSION = """
    id string, day string, bedtime_start string, bedtime_end string,
    type string, sleep_phase_5_min string, total_sleep_duration bigint,
    rem_sleep_duration bigint, deep_sleep_duration bigint, light_sleep_duration bigint
"""

EXTRACTION_ARTIFACT = """
    document string, document_date string, document_date_quote string, title string,
    codings array<struct<
        system: string, code: string, display: string, quote: string, section_label: string>>,
    extractor struct<model: string, prompt_version: int>, extracted_at string
"""


def _clinical_document() -> str:
    """Shape of the clinical XML, limited to the elements that are read.

    Every child is an array because XML lets each of them repeat; attributes
    carry a leading underscore and element text is ``txt``.
    """
    code = "array<struct<_code: string, _codeSystem: string, _displayName: string>>"
    time_bound = "array<struct<_value: string>>"
    effective_time = f"array<struct<_type: string, _value: string, low: {time_bound}, high: {time_bound}>>"
    original_text = "array<struct<txt: string>>"
    quantity = "array<struct<_value: string, _unit: string>>"
    value = (
        "array<struct<_type: string, _value: string, _unit: string, _code: string,"
        " _codeSystem: string, _displayName: string, txt: string,"
        f" translation: array<struct<_value: string, _unit: string, originalText: {original_text}>>,"
        f" originalText: {original_text}, low: {quantity}, high: {quantity}>>"
    )
    status = "array<struct<_code: string>>"
    observation = (
        f"array<struct<code: {code}, statusCode: {status},"
        f" effectiveTime: {effective_time}, value: {value}>>"
    )
    organizer = f"array<struct<component: array<struct<observation: {observation}>>>>"
    act = f"array<struct<entryRelationship: array<struct<observation: {observation}>>>>"
    drug = (
        f"array<struct<manufacturedProduct: array<struct<manufacturedMaterial:"
        f" array<struct<code: {code}>>>>>>"
    )
    administration = (
        f"array<struct<consumable: {drug}, statusCode: {status}, doseQuantity: {quantity},"
        f" routeCode: array<struct<_displayName: string>>, effectiveTime: {effective_time}>>"
    )
    entry = (
        f"array<struct<organizer: {organizer}, observation: {observation}, act: {act},"
        f" substanceAdministration: {administration}>>"
    )
    section = f"array<struct<code: {code}, entry: {entry}>>"
    body = f"array<struct<component: array<struct<section: {section}>>>>"
    # the malformed-record column has to stay last
    return (
        f"templateId array<struct<_root: string>>, effectiveTime {time_bound},"
        f" component array<struct<structuredBody: {body}>>, malformed string"
    )


CLINICAL_DOCUMENT = _clinical_document()
