"""Sleep-session payloads: epochs, nightly duration and wake after onset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.clinical import (
    LOINC, SLEEP_DURATION_CODE, STAGE_BY_EPOCH_CHAR, STAGE_CODE, WAKE_AFTER_ONSET_CODE,
    literal_lookup, stage_name,
)

# Epoch length and the session type that carries nightly summaries.
EPOCH_SECONDS = 300
NIGHT_SESSION = "long_sleep"


def parse_session(text: Column) -> Column:
    return F.from_json(text, schemas.SLEEP_SESSION)


def reject_reason(session: Column) -> Column:
    required = ("id", "day", "bedtime_start", "bedtime_end", "type", "sleep_phase_5_min")
    incomplete = session.isNull()
    for name in required:
        incomplete = incomplete | session[name].isNull()
    phases = session["sleep_phase_5_min"]
    bounds_needed = session["type"] == NIGHT_SESSION
    return (
        F.when(incomplete, "incomplete session")
        .when(phases.rlike("[^1-4]"), "unknown stage letter")
        .when(
            (bounds_needed | (F.length(phases) > 0))
            & session["bedtime_start"].try_cast("timestamp").isNull(), "invalid bedtime start")
        .when(
            bounds_needed & session["bedtime_end"].try_cast("timestamp").isNull(), "invalid bedtime end")
    )


def wake_after_onset_minutes(phases: Column) -> Column:
    """Wake minutes between the first and the last asleep epoch; null if never asleep."""
    asleep_span = F.regexp_replace(phases, "^4+|4+$", "")
    wake_epochs = F.length(asleep_span) - F.length(F.replace(asleep_span, F.lit("4"), F.lit("")))
    return F.when(F.length(asleep_span) > 0, wake_epochs * (EPOCH_SECONDS / 60.0))


def _row(seq, system, code, display, start, end, value, text, unit) -> Column:
    return F.struct(
        seq.cast("bigint").alias("seq"),
        F.lit(system).alias("coding_system"),
        F.lit(code).alias("coding_code"),
        F.lit(display).alias("coding_display"),
        start.alias("effective_start"),
        end.alias("effective_end"),
        value.cast("double").alias("value_quantity"),
        text.cast("string").alias("value_string"),
        F.lit(unit).cast("string").alias("value_unit"),
    )


def epochs(start: Column, phases: Column, stage_system: str) -> Column:
    """One interval row per stage letter of the session."""
    letters = F.filter(F.split(phases, ""), lambda c: c != "")

    def row(letter: Column, i: Column) -> Column:
        begins = F.timestamp_micros(F.unix_micros(start) + i.cast("bigint") * (EPOCH_SECONDS * 1_000_000))
        stage = literal_lookup(letter, STAGE_BY_EPOCH_CHAR)
        ends = begins + F.make_dt_interval(secs=F.lit(EPOCH_SECONDS))
        return _row(i, stage_system, STAGE_CODE, "Sleep stage", begins, ends, stage, stage_name(stage), None)

    return F.transform(letters, row)


def observations(session: Column, stage_system: str) -> Column:
    """Epoch rows, then the nightly summaries of a long session."""
    start = session["bedtime_start"].try_cast("timestamp")
    end = session["bedtime_end"].try_cast("timestamp")
    phases = session["sleep_phase_5_min"]
    night = session["type"] == NIGHT_SESSION
    none = F.lit(None)
    duration = _row(
        F.length(phases), LOINC, SLEEP_DURATION_CODE, "Sleep duration", start, end,
        session["total_sleep_duration"] / 60.0, none, "min")
    wake = _row(
        F.length(phases) + 1, LOINC, WAKE_AFTER_ONSET_CODE, "Wake after sleep onset", start, end,
        wake_after_onset_minutes(phases), none, "min")
    summaries = F.filter(
        F.array(duration, wake), lambda s: night & s["value_quantity"].isNotNull())
    return F.concat(epochs(start, phases, stage_system), summaries)
