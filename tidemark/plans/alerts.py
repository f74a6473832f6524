"""Source conditions and the notifications they raise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import best_of
from tidemark.specs import SUBJECT, instant

# Thresholds, cadence, severities and the state words.
FAILURES_THRESHOLD = 3
STUCK_HOURS = 48
REFIRE_HOURS = 24
AUTH_REASON = "reauth_required"
FIRING, RESOLVED = "firing", "resolved"
HOUR_MICROS = 3_600_000_000


def conditions(source_state: DataFrame, now, keys: Sequence[str] = SUBJECT) -> DataFrame:
    """Three evaluated conditions per source: authorization, failures, stuck data.

    Data counts as stuck only for a source that is otherwise healthy. A quiet
    condition has no severity, title or message.
    """
    name = F.initcap("source_name")
    failures = F.coalesce("consecutive_sync_failures", F.lit(0))
    no_auth = F.coalesce(F.col("last_error_reason") == AUTH_REASON, F.lit(False))
    idle = F.unix_micros(instant(now)) - F.unix_micros("frontier_last_advanced_at")
    stuck = ~no_auth & (failures == 0) & F.coalesce(idle >= STUCK_HOURS * HOUR_MICROS, F.lit(False))

    def condition(kind: str, firing: Column, severity: str, title: Column, message: Column) -> Column:
        return F.struct(
            F.concat(F.lit(f"{kind}:"), F.col("source_name")).alias("condition_id"),
            firing.alias("is_firing"),
            F.when(firing, severity).alias("severity"),
            F.when(firing, title).alias("title"),
            F.when(firing, message).alias("message"),
        )

    checks = F.array(
        condition(
            "auth_expired", no_auth, "critical",
            F.concat(name, F.lit(" needs to be authorized again")),
            F.concat(F.lit("The last sync of "), name, F.lit(" was refused. Authorize the source again.")),
        ),
        condition(
            "sync_failures", failures >= FAILURES_THRESHOLD, "warning",
            F.concat(name, F.lit(" sync is failing")),
            F.concat(name, F.lit(" has failed "), failures.cast("string"), F.lit(" times in a row.")),
        ),
        condition(
            "frontier_stuck", stuck, "warning",
            F.concat(name, F.lit(" has stopped sending data")),
            F.concat(name, F.lit(f" syncs without errors but sent nothing new for over {STUCK_HOURS} hours.")),
        ),
    )
    return source_state.select(*keys, "source_name", F.inline(checks))


def dispatch(
    evaluated: DataFrame, notification_state: DataFrame, now, keys: Sequence[str] = SUBJECT
) -> DataFrame:
    """Decide per condition: ``fire``, ``suppress``, ``resolve`` or ``none``.

    A firing condition fires when it was not firing before, or when a whole
    number of at least 24 hours has passed since it last did; a firing state
    whose condition went quiet resolves. Adds the state to store.
    """
    on = [*keys, "condition_id"]
    prior = notification_state.select(*on, F.col("last_fired_at").alias("_fired"), F.col("last_state").alias("_state"))
    joined = evaluated.join(prior, on, "left")
    was_firing = F.coalesce(F.col("_state") == FIRING, F.lit(False))
    recent = F.coalesce(
        F.unix_micros(instant(now)) - F.unix_micros("_fired") < REFIRE_HOURS * HOUR_MICROS, F.lit(False))
    action = (
        F.when(F.col("is_firing"), F.when(was_firing & recent, "suppress").otherwise("fire"))
        .when(was_firing, "resolve").otherwise("none")
    )
    acted = F.col("action")
    return (
        joined.withColumn("action", action)
        .withColumn(
            "last_fired_at",
            F.when(acted == "fire", instant(now)).when(acted != "resolve", F.col("_fired")))
        .withColumn("last_state", F.when(acted == "fire", FIRING).when(acted == "resolve", RESOLVED).otherwise(F.col("_state")))
        .drop("_fired", "_state")
    )


def log_entries(dispatched: DataFrame, keys: Sequence[str] = SUBJECT) -> DataFrame:
    """Rows to append to the notification log."""
    return dispatched.where("action = 'fire'").select(
        *keys, "condition_id", F.col("last_fired_at").alias("fired_at"), "severity", "title", "message")


def state_changes(dispatched: DataFrame, keys: Sequence[str] = SUBJECT) -> DataFrame:
    """Rows to upsert into the notification state."""
    return dispatched.where(F.col("action").isin("fire", "resolve")).select(
        *keys, "condition_id", "last_fired_at", "last_state")


def notifications(log: DataFrame, limit: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """The newest notifications first; with ``keys`` the newest ``limit`` of each."""
    order = [F.col("fired_at").desc(), F.col("condition_id").desc()]
    return best_of(log, keys, order, limit).orderBy(*keys, *order)
