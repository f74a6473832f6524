"""Stateful notification dispatch over a stream of evaluated conditions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.plans.alerts import FIRING, REFIRE_HOURS, RESOLVED

ACTIONS = """
    subject_id string, condition_id string, evaluated_at timestamp, action string,
    severity string, title string, message string
"""
_STATE = "last_fired_at timestamp, last_state string"


def dispatch_stream(evaluated: DataFrame) -> DataFrame:
    """Fire, suppress or resolve each evaluation, in time order per condition.

    ``evaluated`` is a stream of ``subject_id, condition_id, evaluated_at,
    is_firing, severity, title, message``. The state of a condition is one
    small row; evaluations that change nothing are not emitted.
    """
    return evaluated.groupBy("subject_id", "condition_id").applyInPandasWithState(
        _decide, ACTIONS, _STATE, "append", GroupStateTimeout.NoTimeout)


def _decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    fired_at, last = state.get if state.exists else (None, None)
    rows = pd.concat(batches).sort_values("evaluated_at", kind="stable")
    actions = []
    for at, firing in zip(rows["evaluated_at"], rows["is_firing"]):
        if firing:
            recent = fired_at is not None and not pd.isna(fired_at) and (
                at - pd.Timestamp(fired_at) < pd.Timedelta(hours=REFIRE_HOURS))
            if last == FIRING and recent:
                actions.append("suppress")
                continue
            actions.append("fire")
            fired_at, last = at, FIRING
        elif last == FIRING:
            actions.append("resolve")
            fired_at, last = None, RESOLVED
        else:
            actions.append(None)
    if last is not None:
        state.update((None if fired_at is None else pd.Timestamp(fired_at).to_pydatetime(), last))
    out = rows.assign(action=actions).dropna(subset=["action"])
    columns = ["subject_id", "condition_id", "evaluated_at", "action", "severity", "title", "message"]
    yield out.assign(subject_id=key[0], condition_id=key[1])[columns]
