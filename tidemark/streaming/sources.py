"""State of sources as streams: lifecycle events and token buckets, one small state a source, kept for good: sources are few."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import ACTIVE, BACKING_OFF, PAUSED, SKIP, STREAK


def next_state(state: str, event: str, again: bool) -> str:
    """The state after an event; ``again``: the parser failed the last time, too."""
    if event == "manual_skip":
        return SKIP
    if event == "manual_reactivate":
        return ACTIVE
    if state == SKIP or (state == PAUSED and event != "probe_success"):
        return state
    if event in ("success", "probe_success"):
        return ACTIVE
    if event in ("anti_bot", "unknown_failure") or (event == "parser_rot" and again):
        return PAUSED
    return BACKING_OFF if event in ("transient_failure", "parser_rot") else state


def _live(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    state, again = held.get if held.exists else (ACTIVE, False)
    rows = pd.concat(list(batches)).sort_values("n", kind="stable")  # files of a trigger come in any order
    out = []
    for event in rows["event"]:
        state = next_state(state, event, again)
        again = event == "parser_rot" if event in STREAK else again
        out.append(state)
    held.update((state, again))
    yield pd.DataFrame({"source": key[0], "n": rows["n"], "state": out})


def lifecycle_stream(events: DataFrame) -> DataFrame:
    """``events``: source string, n long (order of arrival), event. Adds the state after each.

    A source's rows of one trigger are put in the order of ``n`` first, and are in memory at once (bound them by the
    stream's files per trigger); what an earlier trigger has decided stays.
    """
    return events.select("source", "n", "event").groupBy("source").applyInPandasWithState(_live, "source string, n long, state string", "state string, again boolean", "append", GroupStateTimeout.NoTimeout)


def bucket_stream(requests: DataFrame, capacity: float, per_second: float) -> DataFrame:
    """Token buckets: ``requests`` (source string, at timestamp) with ``granted``. A bucket fills with time and a request takes one token."""

    def take(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        tokens, at = held.get if held.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        out = []
        for t in rows["at"]:
            now = t.timestamp()
            tokens = min(capacity, tokens + per_second * max(0.0, now - at)) if at is not None else tokens
            at = now if at is None else max(at, now)
            out.append(tokens >= 1)
            tokens -= out[-1]
        held.update((float(tokens), at))
        yield pd.DataFrame({"source": key[0], "at": rows["at"], "granted": out})

    return requests.select("source", "at").groupBy("source").applyInPandasWithState(take, "source string, at timestamp, granted boolean", "tokens double, at double", "append", GroupStateTimeout.NoTimeout)
