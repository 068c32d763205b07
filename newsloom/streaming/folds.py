"""Stateful folds over keys: coverage intervals, the alert ledger, the circuit breaker.

Rows of a key are folded in order of time within a micro-batch, and the state
carries on to the next; sources deliver a key's rows in order across batches.
The state of a key is one small row, whatever its history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fold(stream: DataFrame, keys: list[str], order: list[str], step: Callable, output: str, state: str) -> DataFrame:
    """``step(key, state or None, row) -> (state, rows out)`` over every key; ``order`` sorts a micro-batch's rows."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else None
        out: list[tuple] = []
        rows = pd.concat(list(frames)).sort_values(order)
        for row in rows.itertuples(index=False):
            now, made = step(key, now, row)
            out += made
        held.update(now)
        names = [c.split()[0] for c in output.split(", ")]
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy(*keys).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)


def coverage(stream: DataFrame, silence_seconds: int = 600) -> DataFrame:
    """Intervals of a source as they close; the open one is in the state. ``stream``: source_id, at, seq, state, error_class."""

    def step(key, now, row):
        if now is None:
            return (row.at, row.at, row.state, row.error_class), []
        started, ended, state, cause = now
        closed = (key[0], started, ended, state, cause)
        if (row.at - ended).total_seconds() > silence_seconds:
            return (row.at, row.at, row.state, row.error_class), [closed, (key[0], ended, row.at, "unknown", "")]
        if (state, cause) == (row.state, row.error_class):
            return (started, row.at, state, cause), []
        return (ended, row.at, row.state, row.error_class), [closed]

    kind = stream.schema["source_id"].dataType.simpleString()
    return fold(stream, ["source_id"], ["at", "seq"], step, f"source_id {kind}, started_at timestamp, ended_at timestamp, state string, error_class string", "started_at timestamp, ended_at timestamp, state string, error_class string")


def ledger(stream: DataFrame) -> DataFrame:
    """Alerts of (user, event) against what was told last. ``stream``: user_id, event_id, at, seq, tier, evidence_level, merged."""

    def step(key, now, row):
        new = (row.tier, row.evidence_level)
        if now is not None and row.merged:
            return new, []
        if now is None or row.evidence_level != now[1] or row.tier > now[0]:
            return new, [(*key, row.at, row.seq, row.tier, row.evidence_level, "new" if now is None else "update")]
        return tuple(now), []

    return fold(stream, ["user_id", "event_id"], ["at", "seq", "tier", "evidence_level", "merged"], step, "user_id long, event_id long, at timestamp, seq long, tier int, evidence_level string, kind string", "tier int, evidence_level string")


def circuit(stream: DataFrame, errors: int = 5) -> DataFrame:
    """After each outcome, the errors in a row and whether the circuit is open. ``stream``: provider, created_at, id, status."""

    def step(key, now, row):
        count, fatal = now or (0, False)
        count, fatal = (0, False) if row.status == "success" else (count + 1, fatal or row.status == "wallet")
        return (count, fatal), [(row.id, key[0], count, count >= errors or fatal)]

    return fold(stream, ["provider"], ["created_at", "id"], step, "id long, provider string, errors_in_a_row long, open boolean", "count long, fatal boolean")
