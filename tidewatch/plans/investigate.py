"""Filtered event queries with an audit trail."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime
from typing import TypeVar

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewatch.operators.filters import QuerySpec, as_filters, filter_events
from tidewatch.sources.store import EventStore

R = TypeVar("R")


def event_query(
    store: EventStore, class_uid: int, filters=None, time_range: tuple[datetime, datetime] | None = None
) -> DataFrame:
    """Stored events of a class under the conditions; replayed events never take part."""
    return filter_events(store.scan(class_uid, time_range=time_range), class_uid, filters, time_range, store.registry)


def describe(class_uid: int, filters, time_range) -> str:
    parts = [f"class_uid = {class_uid}"]
    if time_range:
        parts.append(f"time BETWEEN '{time_range[0]:%Y-%m-%dT%H:%M:%S}' AND '{time_range[1]:%Y-%m-%dT%H:%M:%S}'")
    parts += [f"{f.field_path} {f.operator} {f.value!r}" for f in as_filters(filters)]
    return " AND ".join(parts)


def run_event_query(
    store: EventStore,
    action: Callable[[DataFrame], R],
    class_uid: int,
    filters=None,
    time_range: tuple[datetime, datetime] | None = None,
    session_id: str | None = None,
) -> R:
    """Run ``action`` (a write, a show, a count …) on the query and audit it.

    The row count is observed while the action runs; an action that stops early
    counts what it consumed.
    """
    if class_uid is None:
        raise TypeError("class_uid must not be None")
    session_id = session_id or str(uuid.uuid4())
    started = time.monotonic()
    seen = Observation()
    text = describe(class_uid, filters, time_range)
    try:
        rows = event_query(store, class_uid, filters, time_range)
        result = action(rows.observe(seen, F.count(F.lit(1)).alias("rows")))
    except Exception as err:
        if store.audit is not None:
            latency = (time.monotonic() - started) * 1000
            store.audit.log_query(session_id, text, class_uid, False, None, latency, str(err))
        raise
    if store.audit is not None:
        latency = (time.monotonic() - started) * 1000
        store.audit.log_query(session_id, text, class_uid, True, seen.get["rows"], latency)
    return result


def run_spec(store: EventStore, action: Callable[[DataFrame], R], spec: QuerySpec, as_of: datetime | None = None) -> R:
    """The same from a query specification, e.g. a decoded intent."""
    spec.require_valid()
    return run_event_query(store, action, spec.class_uid, list(spec.filters), spec.time_range(as_of))
