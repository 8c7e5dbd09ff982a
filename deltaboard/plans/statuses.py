"""From raw line statuses to changed-status messages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaboard.functions.codecs import encode
from deltaboard.operators import linestatus
from deltaboard.session import Staging
from deltaboard.settings import DEFAULTS, Settings
from deltaboard.sources.outbox import STREAM_LINES


@dataclass
class StatusResult:
    history: DataFrame
    messages: DataFrame
    state: DataFrame


def status_payload(updated_ms: Column) -> Column:
    return encode(
        F.struct(
            "id",
            "name",
            "mode",
            F.col("description").alias("statusSeverityDescription"),
            F.col("shown_reason").alias("reason"),
            updated_ms.cast("bigint").alias("lastUpdatedTime"),
        )
    )


def run_syncs(
    raw: DataFrame,
    *,
    updated_ms: Column | None = None,
    state: DataFrame | None = None,
    primed: bool = False,
    index: Column | None = None,
    stage: Staging | None = None,
    settings: Settings = DEFAULTS,
) -> StatusResult:
    """Any number of syncs. ``primed``: an earlier run has filled the baseline.

    Payloads carry ``updated_ms``, or without it the time their sync was fetched.

    The picked statuses and the judged history are staged: both have several
    readers, and both are far smaller than the raw feed.
    """
    stage = stage or Staging(raw.sparkSession)
    statuses = stage(linestatus.picked_statuses(raw), "statuses")
    history = stage(
        linestatus.status_history(statuses, state=state, index=index, settings=settings), "history"
    )
    rows = linestatus.outbox_rows(history, None if primed else statuses)
    if updated_ms is None:
        stamps = raw.groupBy("sync_id").agg(F.unix_millis(F.max("fetched_at")).alias("_fetched_ms"))
        rows, updated_ms = rows.join(stamps, "sync_id", "left"), F.col("_fetched_ms")
    messages = rows.select(
        F.when(F.col("channel") == "stream", STREAM_LINES).otherwise(F.col("channel")).alias("channel"),
        "sync_id",
        "feed_seq",
        "topic",
        status_payload(updated_ms).alias("payload"),
    )
    return StatusResult(history, messages, linestatus.state_after(history, state))
