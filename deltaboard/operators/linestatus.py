"""Line statuses: worst status per line, change detection, push suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaboard.functions.severity import (
    good_service_message,
    has_text,
    is_good_service,
    message_index,
    parse_severity,
    severity_priority,
    worst_status,
)
from deltaboard.functions.text import status_topic
from deltaboard.operators.history import laid_out, nearest
from deltaboard.operators.ranking import first_k
from deltaboard.settings import DEFAULTS, Settings

STATUS_COLUMNS = ["sync_id", "feed_seq", "mode", "id", "name", "description", "reason"]


def picked_statuses(raw: DataFrame) -> DataFrame:
    """One row per line and sync with the status to show."""
    chosen = raw.withColumn("_worst", worst_status(F.col("lineStatuses")))
    return chosen.select(
        "sync_id", "feed_seq", "mode", "id", "name", "_worst.description", "_worst.reason"
    )


def worst_of_rows(
    rows: DataFrame, keys: Sequence[str], pos: str, severity: str, carried: Sequence[str]
) -> DataFrame:
    """The same pick over flat rows, one per status entry, in one aggregate."""
    code = parse_severity(F.col(severity))
    # Entries with unreadable codes rank below all others, in feed order.
    entry = F.struct(
        F.when(code.isNotNull(), severity_priority(code)).otherwise(-1).alias("priority"),
        (-F.col(pos)).alias("nearness"),
        *[F.col(c) for c in carried],
    )
    best = rows.groupBy(*keys).agg(F.max(entry).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in carried])


def status_history(
    statuses: DataFrame,
    *,
    state: DataFrame | None = None,
    index: Column | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Add ``shown_reason`` and ``changed`` to statuses, one per line and sync.

    A line counts as changed when its description differs from the last one, or
    its reason says something new. A good service without a reason keeps the
    reason shown so far while it lasts, and gets a message when it begins.
    A line listed twice in a sync is compared with the sync before both times;
    the last entry counts for the next sync.
    """
    message = good_service_message(index if index is not None else message_index(F.col("id"), F.col("sync_id")))
    rows = statuses.select(*STATUS_COLUMNS, message.alias("_message"), F.lit(False).alias("_old"))
    if state is not None:
        none = F.lit(None)
        rows = rows.unionByName(
            state.select(
                "sync_id", none.cast("bigint").alias("feed_seq"), none.cast("string").alias("mode"), "id",
                none.cast("string").alias("name"), "description", "reason",
                none.cast("string").alias("_message"), F.lit(True).alias("_old"),
            )
        )
    base = first_k(rows, ["id", "sync_id"], [F.col("feed_seq").desc_nulls_last()], 1)
    said, good = has_text(F.col("reason")), is_good_service(F.col("description"))
    laid = laid_out(base, ["id"], "sync_id", settings.block_cycles)
    first = nearest(laid, ["id"], "sync_id", before={"_prev": F.struct("description", "reason")})
    prev_good = is_good_service(F.col("_prev.description"))
    # Rows whose reason a following quiet good service goes on showing.
    anchored = first.withColumn(
        "_anchor",
        F.when(said, F.col("reason")).when(good & ~prev_good & ~F.col("_old"), F.col("_message")),
    )
    second = nearest(anchored, ["id"], "sync_id", before={"_kept": F.col("_anchor")})
    prev_shown = F.when(has_text(F.col("_prev.reason")), F.col("_prev.reason")).when(prev_good, F.col("_kept")).otherwise(
        F.col("_prev.reason")
    )
    before = second.select("id", "sync_id", F.col("_prev").isNotNull().alias("_known"), F.col("_prev.description").alias("_prev_desc"), prev_shown.alias("_prev_shown"), "_kept")

    judged = rows.where(~F.col("_old")).join(before, ["id", "sync_id"])
    was_good = is_good_service(F.col("_prev_desc"))
    shown = (
        F.when(said, F.col("reason"))
        .when(good & F.col("_known") & was_good, F.col("_kept"))
        .when(good, F.col("_message"))
        .otherwise(F.col("reason"))
    )
    new_reason = (
        F.when(said, ~F.col("_prev_shown").eqNullSafe(F.col("reason")))
        .when(good, ~was_good)
        .otherwise(has_text(F.col("_prev_shown")))
    )
    changed = ~F.col("_known") | ~F.col("_prev_desc").eqNullSafe(F.col("description")) | new_reason
    return judged.select(*STATUS_COLUMNS, shown.alias("shown_reason"), changed.alias("changed"))


def state_after(history: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Baseline per line for the next sync."""
    rows = history.select("id", "sync_id", "feed_seq", "description", F.col("shown_reason").alias("reason"))
    if state is not None:
        rows = rows.unionByName(state.withColumn("feed_seq", F.lit(None).cast("bigint")).select(*rows.columns))
    return first_k(rows, ["id"], [F.col("sync_id").desc(), F.col("feed_seq").desc_nulls_last()], 1).drop("feed_seq")


def outbox_rows(history: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """Changed statuses for both channels.

    The stream channel is keyed by the bare line id and gets everything. The push
    channel is keyed by topic. If ``statuses`` is given, this is the first run,
    and push leaves out its first sync, which only fills the baseline. A sync
    that returned no line has no rows and so does not count as the first.
    """
    targets = F.array(
        F.struct(F.lit("stream").alias("channel"), F.col("id").alias("topic")),
        F.struct(F.lit("push").alias("channel"), status_topic(F.col("mode"), F.col("id")).alias("topic")),
    )
    both = history.where("changed").withColumn("_to", F.explode(targets))
    rows = both.select(*history.columns, "_to.channel", "_to.topic")
    if statuses is None:
        return rows
    first = statuses.agg(F.min("sync_id")).scalar()
    return rows.where((F.col("channel") == "stream") | (F.col("sync_id") > first))


def changed_lines_per_mode(history: DataFrame) -> DataFrame:
    return history.groupBy("mode", "sync_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("changed").alias("changed_lines")
    )
