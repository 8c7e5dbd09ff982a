"""From landed snapshots to changed stations."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaboard import schemas
from deltaboard.functions.text import station_of_topic
from deltaboard.functions.timing import clock, iso_local
from deltaboard.operators import assemble, board, changes, countdown, filters
from deltaboard.session import Staging
from deltaboard.settings import DEFAULTS, WIPE_PATTERNS, Settings


def filtered_arrivals(arrivals: DataFrame, subscribed: DataFrame | None) -> DataFrame:
    """Alias rewrite, then the subscription filter. The order matters."""
    return filters.subscribed_only(filters.remap_aliases(arrivals), subscribed)


def station_documents(
    arrivals: DataFrame,
    *,
    now: Column | str | None = None,
    boards: DataFrame | None = None,
    planned: DataFrame | None = None,
    departing: DataFrame | None = None,
    summary: DataFrame | None = None,
    stage: Staging | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Documents per mode, cycle and station from filtered arrivals and boards.

    With ``stage``, each feed is read once: the usable board rows, what the
    arrivals teach and the first pass of the directions are written tables.

    ``now`` is one instant, or None to use each snapshot's own fetch time. All
    rows of a mode and cycle then have to carry the same one.
    """
    row_now = F.col("fetched_at") if now is None else clock(now)
    if summary is None:
        summary = assemble.feed_summary(arrivals)
    stations = assemble.station_spine(summary, planned)
    if boards is not None and planned is not None:
        # Boards come under the record they were read from.
        boards = filters.publish_board_aliases(boards)
        asked = boards.join(planned.select(*countdown.KEYS, "line_id"), [*countdown.KEYS, "line_id"], "left_semi")
        usable = board.board_rows(asked, row_now, settings)
        if stage is not None:
            usable = stage(usable, "usable")
        at_boards = arrivals.join(planned.select(*countdown.KEYS).distinct(), countdown.KEYS, "left_semi")
        by_destination, by_platform = board.learned_directions(at_boards, stage=stage)
        directed = board.resolve_directions(usable, by_destination, by_platform, departing, stage)
        covered = usable.select(*countdown.KEYS, "line_id").distinct()
        rest = board.uncovered_arrivals(arrivals, covered)
        items = board.board_items(directed, settings).unionByName(
            countdown.countdown_items(rest, row_now, departing, settings)
        )
        uncovered = board.uncovered_arrivals(assemble.line_spine(summary), covered)
        lines = board.board_line_names(covered, at_boards, planned).unionByName(uncovered)
    else:
        items = countdown.countdown_items(arrivals, row_now, departing, settings)
        lines = assemble.line_spine(summary)
    if now is None:
        # A station that only has a board takes the time its board was fetched.
        clocks = arrivals.groupBy("mode", "cycle").agg(F.max("fetched_at").alias("_now"))
        if boards is not None:
            clocks = (
                clocks.unionByName(boards.groupBy("mode", "cycle").agg(F.max("fetched_at").alias("_now")))
                .groupBy("mode", "cycle")
                .agg(F.max("_now").alias("_now"))
            )
        stations = stations.join(clocks, ["mode", "cycle"], "left")
        doc_now = F.col("_now")
    else:
        doc_now = row_now
    docs = assemble.station_docs(items, lines, stations, doc_now)
    return assemble.with_digest(assemble.prune_to_budget(docs, settings.payload_bytes))


@dataclass
class CycleResult:
    documents: DataFrame
    emissions: DataFrame
    messages: DataFrame
    state: DataFrame
    summary: DataFrame
    late: DataFrame


def run_cycles(
    arrivals: DataFrame,
    *,
    now: Column | str | None = None,
    boards: DataFrame | None = None,
    planned: DataFrame | None = None,
    departing: DataFrame | None = None,
    subscribed: DataFrame | None = None,
    state: DataFrame | None = None,
    polled: DataFrame | None = None,
    settled: DataFrame | None = None,
    patterns: Mapping[str, str] = WIPE_PATTERNS,
    stage: Staging | None = None,
    settings: Settings = DEFAULTS,
) -> CycleResult:
    """Any number of cycles, from raw arrival rows to messages and the next state.

    Documents are built once and staged: change detection reads their digests,
    and only the emitted ones are read in full. ``polled`` (mode, cycle) names the
    polls, those without arrivals included. Stations whose state is of the same or
    a later cycle, or whose mode's ``settled`` cycle is, are late: they are listed
    in ``late`` with the reason and change nothing.
    """
    stage = stage or Staging(arrivals.sparkSession)
    kept = filtered_arrivals(arrivals, subscribed)
    if boards is not None:
        # Both paths and the names read them.
        kept = stage(kept, "arrivals")
    summary = stage(assemble.feed_summary(kept), "summary")
    polls = changes.polls_of_summary(summary, polled)
    docs = stage(
        station_documents(
            kept, now=now, boards=boards, planned=planned, departing=departing, summary=summary, stage=stage,
            settings=settings,
        ),
        "documents",
    )
    present = docs.select("mode", "station_key", "cycle", "digest")
    if state is not None or settled is not None:
        before = state if state is not None else arrivals.sparkSession.createDataFrame([], schemas.STATION_STATE)
        present, late = changes.timely(present, before, settled)
    else:
        late = present.limit(0).withColumn("reason", F.lit(None).cast("string"))
    emissions, after = changes.replay(
        present,
        polls,
        state=state,
        guard=settings.wipe_guard_arrivals,
        patterns=patterns,
        settings=settings,
    )
    emissions = stage(emissions, "emissions")
    stamps = docs.groupBy("mode", "cycle").agg(F.max("lut").alias("lut"))
    return CycleResult(
        docs,
        emissions,
        station_messages(docs, emissions, stamps),
        after,
        changes.cycle_summary(polls, docs, emissions),
        late,
    )


def station_messages(docs: DataFrame, emissions: DataFrame, stamps: DataFrame) -> DataFrame:
    """Emitted rows with topic and payload; a wipe carries an empty document."""
    shown = emissions.where(F.col("reason") != changes.WIPE).join(
        docs.drop("digest"), ["mode", "station_key", "cycle"]
    )
    no_lines = docs.schema["lines"].dataType
    wiped = (
        emissions.where(F.col("reason") == changes.WIPE)
        .join(stamps, ["mode", "cycle"], "left")
        .select(
            "mode",
            "station_key",
            "cycle",
            "reason",
            station_of_topic(F.col("station_key")).alias("id"),
            F.lit(None).cast("string").alias("name"),
            "lut",
            F.array().cast(no_lines).alias("lines"),
        )
    )
    both = assemble.with_payload(shown.select(*wiped.columns).unionByName(wiped))
    return both.select("mode", "cycle", F.col("station_key").alias("topic"), "reason", "payload")
