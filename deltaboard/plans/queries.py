"""Queries over the given tables, one or more per operator.

The tables stand in for the feeds: an event is an arrival at its user's
station, an order a line status, a line item a stop of a route, and so on.
Each query runs over whole tables and returns flat scalar columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaboard.functions import codecs, severity, text, timing
from deltaboard.functions.geo import with_geohash
from deltaboard.operators import (
    assemble,
    board,
    changes,
    countdown,
    filters,
    linestatus,
    ranking,
    replicate,
    topology,
)
from deltaboard.plans import arrivals as arrivals_plan
from deltaboard.plans import statuses as statuses_plan
from deltaboard.session import Staging
from deltaboard.settings import DEFAULTS
from deltaboard.sources import outbox

NOW = "2024-01-05 00:00:00"
CYCLE_SECONDS = 21600
MODES = ["tube", "dlr", "bus", "overground", "elizabeth-line"]
PLATFORMS = [
    None, "unknown", "Northbound - Platform 3", "Inbound - 2", "4", "plat 7", "a", "4b", "Stop fc",
    "Westbound Platform", " No Platform ", "Platform Unknown",
]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def choice(index: Column, values: list[str | None]) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index + 1).cast("int"))


def station(number: Column) -> Column:
    return F.concat(F.lit("940G"), F.lpad(number.cast("string"), 6, "0"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumns(
        {"ts": F.col("ts").cast("timestamp"), "k": F.get_json_object("props", "$.k").cast("int")}
    )


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Events as arrivals of one snapshot (cycle 0); a station belongs to one mode."""
    k = F.col("k")
    kt = k.cast("string")
    return events(spark, folder).select(
        choice(F.col("user_id") % 5, MODES).alias("mode"),
        F.lit(0).cast("bigint").alias("cycle"),
        F.col("event_id").alias("feed_seq"),
        F.lit(NOW).cast("timestamp").alias("fetched_at"),
        station(F.col("user_id")).alias("naptan_id"),
        F.concat(F.lit("Halt "), F.col("user_id").cast("string"), F.lit(" Underground Station")).alias("station_name"),
        F.when(k != 98, F.col("event_type")).alias("line_id"),
        F.when(k % 7 != 0, F.concat(F.lit("Line "), F.col("event_type"))).alias("line_name"),
        choice(k % 12, PLATFORMS).alias("platform"),
        choice(k % 4, [None, "Inbound", "outbound", " "]).alias("direction"),
        F.when(k % 13 == 0, station(F.col("user_id"))).when(k % 11 != 0, station(k)).alias("dest_id"),
        F.concat(F.lit("Place "), kt, choice(k % 3, [" Underground Station", " DLR Station", ""])).alias("dest_name"),
        F.when(k % 6 == 0, F.concat(F.lit("End "), kt, F.lit(" Station")))
        .when(k % 6 == 1, "null")
        .when(k % 6 == 2, " ")
        .when(k % 6 == 3, F.concat(F.lit(" Via "), kt, F.lit(" DLR")))
        .alias("towards"),
        F.when(k != 97, F.col("ts")).alias("eta"),
        k,
        F.col("event_type"),
    )


def departing(spark: SparkSession, folder: str) -> DataFrame:
    """Ways out learned from the directed arrivals' lines and destinations."""
    rows = arrivals(spark, folder).where(~text.is_blank(F.col("direction")) & F.col("line_id").isNotNull())
    return topology.departing_directions(
        rows.select("line_id", "direction", station(F.col("k")).alias("dest_id")), Staging(spark)
    )


def feed_half(spark: SparkSession, folder: str) -> DataFrame:
    """Arrivals of the feed that comes with boards: half of the events."""
    return arrivals(spark, folder).where(F.col("k") < 50).drop("k", "event_type")


def boards(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    """The other half as board rows, or with ``whole`` all events, timed up to ten days later than the event."""
    k = F.col("k")
    rows = arrivals(spark, folder)
    return (rows if whole else rows.where(k >= 50)).select(
        "mode", "cycle", "feed_seq", "fetched_at", "naptan_id",
        F.col("event_type").alias("line_id"),
        F.when(k % 17 == 0, F.upper("event_type")).when(k % 19 == 0, "other").alias("entry_line_id"),
        "platform", "dest_id", "dest_name",
        choice(k % 9, ["Cancelled", "NotStoppingAtStation", "Delayed", None, "OnTime", "OnTime", "OnTime", "Delayed", "OnTime"]).alias("status"),
        F.when(k % 5 != 0, F.date_trunc("hour", F.col("eta"))).alias("estimated"),
        F.when(k % 10 != 0, F.date_trunc("hour", F.col("eta"))).alias("scheduled"),
    )


def planned(spark: SparkSession, folder: str) -> DataFrame:
    """Stations with a board: three in four, all lines but one."""
    rows = events(spark, folder).where((F.col("user_id") % 4 != 0) & (F.col("event_type") != "view"))
    return (
        rows.select(
            choice(F.col("user_id") % 5, MODES).alias("mode"),
            F.lit(0).cast("bigint").alias("cycle"),
            station(F.col("user_id")).alias("naptan_id"),
            F.concat(F.lit("Common "), F.col("user_id").cast("string")).alias("common_name"),
            F.col("event_type").alias("line_id"),
            F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("Known "), F.col("event_type"))).alias("line_name"),
        )
        .distinct()
    )


# Filters, projections and top-k.


def topk_departures(spark, folder):
    rows = arrivals(spark, folder).where(F.col("line_id").isNotNull())
    live = rows.where(filters.not_long_departed(F.col("eta"), timing.clock(NOW)))
    named = live.withColumn("direction", text.direction_or_default(F.col("direction"), F.col("platform")))
    top = countdown.next_departures(named, DEFAULTS.top_k, ["naptan_id"])
    return top.select("naptan_id", "line_id", "direction", "pos", "feed_seq", timing.iso_instant(F.col("eta")).alias("eta"))


def presentable_platforms(spark, folder):
    rows = arrivals(spark, folder)
    return (
        rows.select(
            "mode",
            F.col("platform").alias("raw"),
            text.presentable_platform(F.col("mode"), F.col("platform")).alias("label"),
            text.is_unassigned_platform(F.col("platform")).cast("int").alias("unassigned"),
        )
        .groupBy("mode", "raw", "label", "unassigned")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def display_names(spark, folder):
    none = F.lit(None).cast("string")
    nations = table(spark, folder, "nation").select(
        F.lit("nation").alias("source"),
        text.display_name(F.lit("NULL"), F.concat("n_name", F.lit(" Station"))).alias("display"),
    )
    suppliers = table(spark, folder, "supplier").select(
        F.lit("supplier").alias("source"),
        text.display_name(none, F.concat(F.lit("\t"), "s_name", F.lit(" DLR Underground Station "))).alias("display"),
    )
    seen = arrivals(spark, folder).select(
        F.lit("events").alias("source"), text.display_name(F.col("towards"), F.col("dest_name")).alias("display")
    )
    return (
        nations.unionByName(suppliers)
        .unionByName(seen)
        .groupBy("source", "display")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def far_future_filter(spark, folder):
    rows, now = arrivals(spark, folder), timing.clock(NOW)
    return rows.where(
        filters.far_future_unassigned(F.col("mode"), F.col("platform"), F.col("eta"), now)
    ).select("feed_seq", "mode", timing.whole_minutes_until(F.col("eta"), now).alias("minutes"))


def subscription_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per station: -1, 0, 1, or null."""
    n = F.count(F.lit(1))
    return (
        events(spark, folder)
        .groupBy(station(F.col("user_id")).alias("naptan_id"))
        .agg(F.when(n % 7 != 0, n % 3 - 1).alias("n"))
    )


def subscribed_arrivals(spark, folder):
    active = filters.active_of_counts(subscription_counts(spark, folder))
    return filters.subscribed_only(arrivals(spark, folder), active).select("feed_seq", "naptan_id")


def nap_mode(spark, folder):
    """With an empty set nothing passes, yet every cycle is still counted."""
    rows = arrivals(spark, folder)
    nobody = filters.active_of_counts(subscription_counts(spark, folder).withColumn("n", F.lit(0)))
    passed = filters.subscribed_only(rows, nobody).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))
    return (
        rows.select("mode").distinct().join(passed, "mode", "left")
        .select("mode", F.coalesce("n", F.lit(0)).cast("bigint").alias("arrivals"))
    )


def live_or_mirror(spark, folder):
    """Stations of the live counts, or of the mirror where a mode has no counts."""
    counts = subscription_counts(spark, folder).select(
        F.lit("subscribed").alias("doc_id"), F.map_from_arrays(F.array("naptan_id"), F.array("n")).alias("stationCounts")
    )
    mirror = table(spark, folder, "customer").select(station(F.col("c_custkey")).alias("naptan_id"))
    broken = counts.select("doc_id", F.lit(None).cast("map<string,bigint>").alias("stationCounts"))
    good = filters.subscribed_ids(counts, mirror).withColumn("source", F.lit("live"))
    fallback = filters.subscribed_ids(broken, mirror).withColumn("source", F.lit("mirror"))
    return good.unionByName(fallback)


ALIASES = [
    ("dlr", "940G000001", "940G000006", "Twin One"),
    ("bus", "940G000002", "940G000012", "Twin Two"),
    ("tube", "940G000003", "940G000008", "Never"),
]


def alias_remap(spark, folder):
    return filters.remap_aliases(arrivals(spark, folder), ALIASES).select("feed_seq", "naptan_id", "station_name")


def board_aliases(spark, folder):
    rows = boards(spark, folder, whole=True)
    source = filters.board_source_station(F.col("mode"), F.col("naptan_id"), ALIASES)
    return filters.publish_board_aliases(rows.withColumn("source_id", source), ALIASES).select(
        "feed_seq", "naptan_id", "source_id"
    )


def terminus_relabel(spark, folder):
    rows = arrivals(spark, folder).where(F.col("line_id").isNotNull())
    return countdown.relabel_termini(rows, departing(spark, folder)).select(
        "feed_seq", "towards", "dest_name", "direction", "dest_id"
    )


def countdown_items(spark, folder):
    return countdown.countdown_items(
        arrivals(spark, folder), timing.clock(NOW), departing(spark, folder)
    ).drop("cycle", "eta")


def board_rows(spark, folder):
    return board.board_rows(boards(spark, folder, whole=True), timing.clock(NOW)).select(
        "naptan_id", "line_id", "feed_seq", timing.iso_instant(F.col("eta")).alias("eta"), "raw_platform", "dest_id",
        "platform", "display",
    )


def learned_directions(spark, folder):
    by_destination, by_platform = board.learned_directions(arrivals(spark, folder), stage=Staging(spark))
    return by_destination.select(
        "naptan_id", F.lit("destination").alias("kind"), F.col("dest_id").alias("value"), F.col("dest_dir").alias("direction")
    ).unionByName(
        by_platform.select(
            "naptan_id", F.lit("platform").alias("kind"), F.col("raw_platform").alias("value"),
            F.col("platform_dir").alias("direction"),
        )
    )


def _directed(spark: SparkSession, folder: str) -> DataFrame:
    stage = Staging(spark)
    by_destination, by_platform = board.learned_directions(feed_half(spark, folder), stage=stage)
    rows = board.board_rows(boards(spark, folder), timing.clock(NOW))
    return board.resolve_directions(rows, by_destination, by_platform, departing(spark, folder), stage)


def direction_resolution(spark, folder):
    return _directed(spark, folder).select("naptan_id", "line_id", "feed_seq", "direction")


def line_fallback(spark, folder):
    """Items of both paths at all stations, with the path that served the line."""
    stage = Staging(spark)
    now, feed, plan = timing.clock(NOW), stage(feed_half(spark, folder), "feed"), stage(planned(spark, folder), "planned")
    asked = boards(spark, folder).join(plan.select(*countdown.KEYS, "line_id"), [*countdown.KEYS, "line_id"], "left_semi")
    usable = stage(board.board_rows(asked, now), "usable")
    at_boards = feed.join(plan.select(*countdown.KEYS).distinct(), countdown.KEYS, "left_semi")
    by_destination, by_platform = board.learned_directions(at_boards, stage=stage)
    ways_out = departing(spark, folder)
    served = board.board_items(board.resolve_directions(usable, by_destination, by_platform, ways_out, stage))
    rest = countdown.countdown_items(board.uncovered_arrivals(feed, usable), now, ways_out)
    both = served.withColumn("path", F.lit("board")).unionByName(rest.withColumn("path", F.lit("countdown")))
    return both.select("path", "naptan_id", "line_id", "direction", "pos", "dest_id", "platform", "eta_text", "display")


def line_names(spark, folder):
    covered = board.board_rows(boards(spark, folder), timing.clock(NOW))
    return board.board_line_names(covered, feed_half(spark, folder), planned(spark, folder)).select(
        "naptan_id", "line_id", "line_name"
    )


def terminus_directions(spark, folder):
    """Nations as lines, return flags as directions, parts as destinations."""
    items = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    rows = (
        items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("line_id"), F.col("l_returnflag").alias("direction"),
            F.col("l_partkey").cast("string").alias("dest_id"),
        )
    )
    return topology.departing_directions(rows)


# Documents.


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return arrivals_plan.station_documents(
        arrivals(spark, folder).drop("k", "event_type"), now=NOW, departing=departing(spark, folder)
    )


def grouped_lines(spark, folder):
    """Stations, their lines and names, lines without a live row included."""
    summary = assemble.feed_summary(arrivals(spark, folder))
    lines = assemble.line_spine(summary)
    return (
        assemble.station_spine(summary)
        .join(lines, countdown.KEYS, "left")
        .select("mode", "naptan_id", "name", "line_id", "line_name")
    )


def pruned_payload_rows(spark, folder):
    return assemble.document_rows(_documents(spark, folder)).select(
        "mode", F.col("id").alias("naptan_id"), "line_id", "line_name", "direction", F.col("pos").cast("int").alias("pos"),
        "destId", "platform", "eta", "displayName",
    )


def station_payloads(spark, folder):
    docs = assemble.with_payload(_documents(spark, folder))
    return docs.select(
        "station_key", codecs.byte_length(F.col("payload")).alias("bytes"), F.md5("payload").alias("payload_md5")
    )


def merged_documents(spark, folder):
    """Documents out of both feeds: boards where planned, countdown elsewhere."""
    stage = Staging(spark)
    docs = arrivals_plan.station_documents(
        stage(feed_half(spark, folder), "feed"),
        now=NOW,
        boards=boards(spark, folder),
        planned=stage(planned(spark, folder), "planned"),
        departing=departing(spark, folder),
        stage=stage,
    )
    return assemble.document_rows(docs).select(
        "mode", F.col("id").alias("naptan_id"), "name", "line_id", "line_name", "direction",
        F.col("pos").cast("int").alias("pos"), "destId", "platform", "eta", "displayName",
    )


# Change detection.


def presence(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Six-hour cycles of one mode; a station's content is whether it saw an error."""
    rows = events(spark, folder).select(
        F.lit("bus").alias("mode"),
        F.concat(F.lit("Station_490"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("station_key"),
        F.floor(F.unix_seconds("ts") / CYCLE_SECONDS).cast("bigint").alias("cycle"),
        (F.col("event_type") == "error").alias("error"),
    )
    seen = rows.groupBy("mode", "station_key", "cycle").agg(F.max("error").cast("string").alias("digest"))
    return seen, changes.polls_of(rows)


def _emissions(spark: SparkSession, folder: str, guard: int | None) -> DataFrame:
    seen, polls = presence(spark, folder)
    return changes.replay(seen, polls, guard=guard)[0]


def emitted_updates(spark, folder):
    return _emissions(spark, folder, DEFAULTS.wipe_guard_arrivals).select("station_key", "cycle", "reason", "digest")


def changed_stations(spark, folder):
    rows = _emissions(spark, folder, None)
    return rows.where(F.col("reason") == changes.CHANGED).select("station_key", "cycle", "digest")


def heartbeats(spark, folder):
    rows = _emissions(spark, folder, None)
    return rows.where(F.col("reason") == changes.HEARTBEAT).select("station_key", "cycle")


def wipes(spark, folder):
    rows = _emissions(spark, folder, DEFAULTS.wipe_guard_arrivals)
    return rows.where(F.col("reason") == changes.WIPE).select(
        "station_key", "cycle", text.station_of_topic(F.col("station_key")).alias("id")
    )


def station_state(spark, folder):
    """State left after the whole history."""
    seen, polls = presence(spark, folder)
    return changes.replay(seen, polls)[1].select("station_key", "cycle", "digest", "last_emit")


def missing_stations(spark, folder):
    """Stations known before the last cycle that a healthy last poll does not list."""
    seen, polls = presence(spark, folder)
    last = polls.where(F.col("arrivals") > DEFAULTS.wipe_guard_arrivals).groupBy("mode").agg(F.max("cycle").alias("last"))
    placed = seen.join(last, "mode").where(changes.relevant(F.col("station_key"), F.col("mode")))
    now_here = placed.where(F.col("cycle") == F.col("last")).select("mode", "station_key")
    known = placed.where(F.col("cycle") < F.col("last")).select("mode", "station_key").distinct()
    return known.join(now_here, ["mode", "station_key"], "left_anti")


def cycle_summary(spark, folder):
    seen, polls = presence(spark, folder)
    return changes.cycle_summary(polls, seen, changes.replay(seen, polls)[0])


def cycle_messages(spark, folder):
    """The whole arrivals plan over six-hour cycles, from events to messages."""
    rows = arrivals(spark, folder).drop("k", "event_type").withColumns(
        {
            "mode": F.lit("tube"),
            "cycle": F.floor(F.unix_seconds("eta") / CYCLE_SECONDS).cast("bigint"),
        }
    ).where(F.col("eta").isNotNull())
    timed = rows.withColumn("fetched_at", F.timestamp_seconds(F.col("cycle") * CYCLE_SECONDS))
    result = arrivals_plan.run_cycles(timed, departing=departing(spark, folder))
    return result.messages.select("cycle", "topic", "reason", F.md5("payload").alias("payload_md5"))


# Line statuses.


def worst_status(spark, folder):
    """Line items as the status entries of their order; one code in nine is unreadable."""
    items = table(spark, folder, "lineitem")
    rows = items.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_partkey") % 9 == 0, "n/a").otherwise((F.col("l_partkey") % 22).cast("string")).alias("severity"),
        F.concat("l_returnflag", "l_linestatus").alias("description"),
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("reason "), F.col("l_suppkey").cast("string"))).alias("reason"),
    )
    return linestatus.worst_of_rows(rows, ["l_orderkey"], "l_linenumber", "severity", ["description", "reason"])


def statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as picked statuses of 60 lines, ten rows per sync."""
    orders = table(spark, folder, "orders")
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    good = ~priority.isin("1-URGENT", "2-HIGH")
    return orders.select(
        F.floor(key / 10).cast("bigint").alias("sync_id"),
        key.alias("feed_seq"),
        F.lit("tube").alias("mode"),
        F.concat(F.lit("line-"), (F.col("o_custkey") % 60).cast("string")).alias("id"),
        F.concat(F.lit("Line "), (F.col("o_custkey") % 60).cast("string")).alias("name"),
        F.when(priority == "1-URGENT", "Severe Delays")
        .when(priority == "2-HIGH", "Minor Delays")
        .when(key % 50 == 0, "GOOD SERVICE")
        .otherwise("Good Service")
        .alias("description"),
        F.when(good & (key % 9 == 0), "Extra trains")
        .when(good & (key % 9 == 1), "")
        .when(~good & (F.col("o_orderstatus") == "F"), "Signal failure")
        .when(~good & (F.col("o_orderstatus") == "P"), " ")
        .alias("reason"),
    )


def _history(spark: SparkSession, folder: str) -> DataFrame:
    return linestatus.status_history(statuses(spark, folder), index=F.col("feed_seq"))


def status_changes(spark, folder):
    return _history(spark, folder).select(
        "sync_id", "feed_seq", "id", "description", "shown_reason", F.col("changed").cast("int").alias("changed")
    )


def status_push_rows(spark, folder):
    rows = linestatus.outbox_rows(_history(spark, folder), statuses(spark, folder))
    return rows.select("channel", "topic", "sync_id", "feed_seq", "shown_reason")


def status_baseline(spark, folder):
    """State that the next sync will compare with."""
    return linestatus.state_after(_history(spark, folder)).select("id", "sync_id", "description", "reason")


def status_summary(spark, folder):
    return linestatus.changed_lines_per_mode(_history(spark, folder)).select("mode", "sync_id", "lines", "changed_lines")


def status_messages(spark, folder):
    """The whole status plan from raw entries: line items under their order's line."""
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_suppkey")
    entries = items.groupBy("l_orderkey").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_suppkey"))),
            lambda e: F.struct(
                (e["l_partkey"] % 21).cast("string").alias("statusSeverity"),
                F.concat(F.lit("Status "), e["l_returnflag"]).alias("statusSeverityDescription"),
                F.when(e["l_suppkey"] % 3 == 0, F.lit("Works")).alias("reason"),
            ),
        ).alias("lineStatuses")
    )
    lines = statuses(spark, folder).drop("description", "reason")
    raw = lines.join(entries, lines["feed_seq"] == entries["l_orderkey"], "left").drop("l_orderkey")
    result = statuses_plan.run_syncs(raw, updated_ms=F.col("feed_seq") * 1000, index=F.col("feed_seq"))
    return result.messages


def good_service_messages(spark, folder):
    rows = table(spark, folder, "orders")
    return rows.select("o_orderkey", severity.good_service_message(F.col("o_orderkey")).alias("message"))


# Stations.


def stops(spark: SparkSession, folder: str, once: bool = True) -> DataFrame:
    """Parts as stops of the lines (suppliers) that deliver them; each pair ``once``, or once per line item."""
    items = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey")
    items = items.distinct() if once else items
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size", "p_retailprice")
    none = F.lit(None).cast("string")
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        choice(F.col("l_suppkey") % 5, MODES).alias("mode"),
        F.concat(F.lit("s"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("line_id"),
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("naptan_id"),
        F.col("p_name").alias("common_name"),
        (F.col("p_retailprice") / 100).alias("lat"),
        F.col("p_size").cast("double").alias("lon"),
        choice(
            F.col("p_partkey") % 4,
            ["NaptanPublicBusCoachTram", "NaptanMetroStation", "NaptanRailStation", "NaptanFerryPort"],
        ).alias("stop_type"),
        F.col("p_brand").alias("indicator"),
        none.alias("stop_letter"),
        none.alias("ics_code"),
        none.alias("towards"),
        F.concat(F.lit("via "), F.col("l_suppkey").cast("string")).alias("compass_point"),
        none.alias("station_naptan"),
    )


def sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as routes: the parts a supplier sends in an order, by return flag."""
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag")
    direction = F.when(F.col("l_returnflag") == "A", "inbound").when(F.col("l_returnflag") == "R", "outbound").otherwise("loop")
    routes = (
        items.groupBy("l_orderkey", F.concat(F.lit("s"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("line_id"), direction.alias("direction"))
        .agg(F.collect_list("l_partkey").alias("parts"))
    )
    ids = F.transform("parts", lambda part: F.concat(F.lit("p"), part.cast("string")))
    return routes.select("line_id", "direction", F.array(F.struct(ids.alias("naptanIds"))).alias("orderedLineRoutes"))


def fitting_stops(spark: SparkSession, folder: str) -> DataFrame:
    """Stops of the fitting type. The lines are staged: once their size is known, wide stops need not be shuffled to them."""
    rows = stops(spark, folder)
    lines = Staging(spark)(stops(spark, folder, once=False).select("mode", "line_id").distinct(), "lines")
    return topology.mode_stops(lines, rows.drop("mode"))


def existing_stations(spark: SparkSession, fit: DataFrame, routes: DataFrame) -> DataFrame:
    """What an earlier sync knew: two stations in three, fewer lines, some old names."""
    known = fit.where(
        (F.substring("naptan_id", 2, 20).cast("bigint") % 3 != 0) & (F.substring("line_id", 2, 20).cast("bigint") % 7 != 0)
    )
    number = F.substring("naptan_id", 2, 20).cast("bigint")
    aged = known.withColumn("common_name", F.when(number % 5 == 0, F.lit("old name")).otherwise(F.col("common_name")))
    empty = spark.createDataFrame([], _station_schema())
    return topology.fresh_stations(aged, routes, empty, F.lit(0))


def _station_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Diff of a sync against what an earlier one left."""
    stage = Staging(spark)
    fit = stage(fitting_stops(spark, folder), "stops")
    routes = stage(topology.route_stops(sequences(spark, folder)), "routes")
    known = existing_stations(spark, fit, routes).withColumn("content_digest", topology.content_digest())
    existing = stage(known, "existing")
    return topology.changed_stations(topology.fresh_stations(fit, routes, existing, F.lit(1)), existing)


def _station_schema():
    from deltaboard import schemas

    return schemas.STATION


def route_stops(spark, folder):
    return topology.route_stops(sequences(spark, folder))


def stop_type_filter(spark, folder):
    return fitting_stops(spark, folder).select("mode", "line_id", "naptan_id", "stop_type")


def _fresh(spark: SparkSession, folder: str, existing: DataFrame) -> DataFrame:
    fit = Staging(spark)(fitting_stops(spark, folder), "stops")
    return topology.fresh_stations(fit, topology.route_stops(sequences(spark, folder)), existing, F.lit(1))


def station_fold(spark, folder):
    """Lines and directions per station after a sync into an empty table."""
    empty = spark.createDataFrame([], _station_schema())
    rows = _fresh(spark, folder, empty)
    return (
        rows.select("naptan_id", "common_name", "compass_point", F.explode("modes").alias("m"))
        .select("naptan_id", "common_name", "compass_point", F.col("m.mode").alias("mode"), F.explode("m.lines").alias("line"))
        .select(
            "naptan_id", "common_name", "compass_point", "mode", F.col("line.id").alias("line_id"),
            F.array_join("line.directions", ",").alias("directions"),
        )
    )


def search_keys(spark, folder):
    empty = spark.createDataFrame([], _station_schema())
    return _fresh(spark, folder, empty).select("naptan_id", F.explode("search_keys").alias("search_key"))


def station_diff(spark, folder):
    return _station_changes(spark, folder).select("naptan_id", "change", F.size("search_keys").alias("n_keys"))


def upsert_chunks(spark, folder):
    staged = Staging(spark)(_station_changes(spark, folder).select("naptan_id"), "changed_stations")
    return ranking.batched(staged, "naptan_id", DEFAULTS.upsert_chunk, out="chunk_no").select("naptan_id", "chunk_no")


def geohash_cells(spark, folder):
    rows = table(spark, folder, "customer").select(
        "c_custkey",
        (F.col("c_acctbal") / 120).alias("lat"),
        (F.col("c_acctbal") / 60 - F.col("c_nationkey")).alias("lon"),
    )
    return with_geohash(rows).select("c_custkey", "geo_hash")


def station_rows(spark, folder):
    """Stored rows with JSON columns, back to stations; one row in eight is broken."""
    empty = spark.createDataFrame([], _station_schema())
    stored = codecs.rows_from_stations(_fresh(spark, folder, empty))
    number = F.substring("naptan_id", 2, 20).cast("bigint")
    broken = stored.withColumn("modes_json", F.when(number % 8 == 0, "{oops").otherwise(F.col("modes_json")))
    back = codecs.stations_from_rows(broken)
    return back.select(
        "naptan_id", "last_updated", F.size("modes").alias("n_modes"), F.size("search_keys").alias("n_keys"),
        F.coalesce(F.aggregate("modes", F.lit(0), lambda n, m: n + F.size(m["lines"])), F.lit(0)).alias("n_lines"),
    )


def parts_as_stations(spark: SparkSession, folder: str) -> DataFrame:
    """Parts with a key list and a map, for the lookups."""
    return table(spark, folder, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 6 != 0, F.col("p_type")).alias("stop_type"),
        F.split("p_name", " ").alias("search_keys"),
        F.create_map("p_brand", "p_size").alias("modes"),
        F.array(F.struct(F.col("p_brand").alias("mode"), F.array().cast("array<string>").alias("lines"))).alias("groups"),
    )


def array_contains_find(spark, folder):
    return filters.where_contains(parts_as_stations(spark, folder), "search_keys", "red").select("p_partkey")


def map_key_find(spark, folder):
    rows = parts_as_stations(spark, folder)
    by_map = filters.where_map_key(rows, "modes", "Brand#2").select(F.lit("map").alias("form"), "p_partkey")
    nested = rows.select("p_partkey", F.col("groups").alias("modes"))
    by_group = filters.where_has_mode(nested, "Brand#2").select(F.lit("canonical").alias("form"), "p_partkey")
    return by_map.unionByName(by_group)


def except_find(spark, folder):
    rows = parts_as_stations(spark, folder)
    return filters.where_except(rows, "stop_type", "ECONOMY").select(F.lit("except").alias("form"), "p_partkey").unionByName(
        filters.where_not_equal(rows, "stop_type", "ECONOMY").select(F.lit("not equal").alias("form"), "p_partkey")
    )


def equality_find(spark, folder):
    return filters.where_equal(parts_as_stations(spark, folder), "stop_type", "ECONOMY").select("p_partkey")


def existing_scope(spark, folder):
    """Known stations a sync merges with, by line, bus mode and rail mode."""
    empty = spark.createDataFrame([], _station_schema())
    fresh = _fresh(spark, folder, empty).select("naptan_id", "stop_type", "search_keys")
    known = Staging(spark)(fresh, "known_stations")
    choices = {
        "line": topology.existing_in_scope(known, "tube", "s000001"),
        "bus": topology.existing_in_scope(known, "bus"),
        "rail": topology.existing_in_scope(known, "overground"),
    }
    result = None
    for name, rows in choices.items():
        part = rows.select(F.lit(name).alias("scope"), "naptan_id")
        result = part if result is None else result.unionByName(part)
    return result


# Board planning.


def board_candidates(spark, folder):
    """Parts as stations, suppliers as lines; a terminus is known on some line."""
    rows = fitting_stops(spark, folder).select("mode", "naptan_id", "line_id").distinct()
    ways_out = topology.route_stops(sequences(spark, folder)).withColumnRenamed("naptan_id", "dest_id")
    return topology.board_candidates(rows, topology.departing_directions(ways_out, Staging(spark))).select(
        "mode", "naptan_id", "cost", F.col("is_terminus").cast("int").alias("is_terminus")
    )


def rotation_ring(spark, folder):
    candidates = board_candidates(spark, folder).withColumn("is_terminus", F.col("is_terminus") == 1)
    return topology.rotated_candidates(candidates, 7).select(
        "mode", "naptan_id", F.col("is_terminus").cast("int").alias("is_terminus"), "place"
    )


def budgeted_pick(spark, folder):
    """Budgeted pick of parts per brand: termini first, then the ring from its offset."""
    parts = table(spark, folder, "part").select(
        F.col("p_brand").alias("mode"),
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("naptan_id"),
        F.col("p_size").cast("bigint").alias("cost"),
        (F.col("p_partkey") % 40 == 0).alias("is_terminus"),
    )
    return topology.planned_stations(parts, rotation=11, budget=DEFAULTS.board_budget).select(
        "mode", "naptan_id", F.col("pick_no").cast("int").alias("pick_no")
    )


# Replication.


def _stamp() -> Column:
    return F.unix_millis(F.col("o_orderdate").cast("timestamp"))


def delta_since(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    since = F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")
    return replicate.delta_since(rows, "o_orderdate", since).select("o_orderkey", "o_custkey")


def max_watermark(spark, folder):
    rows = table(spark, folder, "orders").select(_stamp().alias("stamp"))
    some = replicate.max_watermark(rows, "stamp").withColumn("source", F.lit("orders"))
    none = replicate.max_watermark(rows.where(F.col("stamp") < 0), "stamp").withColumn("source", F.lit("empty"))
    return some.unionByName(none)


STAMP_FORMS = ["ms", "padded ms", "instant", "zoneless", "minutes", "date", "word", "signed", "none"]


def stamp_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates written in the forms a watermark has come in over time."""
    at = F.col("o_orderdate").cast("timestamp")
    form = choice(F.col("o_orderkey") % 9, STAMP_FORMS)
    ms = _stamp().cast("string")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        form.alias("form"),
        F.when(form == "ms", ms)
        .when(form == "padded ms", F.concat(F.lit(" "), ms, F.lit("\t")))
        .when(form == "instant", F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250Z")))
        .when(form == "zoneless", F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".0326")))
        .when(form == "minutes", F.date_format(at, "yyyy-MM-dd'T'HH:mm"))
        .when(form == "date", F.date_format(at, "yyyy-MM"))
        .when(form == "word", F.concat(F.lit("v"), ms))
        .when(form == "signed", F.concat(F.lit("-"), ms))
        .alias("stamp"),
    )


def epoch_ms_forms(spark, folder):
    return stamp_texts(spark, folder).select(
        "o_orderkey", timing.to_epoch_ms(F.col("stamp")).alias("epoch_ms"),
        timing.numeric_prefix(F.col("stamp")).alias("prefix"),
    )


def newest_in_delta(spark, folder):
    rows = stamp_texts(spark, folder)
    ahead = replicate.newest_ms(rows, "stamp", "2000").withColumn("checkpoint", F.lit("old"))
    behind = replicate.newest_ms(rows, "stamp", "9000000000000").withColumn("checkpoint", F.lit("newer"))
    return ahead.unionByName(behind)


def checkpoint_advance(spark, folder):
    """Checkpoints per customer: an earlier value against a newer one of any form."""
    rows = stamp_texts(spark, folder).join(
        table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey"
    ).where(F.col("stamp").isNotNull()).select("o_orderkey", F.col("o_custkey").cast("string").alias("key"), F.col("stamp").alias("value"))
    current = ranking.first_k(rows, ["key"], [F.col("o_orderkey").asc()], 1).select("key", "value")
    incoming = ranking.first_k(rows, ["key"], [F.col("o_orderkey").desc()], 1).select("key", "value")
    return replicate.advance(current, incoming)


def upsert_merge(spark, folder):
    """Customers' account state after their orders are merged in, last writer wins."""
    base = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("doc"), F.lit(0).cast("bigint").alias("version")
    )
    rows = table(spark, folder, "orders").select(
        (F.col("o_custkey") + F.col("o_orderkey") % 2 * 100000).alias("key"),
        F.col("o_orderpriority").alias("doc"),
        F.col("o_orderkey").alias("version"),
    )
    return replicate.upsert(base, rows, "key", [F.col("version")])


def changefeed_apply(spark, folder):
    """The same with deletes: an order in state F removes its customer."""
    base = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("doc"))
    feed = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("key"),
        F.col("o_orderpriority").alias("doc"),
        F.when(F.col("o_orderstatus") == "F", "REMOVED").when(F.col("o_orderstatus") == "O", "ADDED").otherwise("MODIFIED").alias("op"),
        F.col("o_orderkey").alias("change_seq"),
    )
    return replicate.merge_changes(base, feed, "key", [F.col("change_seq")])


def keyed_delete(spark, folder):
    base = table(spark, folder, "customer").select("c_custkey", "c_name")
    gone = table(spark, folder, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return replicate.delete_keys(base, gone, "c_custkey")


def replace_set(spark, folder):
    ids = table(spark, folder, "orders").select(
        F.when(F.col("o_orderkey") % 10 == 0, "")
        .when(F.col("o_orderkey") % 10 != 1, F.col("o_custkey").cast("string"))
        .alias("naptan_id")
    )
    return replicate.replacement_set(ids, "naptan_id")


def row_count(spark, folder):
    return table(spark, folder, "orders").agg(F.count(F.lit(1)).alias("n"))


# Outboxes and text.


def outbox_batches(spark, folder):
    """Newest event per user and type as pending message, in capped batches."""
    rows = events(spark, folder)
    topic = F.concat(text.station_topic(station(F.col("user_id"))), F.lit("_"), F.upper("event_type"))
    both = rows.select(
        topic.alias("topic"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("payload"), "event_id",
        F.explode(F.array(F.lit(outbox.PUSH), F.lit(outbox.STREAM), F.lit(outbox.STREAM_LINES))).alias("channel"),
    )
    return outbox.pending(both, [F.col("event_id")])


def key_normalisation(spark, folder):
    names = table(spark, folder, "documents").select("doc_id", F.concat("source", F.lit(" "), "text").alias("t"))
    return names.select(
        "doc_id",
        F.md5(text.station_topic(F.col("t"))).alias("topic_md5"),
        F.length(text.normalize_key(F.col("t"))).alias("n"),
    )


def status_topics(spark, folder):
    rows = statuses(spark, folder).select("mode", "id").distinct()
    return rows.select(
        "id", text.status_topic(F.col("mode"), F.col("id")).alias("topic"), text.capitalise_first(F.col("id")).alias("capitalised")
    )


def iso_instants(spark, folder):
    rows = events(spark, folder).select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, F.date_trunc("second", F.col("ts")))
        .when(F.col("event_id") % 3 == 1, F.date_trunc("millisecond", F.col("ts")))
        .otherwise(F.col("ts"))
        .alias("ts"),
    )
    return rows.select("event_id", timing.iso_instant(F.col("ts")).alias("instant"), timing.iso_local(F.col("ts")).alias("local"))


def all_queries() -> dict[str, Query]:
    listed = [
        topk_departures, presentable_platforms, display_names, far_future_filter, subscribed_arrivals, nap_mode,
        live_or_mirror, alias_remap, board_aliases, terminus_relabel, countdown_items, board_rows, learned_directions,
        direction_resolution, line_fallback, line_names, terminus_directions, grouped_lines, pruned_payload_rows,
        station_payloads, merged_documents, emitted_updates, changed_stations, heartbeats, wipes, station_state,
        missing_stations, cycle_summary, cycle_messages, worst_status, status_changes, status_push_rows,
        status_baseline, status_summary, status_messages, good_service_messages, route_stops, stop_type_filter,
        station_fold, search_keys, station_diff, upsert_chunks, geohash_cells, station_rows, array_contains_find,
        map_key_find, except_find, equality_find, existing_scope, board_candidates, rotation_ring, budgeted_pick,
        delta_since, max_watermark, epoch_ms_forms, newest_in_delta, checkpoint_advance, upsert_merge,
        changefeed_apply, keyed_delete, replace_set, row_count, outbox_batches, key_normalisation, status_topics,
        iso_instants,
    ]
    return {query.__name__: query for query in listed}
