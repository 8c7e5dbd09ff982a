"""Queries of what streams and plans keep between runs: barriers, fences, queues, board plans, route documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaboard.functions import codecs, text
from deltaboard.operators import changes, queue, replicate, topology
from deltaboard.operators.ranking import latest_per_key
from deltaboard.plans.boards import plan_boards
from deltaboard.plans.queries import (
    CYCLE_SECONDS,
    MODES,
    Query,
    choice,
    events,
    fitting_stops,
    presence,
    sequences,
    station,
    table,
)
from deltaboard.session import Staging
from deltaboard.settings import DEFAULTS
from deltaboard.sources import outbox
from deltaboard.streaming.barrier import cycle_verdicts


def _cycle() -> Column:
    return F.floor(F.unix_seconds("ts") / CYCLE_SECONDS).cast("bigint")


def cycle_barrier(spark: SparkSession, folder: str) -> DataFrame:
    """Events as arrivals of polls, views as board rows; some polls logged more than came, some not at all."""
    rows = events(spark, folder).select(choice(F.col("user_id") % 5, MODES).alias("mode"), _cycle().alias("cycle"), "event_type")
    counts = rows.groupBy("mode", "cycle").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "view").alias("views")
    )
    cycle = F.col("cycle")
    log = counts.where(cycle % 11 != 3).select(
        "mode", "cycle", F.timestamp_seconds(cycle * CYCLE_SECONDS).alias("fetched_at"),
        (F.col("n") + F.when(cycle % 7 == 0, 1).otherwise(0)).alias("arrivals"),
        F.when(cycle % 5 == 0, F.col("views") + F.when(cycle % 10 == 0, 1).otherwise(0)).alias("boards"),
    )
    fence = counts.where(F.col("mode").isin("tube", "bus")).groupBy("mode").agg((F.min("cycle") + 2).alias("cycle"))
    boards = counts.select("mode", "cycle", F.col("views").alias("n"))
    return cycle_verdicts(counts.select("mode", "cycle", "n"), log, fence, DEFAULTS.cycle_patience, boards).select(
        "mode", "cycle", "seen", "expected", "verdict"
    )


def late_stations(spark: SparkSession, folder: str) -> DataFrame:
    """The whole history against a state of four cycles ago and a mode settled ten cycles ago."""
    seen, polls = presence(spark, folder)
    state = seen.groupBy("mode", "station_key").agg(
        (F.max("cycle") - 4).alias("cycle"), F.max("digest").alias("digest"), F.max("cycle").alias("last_emit")
    )
    settled = polls.groupBy("mode").agg((F.max("cycle") - 10).alias("cycle"))
    return changes.timely(seen, state, settled)[1].select("station_key", "cycle", "digest", "reason")


def pending_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Three micro-batches of messages through the queue, one tick each; ``batch`` is null for what stays."""
    topic = F.concat(text.station_topic(station(F.col("user_id"))), F.lit("_"), F.upper("event_type"))
    messages = events(spark, folder).select(
        (_cycle() % 3).alias("batch"), topic.alias("topic"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("payload"),
        "event_id", F.explode(F.array(F.lit(outbox.PUSH), F.lit(outbox.STREAM), F.lit(outbox.STREAM_LINES))).alias("channel"),
    )
    caps = {outbox.PUSH: DEFAULTS.push_batch, outbox.STREAM: DEFAULTS.station_batch, outbox.STREAM_LINES: DEFAULTS.line_batch}
    stage = Staging(spark)
    waiting = spark.createDataFrame([], "channel string, topic string, payload string, since bigint")
    sent = None
    for batch in range(3):
        newest = latest_per_key(messages.where(F.col("batch") == batch), queue.KEY, [F.col("event_id")])
        waiting = stage(queue.enqueue(waiting, newest, batch), f"queue{batch}")
        left_now, waiting = queue.drain(waiting, caps)
        rows = left_now.select(F.lit(batch).alias("batch"), "channel", "topic", "payload", "since", "batch_no")
        sent = rows if sent is None else sent.unionByName(rows)
    none = F.lit(None)
    rest = waiting.select(none.cast("int").alias("batch"), *waiting.columns, none.cast("bigint").alias("batch_no"))
    return sent.unionByName(rest)


def board_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as stations of a station dimension, the larger ones subscribed; the counter stands at 7."""
    fit = fitting_stops(spark, folder).select("mode", "naptan_id", "common_name", "line_id").distinct()
    line = F.struct(F.col("line_id").alias("id"), F.concat(F.lit("Line "), "line_id").alias("name"), F.array().cast("array<string>").alias("directions"))
    groups = fit.groupBy("naptan_id", "common_name", "mode").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    stations = groups.groupBy("naptan_id", "common_name").agg(F.array_sort(F.collect_list(F.struct("mode", "lines"))).alias("modes"))
    stage = Staging(spark)
    ways_out = topology.route_stops(sequences(spark, folder)).withColumnRenamed("naptan_id", "dest_id")
    subscribed = table(spark, folder, "part").where("p_size >= 5").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("naptan_id")
    )
    made = plan_boards(stations, topology.departing_directions(ways_out, stage), subscribed, cycle=9, rotation=7, stage=stage)
    return made.planned.join(made.calls.select("mode", "naptan_id", "line_id", "source_id"), ["mode", "naptan_id", "line_id"]).withColumn(
        "rotation_after", F.lit(made.rotation)
    )


FLAGS = ["AF", "NF", "NO", "RF"]
FLAG_DIRECTIONS = ["outbound", "Inbound", "loop", "INBOUND"]


def route_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as routes, their parts as destinations, four directions by flag of which two have one name.

    Some lists are empty and some are missing.
    """
    items = table(spark, folder, "lineitem").select(
        "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("flag"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id")
    )
    place = F.array_position(F.array(*[F.lit(f) for f in FLAGS]), F.col("flag"))
    lists = items.groupBy("l_suppkey", place.alias("place")).agg(F.collect_set(F.struct("id")).alias("destinations"))
    empty = F.array().cast("array<struct<id:string>>")
    shown = (
        F.when((F.col("place") == 3) & (F.col("l_suppkey") % 5 == 0), empty)
        .when((F.col("place") == 1) & (F.col("l_suppkey") % 7 == 0), F.lit(None))
        .otherwise(F.col("destinations"))
    )
    entry = F.struct("place", choice(F.col("place") - 1, FLAG_DIRECTIONS).alias("direction"), shown.alias("destinations"))
    docs = lists.where("place > 0").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return docs.select("l_suppkey", F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("line_id"), "e")


def _row(entries: Column) -> Column:
    return F.to_json(F.transform(entries, lambda e: F.struct(e["direction"].alias("direction"), e["destinations"].alias("destinations"))))


def route_departures(spark: SparkSession, folder: str) -> DataFrame:
    """Ways out from stored route documents, and again after a feed that changes some lines and removes others."""
    docs = Staging(spark)(route_documents(spark, folder), "routes")
    columns = ["line_id", "directions_json", "last_updated"]
    stored = docs.select("line_id", _row(F.col("e")).alias("directions_json"), F.lit(0).cast("bigint").alias("last_updated"))
    one = F.lit(1).cast("bigint")
    modified = docs.where(F.col("l_suppkey") % 3 == 0).select(
        "line_id", _row(F.filter("e", lambda e: e["place"] != 3)).alias("directions_json"), one.alias("last_updated"),
        F.lit("MODIFIED").alias("op"), one.alias("change_seq"),
    )
    removed = docs.where(F.col("l_suppkey") % 4 == 0).select(
        "line_id", F.lit(None).cast("string").alias("directions_json"), one.alias("last_updated"), F.lit("REMOVED").alias("op"),
        F.lit(2).cast("bigint").alias("change_seq"),
    )
    after = replicate.merge_changes(stored, modified.unionByName(removed), "line_id", [F.col("change_seq")])

    def ways(rows: DataFrame, source: str) -> DataFrame:
        decoded = codecs.directions_from_rows(rows.select(*columns))
        return topology.departing_directions(topology.direction_rows(decoded)).withColumn("source", F.lit(source))

    return ways(stored, "boot").unionByName(ways(after, "feed"))


def all_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (cycle_barrier, late_stations, pending_queue, board_plan, route_departures)}
