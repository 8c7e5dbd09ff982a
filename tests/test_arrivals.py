"""Countdown and board paths on an invented network."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from deltaboard import schemas
from deltaboard.operators import assemble, filters
from deltaboard.plans.arrivals import filtered_arrivals, station_documents

NOW = datetime(2026, 7, 19, 12, 0, 0)
STAMP = "2026-07-19 12:00:00"


def at(minutes):
    return None if minutes is None else NOW + timedelta(minutes=minutes)


def arrivals(spark, rows):
    full = [
        (mode, 1, i, NOW, nap, name, line, line_name, platform, direction, dest, dest_name, towards, at(eta))
        for i, (nap, name, line, line_name, mode, platform, direction, dest, dest_name, towards, eta) in enumerate(rows)
    ]
    return spark.createDataFrame(full, schemas.ARRIVAL)


def boards(spark, station, line, rows, mode="elizabeth-line"):
    full = [
        (mode, 1, i, NOW, station, line, None, platform, dest, name, status, at(est), at(sched))
        for i, (platform, dest, name, status, est, sched) in enumerate(rows)
    ]
    return spark.createDataFrame(full, schemas.BOARD)


def planned(spark, station, line, mode="elizabeth-line", common="Common", line_name=None):
    return spark.createDataFrame([(mode, 1, station, common, line, line_name)], schemas.PLANNED)


def departing(spark, rows=()):
    return spark.createDataFrame(list(rows), schemas.DEPARTING)


def doc_rows(docs):
    return sorted(
        ((r.id, r.line_id, r.direction, r.pos, r.destId, r.platform, r.eta, r.displayName) for r in assemble.document_rows(docs).collect()),
        key=str,
    )


# Mill is on a tube line with two ways, Quay is the end of a rail line, Elm a bus stop.
MILL, QUAY, ELM, FOLD = "940T0MILL", "910R0QUAY", "490B0ELM", "910R0FOLD"
AMBER, COAST, BUS_7 = ("amber", "Amber"), ("coast", "Coast Line"), ("7b", "7B")


def seen(station, name, line, mode, dest, dest_name, eta, platform=None, direction=None, towards=None):
    return (station, name, *line, mode, platform, direction, dest, dest_name, towards, eta)


TUBE = [
    # The destination comes from towards where it says something; the platform turns around its parts.
    seen(MILL, "Mill Lane Underground Station", AMBER, "tube", "940T0DOCK", "Dock Underground Station", 11, "Eastbound - Platform 1", "outbound", "Dock via Hill"),
    # No direction in the feed and none in the platform.
    seen(MILL, "Mill Lane Underground Station", AMBER, "tube", "940T0PEAK", "Peak Underground Station", 7, "Westbound - Platform 2", towards="  "),
    # Gone for longer than two minutes.
    seen(MILL, "Mill Lane Underground Station", AMBER, "tube", "940T0DOCK", "Dock Underground Station", -9, "Eastbound - Platform 1", "outbound"),
    seen(MILL, "Mill Lane Underground Station", AMBER, "tube", "940T0PEAK", "Peak Underground Station", 1, "Inbound - Platform 2"),
]
RAIL = [
    # Ends here, so it turns around.
    seen(QUAY, "Quay", COAST, "elizabeth-line", QUAY, "Quay", 13, "Platform 2"),
    # Far off and without a platform.
    seen(QUAY, "Quay", COAST, "elizabeth-line", "910R0MOOR", "Moor Rail Station", 48, None, "outbound"),
]
COUNTDOWN = [*TUBE, *RAIL, seen(ELM, "Elm Road", BUS_7, "bus", "490B0PARK", "Park Bus Station", 2, towards="null")]
EXPECTED = sorted(
    [
        (ELM, "7b", "outbound", 1, "490B0PARK", "", "2026-07-19T12:02:00Z", "Park Bus"),
        (QUAY, "coast", "outbound", 1, "unknown", "Platform 2", "2026-07-19T12:13:00Z", "Check Front of Train"),
        (MILL, "amber", "inbound", 1, "940T0PEAK", "Platform 2 (Inbound)", "2026-07-19T12:01:00Z", "Peak"),
        (MILL, "amber", "outbound", 1, "940T0PEAK", "Platform 2 (Westbound)", "2026-07-19T12:07:00Z", "Peak"),
        (MILL, "amber", "outbound", 2, "940T0DOCK", "Platform 1 (Eastbound)", "2026-07-19T12:11:00Z", "Dock via Hill"),
    ],
    key=str,
)


def test_countdown(spark):
    docs = station_documents(arrivals(spark, COUNTDOWN), now=STAMP)
    assert doc_rows(docs) == EXPECTED


def test_snapshot_clock_equals_fixed_clock(spark):
    assert doc_rows(station_documents(arrivals(spark, COUNTDOWN))) == EXPECTED


def test_terminus_takes_the_way_out(spark):
    ways = departing(spark, [("coast", QUAY, "inbound"), ("amber", QUAY, "outbound")])
    rows = doc_rows(station_documents(arrivals(spark, RAIL), now=STAMP, departing=ways))
    assert [(r[0], r[2]) for r in rows] == [(QUAY, "inbound")]


def test_payload(spark):
    docs = assemble.with_payload(station_documents(arrivals(spark, RAIL), now=STAMP))
    item = {"destId": "unknown", "platform": "Platform 2", "eta": "2026-07-19T12:13:00Z", "displayName": "Check Front of Train"}
    line = {"id": "coast", "name": "Coast Line", "dirs": {"outbound": {"preds": [item]}}}
    assert json.loads(docs.head().payload) == {"id": QUAY, "name": "Quay", "lut": "2026-07-19T12:00:00", "lines": {"coast": line}}


def test_station_with_only_filtered_rows_still_publishes(spark):
    docs = assemble.with_payload(station_documents(arrivals(spark, TUBE[2:3]), now=STAMP)).collect()
    assert json.loads(docs[0].payload)["lines"] == {"amber": {"id": "amber", "name": "Amber", "dirs": {}}}


def board_docs(spark, station, rows, feed=(), line="coast", mode="elizabeth-line", ways=()):
    return station_documents(
        arrivals(spark, list(feed)),
        now=STAMP,
        boards=boards(spark, station, line, rows, mode),
        planned=planned(spark, station, line, mode),
        departing=departing(spark, ways),
    )


def call(dest, minutes, platform="2", status="OnTime", scheduled=None, name=None):
    """A board row; the id is made from the name of the place."""
    due = minutes if scheduled is None else scheduled
    return (platform, f"910R0{dest.upper()}", f"{dest.title()} Rail Station" if name is None else name, status, minutes, due)


def test_which_board_rows_are_shown(spark):
    """By status and time: what does not call is left out, a late one may be overdue, a far one needs no platform."""
    kept = {"calls": call("calls", 18), "late": call("late", -6, status="Delayed"), "far": call("far", 75, None), "edge": call("edge", -1)}
    gone = [
        call("dropped", None, status="Cancelled", scheduled=20), call("through", 22, status="NotStoppingAtStation"), call("left", -6),
        call("fold", 8, name="Fold"), call("timeless", None),
    ]
    docs = board_docs(spark, FOLD, [*gone[:3], *kept.values(), *gone[3:]])
    assert [(r[7], r[5], r[6][11:16]) for r in sorted(doc_rows(docs), key=lambda r: r[3])] == [
        ("Late Rail", "Platform 2", "11:54"), ("Edge Rail", "Platform 2", "11:59"), ("Calls Rail", "Platform 2", "12:18"),
        ("Far Rail", "Platform not assigned", "13:15"),
    ]
    assert docs.head().name == "Common" and docs.head().lines[0].line_name == "Coast"


def test_board_takes_the_place_of_its_lines_countdown_only(spark):
    """At the end of the line the board has real departures; another line there stays on countdown."""
    other = seen(QUAY, "Quay", AMBER, "elizabeth-line", "910R0HILL", "Hill", 4, "1", "inbound")
    rows = [call("moor", 17), call("quay", 17)]
    got = doc_rows(board_docs(spark, QUAY, rows, [*RAIL, other]))
    assert [(r[1], r[7]) for r in got] == [("amber", "Hill"), ("coast", "Moor Rail")]


def test_empty_board_falls_back_to_countdown(spark):
    assert doc_rows(board_docs(spark, QUAY, [], COUNTDOWN)) == EXPECTED


def test_board_only_station_without_rows_publishes_nothing(spark):
    assert board_docs(spark, FOLD, []).count() == 0


def test_equal_board_rows_are_one(spark):
    rows = [call("moor", 30), call("moor", 30), call("moor", 31), call("moor", 30, "3")]
    assert len(doc_rows(board_docs(spark, FOLD, rows))) == 3


def directed(spark, rows, feed=(), **given):
    return {r[7].removesuffix(" Rail"): r[2] for r in doc_rows(board_docs(spark, FOLD, rows, feed, **given))}


def test_directions_are_learned_and_passed_on(spark):
    """From destination, from platform, from a row at the same platform, from the line; a platform of both ways teaches nothing."""
    told = lambda dest, platform, way: seen(FOLD, "Fold", COAST, "elizabeth-line", f"910R0{dest}", dest, 5, platform, way)
    feed = [told("NORTH", "6", "outbound"), told("SOUTH", "6", "inbound"), told("WEST", "1", " Inbound")]
    mixed = [call("north", 40, "6"), call("south", 41, "6")]
    assert directed(spark, mixed, feed) == {"North": "outbound", "South": "inbound"}
    chain = [call("bay", 40, "1"), call("west", 41, "7"), call("cape", 42, "7"), call("dale", 43, "8")]
    assert directed(spark, chain, feed) == dict.fromkeys(["Bay", "West", "Cape", "Dale"], "inbound")
    assert directed(spark, [*chain, call("north", 44, "9")], feed) == {
        "Bay": "inbound", "West": "inbound", "Cape": "inbound", "Dale": "outbound", "North": "outbound",
    }
    assert directed(spark, chain[3:], line="Coast", ways=[("coast", FOLD, "inbound")]) == {"Dale": "inbound"}
    assert directed(spark, chain[3:]) == {"Dale": "outbound"}


def test_alias_comes_before_the_subscription(spark):
    """Of a station with two records the subscribed id is published with the other record's rows, in its own mode only."""
    mode, published, source, name = filters.STATION_ALIASES[0]
    feed = [
        seen(published, "One", COAST, mode, "d", "D", 3, "A", "inbound"), seen(source, "Two", COAST, mode, "d", "D", 3, "A", "outbound"),
        seen(source, "Two", AMBER, "overground", "d", "D", 3, "A", "outbound"),
    ]
    subscribed = spark.createDataFrame([(published,)], "naptan_id string")
    got = filtered_arrivals(arrivals(spark, feed), subscribed).select("naptan_id", "station_name", "direction").collect()
    assert [tuple(r) for r in got] == [(published, name, "outbound")]


def test_boards_of_the_other_record(spark):
    """The board of a twin record goes out under the station it stands for, which has the plan."""
    mode, published, source, _ = filters.STATION_ALIASES[0]
    docs = station_documents(
        arrivals(spark, []), now=STAMP, boards=boards(spark, source, "coast", [call("moor", 9)], mode),
        planned=planned(spark, published, "coast", mode),
    )
    assert [(r[0], r[7]) for r in doc_rows(docs)] == [(published, "Moor Rail")]


def test_subscription_document(spark):
    doc = spark.createDataFrame([("d", {"a": 2, "b": 0, "c": -1, "d": None}, "1")], schemas.SUBSCRIBED_DOC)
    mirror = spark.createDataFrame([("m",)], "naptan_id string")
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(filters.subscribed_ids(doc, mirror)) == ["a"]
    assert ids(filters.subscribed_ids(doc.withColumn("stationCounts", F.lit(None).cast("map<string,bigint>")), mirror)) == ["m"]
    assert ids(filters.subscribed_ids(None, mirror)) == ["m"]
    zero = doc.withColumn("stationCounts", F.create_map(F.lit("z"), F.lit(0).cast("bigint")))
    assert ids(filters.subscribed_ids(zero, mirror)) == []


def removal_loop(doc, limit):
    """Scalar model: take off the latest prediction until the text fits."""

    def size():
        return len(json.dumps(doc, separators=(",", ":"), ensure_ascii=False).encode())

    while size() > limit:
        lists = [d["preds"] for line in doc["lines"].values() for d in line["dirs"].values() if d["preds"]]
        if not lists:
            break
        max(lists, key=lambda p: p[-1]["eta"]).pop()
    return doc


def test_prune_equals_removing_one_by_one(spark):
    feed = [
        (f"S{s}", f"Halt ünïcode {s}", f"l{i % (2 + s)}", f"Line {i % (2 + s)} é", "tube", str(i % 4), ["inbound", "outbound"][i % 2],
         f"d{i}", "Ŝtation " * (1 + i % (3 + s)), None, 1 + i * 0.37)
        for s in range(5) for i in range(20 + 25 * s)
    ]
    rows = arrivals(spark, feed)
    from deltaboard.settings import Settings

    wide = station_documents(rows, now=STAMP, settings=Settings(payload_bytes=10**9))
    for limit in (4000, 1500, 150):
        cut = assemble.with_payload(station_documents(rows, now=STAMP, settings=Settings(payload_bytes=limit)))
        got = {r.id: json.loads(r.payload) for r in cut.collect()}
        for r in assemble.with_payload(wide).collect():
            assert got[r.id] == removal_loop(json.loads(r.payload), limit)


def test_hot_station_keeps_exactly_the_soonest(spark):
    """A third of all rows at one station, line and direction."""
    n = 30_000
    df = spark.range(n).select(
        F.lit("tube").alias("mode"), F.lit(1).cast("bigint").alias("cycle"), F.col("id").alias("feed_seq"),
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("S"), (F.col("id") % 500).cast("string"))).alias("naptan_id"),
        F.lit("l").alias("line_id"), F.lit("inbound").alias("direction"),
        F.timestamp_seconds(F.lit(1_800_000_000) + F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("eta"),
    )
    from deltaboard.operators.countdown import next_departures

    top = next_departures(df.repartition(8), 10)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # cut before the shuffle as well
    hot = sorted((r.eta, r.feed_seq) for r in df.where("naptan_id = 'HOT'").collect())[:10]
    assert sorted((r.eta, r.feed_seq) for r in top.where("naptan_id = 'HOT'").collect()) == hot
