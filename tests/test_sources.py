"""Landed feeds, stored documents, and the plans and jobs that keep state between runs."""

import json

import pytest
from pyspark.sql import functions as F
from test_replication import land, rows_of

from deltaboard import schemas
from deltaboard.functions import codecs
from deltaboard.operators import ranking, topology
from deltaboard.plans.boards import BoardPlanner, plan_boards
from deltaboard.plans.statuses import run_syncs
from deltaboard.settings import Settings
from deltaboard.sources import feeds
from deltaboard.sources.tables import VersionedTable
from deltaboard.streaming import jobs


def landed(tmp_path, rows):
    land(str(tmp_path / "feed"), "0", rows)
    return str(tmp_path / "feed")


def test_boards_as_landed(spark, tmp_path):
    """The station and line that were asked for name the row, not those of the entry; unknown fields are no harm."""
    row = {
        "mode": "overground", "cycle": 3, "feed_seq": 1, "fetched_at": "2026-07-19T12:00:00Z", "requestedStation": "A", "requestedLine": "l",
        "naptanId": "other", "lineId": "m", "platformName": "2", "destinationName": "End", "destinationNaptanId": "E",
        "departureStatus": "OnTime", "scheduledTimeOfDeparture": "2026-07-19T12:09:00Z", "extra": {"a": 1},
    }
    df = feeds.boards(spark, landed(tmp_path, [row, {"mode": "overground"}]))
    assert df.columns == schemas.BOARD.names
    full, empty = df.orderBy(F.col("cycle").desc_nulls_last()).collect()
    assert (full.naptan_id, full.line_id, full.entry_line_id, full.platform, full.dest_id, full.status) == ("A", "l", "m", "2", "E", "OnTime")
    assert full.estimated is None and str(full.scheduled) == "2026-07-19 12:09:00"
    assert [v for v in empty if v is not None] == ["overground"]


def test_lines_stops_and_routes_as_landed(spark, tmp_path):
    assert rows_of(feeds.lines(spark, landed(tmp_path / "l", [{"mode": "tube", "id": "x", "name": "X", "created": 1}]))) == [("tube", "x", "X")]
    stop = {"line_id": "x", "naptanId": "S", "commonName": "Stop", "lat": 1.5, "stopType": "T", "stopLetter": "B", "children": []}
    got = feeds.stop_points(spark, landed(tmp_path / "s", [stop])).head()
    assert (got.line_id, got.naptan_id, got.common_name, got.lat, got.lon, got.stop_type, got.stop_letter) == ("x", "S", "Stop", 1.5, None, "T", "B")
    routes = [
        {"line_id": "x", "direction": "inbound", "orderedLineRoutes": [{"naptanIds": ["S", "T"]}, {"naptanIds": ["S"], "name": "n"}]},
        {"line_id": "x", "direction": "outbound", "orderedLineRoutes": []}, {"line_id": "y", "direction": "inbound"},
    ]
    stops = topology.route_stops(feeds.route_sequences(spark, landed(tmp_path / "r", routes)))
    assert rows_of(stops) == [("x", "inbound", "S"), ("x", "inbound", "T")]


def test_polls_of_a_feed_in_folders(spark, tmp_path):
    """Rows come back as from a flat feed, and a reader of one poll opens one poll's files."""
    path = str(tmp_path / "feed")
    rows = [(m, c, i, None, f"{m}{c}{i}") for m in ("bus", "tube", None) for c in (1, 2, 3) for i in range(2)]
    feeds.land(spark.createDataFrame(rows, "mode string, cycle bigint, feed_seq bigint, fetched_at timestamp, naptanId string"), path)
    seen = lambda df: sorted((str(r.mode), r.cycle, r.feed_seq, r.naptan_id) for r in df.collect())
    whole = feeds.arrivals(spark, path)
    assert whole.columns == schemas.ARRIVAL.names
    assert seen(whole) == sorted((str(m), c, i, n) for m, c, i, _, n in rows)
    some = feeds.arrivals(spark, path, modes=["bus", "dlr"], cycles=(2, 3))
    assert seen(some) == sorted((m, c, i, n) for m, c, i, _, n in rows if m == "bus" and c > 1)
    files = some.select(F.input_file_name().alias("f")).distinct().collect()
    assert all("mode=bus/cycle=" in r.f for r in files)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(" in plan
    stream = feeds.arrivals(spark, path, stream=True, modes=["tube"])
    assert stream.isStreaming and stream.columns == schemas.ARRIVAL.names


def test_poll_log_as_landed(spark, tmp_path):
    df = feeds.polls(spark, landed(tmp_path, [{"mode": "bus", "cycle": 1, "fetched_at": "2026-07-19T12:00:00Z", "arrivals": 7}]))
    assert df.columns == schemas.POLL.names and df.head()["arrivals"] == 7 and df.head()["boards"] is None


def test_route_documents_to_ways_out(spark):
    """The last list of a repeated name counts, an empty list serves nobody, a missing one says nothing."""
    directions = [
        {"direction": "Inbound", "destinations": [{"id": "A"}, {"id": "old"}]},
        {"direction": "outbound", "destinations": [{"id": "B"}, {"id": None}]},
        {"direction": "INBOUND", "destinations": [{"id": "A"}]},
        {"direction": "loop", "destinations": []},
        {"direction": "ghost"},
        {"destinations": [{"id": "C"}]},
    ]
    rows = [("X", json.dumps(directions), 1), ("Y", json.dumps(directions[1:3]), 1), ("Z", None, 1), ("W", "[]", 1)]
    decoded = codecs.directions_from_rows(spark.createDataFrame(rows, schemas.ROUTE_DIRECTIONS))
    assert decoded.columns == ["line_id", "last_updated", "directions"]
    flat = topology.direction_rows(decoded)
    assert {tuple(r) for r in flat.where("line_id = 'X'").collect()} == {
        ("X", "inbound", "A"), ("X", "outbound", "B"), ("X", "outbound", None), ("X", "loop", None),
    }
    # On X two directions leave each end, so neither has one way out.
    assert rows_of(topology.departing_directions(flat)) == [("y", "A", "outbound"), ("y", "B", "inbound")]


def stations(spark, rows):
    """``rows``: naptan, mode, lines."""
    made = [(nap, f"Name {nap}", [(mode, [(line, f"Line {line}", None) for line in lines])]) for nap, mode, lines in rows]
    return spark.createDataFrame(made, f"naptan_id string, common_name string, modes {schemas.MODES}")


NETWORK = [("T", "Overground", ["a", "B"]), ("P", "overground", ["a"]), ("Q", "overground", ["a"]), ("R", "overground", ["a"]), ("E", "elizabeth-line", ["e"]), ("S", "tube", ["v"]), ("N", "overground", [" "])]


def test_board_plans_rotate_under_the_budget(spark, tmp_path):
    """Two calls for the terminus, one left for the others, who take turns; a plan that is made again stays the same."""
    ways = spark.createDataFrame([("b", "T", "inbound"), ("e", "E", "inbound")], schemas.DEPARTING)
    planner = BoardPlanner(spark, str(tmp_path), Settings(board_budget=3))
    turns = []
    for cycle in [0, 1, 2, 2, 3]:
        made = planner.plan(cycle, stations(spark, NETWORK), ways, None)
        rows = {(r.mode, r.naptan_id, r.line_id) for r in planner.planned().collect()}
        assert {("overground", "T", "a"), ("overground", "T", "b"), ("elizabeth-line", "E", "e")} <= rows and len(rows) == 4
        turns.append(next(n for m, n, _ in rows if m == "overground" and n != "T"))
        summary = {r["mode"]: r for r in made.summary.collect()}["overground"]
        assert (summary["candidates"], summary["termini"], summary["stations"], summary["calls"], summary["skipped"]) == (4, 1, 2, 3, 2)
    assert turns[2] == turns[3] and set(turns[:3]) == {"P", "Q", "R"} and turns[4] == turns[0]
    # Only the mode with through stations moves the counter.
    assert planner.rotation() == 4


def test_board_plan_asks_the_other_record_and_only_for_subscribers(spark):
    aliases = [("overground", "P", "P2", "Twin")]
    ways = spark.createDataFrame([], schemas.DEPARTING)
    subscribed = spark.createDataFrame([("P",), ("S",), ("gone",)], schemas.SUBSCRIBED)
    made = plan_boards(stations(spark, NETWORK), ways, subscribed, cycle=5, aliases=aliases)
    assert rows_of(made.planned) == [("overground", 5, "P", "Name P", "a", "Line a")]
    assert rows_of(made.calls.select("naptan_id", "source_id", "line_id")) == [("P", "P2", "a")] and made.rotation == 1
    nobody = plan_boards(stations(spark, NETWORK), ways, subscribed.limit(0), cycle=5)
    assert nobody.planned.count() == nobody.calls.count() == nobody.summary.count() == 0 and nobody.rotation == 0


@pytest.mark.parametrize("cost", [0, -1, None])
def test_a_cost_below_one_fails(spark, cost):
    df = spark.createDataFrame([("m", "x", 1, 0), ("m", "y", cost, 1)], "mode string, id string, cost int, place int")
    with pytest.raises(Exception, match="a cost must be 1 or more"):
        ranking.budgeted_pick(df, ["mode"], "id", "cost", ["place"], 5).collect()


def test_subscriptions_stream(spark, tmp_path):
    """The newest document counts; one without counts leaves the set alone."""
    folder, root = str(tmp_path / "docs"), str(tmp_path / "out")
    land(folder, "0", [{"doc_id": "d", "stationCounts": {"a": 1}, "last_updated": "1"}, {"doc_id": "d", "stationCounts": {"b": 2, "c": 0}, "last_updated": "2"}])
    run = lambda: jobs.mirror_subscriptions(spark.readStream.schema(schemas.SUBSCRIBED_DOC).json(folder), root).awaitTermination()
    table = VersionedTable(spark, f"{root}/tables/subscribed", schemas.SUBSCRIBED)
    run()
    assert rows_of(table.read()) == [("b",)]
    land(folder, "1", [{"doc_id": "d", "last_updated": "3"}])
    run()
    assert rows_of(table.read()) == [("b",)]


def test_status_payloads_carry_the_fetch_time(spark):
    rows = [(1, 0, "2026-07-19 12:00:00", "tube", "v", "Victoria", [("9", "Minor Delays", "slow")])]
    raw = spark.createDataFrame(rows, schemas.RAW_LINE_STATUS.replace("fetched_at timestamp", "fetched_at string")).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    payloads = {json.loads(r.payload)["lastUpdatedTime"] for r in run_syncs(raw, primed=True).messages.collect()}
    assert payloads == {1784462400000}
