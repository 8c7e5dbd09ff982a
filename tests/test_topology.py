"""Topology, board planning, rankings and the station sync."""

import random

import pytest
from pyspark.sql import functions as F

from deltaboard import schemas
from deltaboard.operators import ranking, topology
from deltaboard.plans import queries
from deltaboard.plans.stations import sync_stations


def test_way_out_of_termini(spark):
    docs = spark.createDataFrame(
        [
            ("L1", [("inbound", [("A",), ("X",)]), ("Outbound", [("B",), ("X",), (None,)])]),
            ("loop", [("inbound", [("A",)]), ("outbound", [("A",)])]),
            ("one", [("inbound", [("A",)])]),
            ("three", [("a", [("T",)]), ("b", [("T",)]), ("c", [])]),
            ("again", [("inbound", [("Q",)]), ("INBOUND", [("R",)]), ("outbound", [("S",)])]),
            ("odd", [(None, [("A",)]), ("x", None)]),
        ],
        f"line_id string, directions {schemas.DIRECTIONS_JSON}",
    )
    got = {tuple(r) for r in topology.departing_directions(topology.direction_rows(docs)).collect()}
    assert got == {
        ("l1", "A", "outbound"), ("l1", "B", "inbound"), ("three", "T", "c"),
        ("again", "R", "outbound"), ("again", "S", "inbound"),
    }


def greedy(rows, budget):
    left, taken = budget, []
    for _, key, cost in sorted(rows):
        if cost <= left:
            taken.append(key)
            left -= cost
    return taken


@pytest.mark.parametrize("seed", range(4))
def test_budgeted_pick_is_the_greedy_walk(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice("ab"), rnd.randrange(200), f"s{i}", rnd.choice([1, 1, 2, 3, 7, 30, 61])) for i in range(400)]
    df = spark.createDataFrame(rows, "mode string, place int, naptan_id string, cost int")
    got = ranking.budgeted_pick(df, ["mode"], "naptan_id", "cost", ["place"], 60)
    for mode in "ab":
        expected = greedy([(p, k, c) for m, p, k, c in rows if m == mode], 60)
        assert [r.naptan_id for r in got.where(F.col("mode") == mode).orderBy("pick_no").collect()] == expected


def test_skipped_station_followed_by_a_cheaper_one(spark):
    rows = [("m", 1, "a", 40), ("m", 2, "b", 30), ("m", 3, "c", 20)]
    df = spark.createDataFrame(rows, "mode string, place int, naptan_id string, cost int")
    got = ranking.budgeted_pick(df, ["mode"], "naptan_id", "cost", ["place"], 60).orderBy("pick_no").collect()
    assert [r.naptan_id for r in got] == ["a", "c"]


def test_numbers_are_dense_and_rotation_wraps(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("g"))
    for g, n in (("x", 1667), ("y", 3333)):
        got = sorted(r.seq for r in ranking.numbered(df, "k", ["g"]).where(F.col("g") == g).collect())
        assert got == list(range(n))
    ring = {r.k: r.place for r in ranking.rotated(df, "k", ["g"], 5).where("g = 'x'").collect()}
    base = {r.k: r.place for r in ranking.rotated(df, "k", ["g"], 0).where("g = 'x'").collect()}
    assert all(ring[k] == (base[k] - 5) % 1667 for k in base)
    sizes = [r["count"] for r in ranking.batched(df, "k", 1000).groupBy("batch_no").count().orderBy("batch_no").collect()]
    assert sizes == [1000] * 5


def test_planning_puts_termini_first(spark):
    stations = spark.createDataFrame(
        [
            (s, f"Name {s}", [(mode, [(line, None, []) for line in lines])])
            for s, mode, lines in [("A", "overground", ["L1", " "]), ("B", "Overground", ["l1", "L2"]), ("C", "tube", ["v"]), ("D", "overground", [])]
        ],
        f"naptan_id string, common_name string, modes {schemas.MODES}",
    )
    ways = spark.createDataFrame([("l2", "B", "inbound")], schemas.DEPARTING)
    lines = topology.station_lines(stations)
    candidates = topology.board_candidates(lines, ways)
    assert {tuple(r) for r in candidates.collect()} == {("overground", "A", 1, False), ("overground", "B", 2, True)}
    plan = topology.planned_stations(candidates, rotation=3, budget=2).collect()
    assert [(r.naptan_id, r.pick_no) for r in plan] == [("B", 0)]


BUS = "NaptanPublicBusCoachTram"
STOP = "line_id string, naptan_id string, common_name string, lat double, lon double, stop_type string, indicator string, stop_letter string, ics_code string, towards string, compass_point string, station_naptan string"
PUTNEY = ("39", "490000184Z", "Putney Bridge Station", 51.46792, -0.20931, BUS, "Stop FC", "FC", None, None, None, None)


def sync(spark, stops, stations=(), routes=(), mode="bus", lines=("39",), **kw):
    return sync_stations(
        spark.createDataFrame([(mode, line, line) for line in lines], "mode string, line_id string, name string"),
        spark.createDataFrame(list(stops), STOP),
        spark.createDataFrame(list(routes), schemas.RAW_ROUTE_SEQUENCE),
        spark.createDataFrame(list(stations), schemas.STATION),
        mode=mode, now_ms=F.lit(5), **kw,
    )


def test_new_bus_stop_is_one_upsert(spark):
    got = sync(spark, [PUTNEY, ("39", "x", "Rail", 1.0, 1.0, "NaptanRailStation", *[None] * 6)]).collect()
    assert len(got) == 1
    row = got[0]
    assert (row.naptan_id, row.change, row.chunk_no, row.geo_hash) == ("490000184Z", "new", 0, "gcpug1rw6")
    assert [m.mode for m in row.modes] == ["bus"] and row.modes[0].lines[0].asDict() == {"id": "39", "name": "39", "directions": []}
    assert row.search_keys == ["39", "bus", "bus_39"]


def test_second_sync_of_the_same_feed_changes_nothing(spark):
    routes = [("39", "inbound", [(["490000184Z", "y"],), (None,)])]
    first = sync(spark, [PUTNEY], routes=routes).drop("change", "chunk_no").collect()
    assert first[0].search_keys == ["39", "39_inbound", "bus", "bus_39", "bus_39_inbound"]
    assert sync(spark, [PUTNEY], first, routes).count() == 0
    # A route that goes away takes nothing back, unless the table is rebuilt.
    assert sync(spark, [PUTNEY], first).count() == 0
    assert sync(spark, [PUTNEY], first, rebuild=True).collect()[0].search_keys == ["39", "bus", "bus_39"]
    renamed = (*PUTNEY[:2], "Putney", *PUTNEY[3:])
    assert [r.change for r in sync(spark, [renamed], first, routes).collect()] == ["changed"]


def test_other_modes_stay(spark):
    first = sync(spark, [PUTNEY]).drop("change", "chunk_no").collect()
    got = sync(spark, [("t1", *PUTNEY[1:])], first, mode="tram", lines=["t1"]).collect()
    assert got[0].search_keys == ["t1", "tram", "tram_t1"]  # not in the tram scope, so not known
    more = sync(spark, [PUTNEY, ("7", *PUTNEY[1:])], first, lines=["39", "7"]).collect()[0]
    assert [line.id for line in more.modes[0].lines] == ["39", "7"] and more.change == "changed"
    assert sync(spark, [("7", *PUTNEY[1:])], first, lines=["39", "7"], line_id="39").count() == 0


def test_keys_are_in_order_with_nulls_last(spark):
    rows = spark.createDataFrame([(["b", None, "a", None, "B"],), ([],), (None,)], "keys array<string>")
    got = [r[0] for r in rows.select(topology.in_order(F.col("keys"))).collect()]
    assert got == [["B", "a", "b", None, None], [], None]
    lines = spark.createDataFrame([([(None, [("7", "7", ["out", "in"])])],)], f"modes {schemas.MODES}")
    assert lines.select(topology.search_keys(F.col("modes"))).collect()[0][0] == ["7", "7_in", "7_out", None]


def test_stations_meet_their_lines_in_one_exchange(spark, capsys):
    columns = ["mode", "line_id", "naptan_id", *topology.SCALARS]
    stops = spark.range(9).select(*[F.col("id").cast("double" if c in ("lat", "lon") else "string").alias(c) for c in columns])
    routes = spark.range(9).select(*[F.col("id").cast("string").alias(c) for c in ("line_id", "naptan_id", "direction")])
    topology.fresh_stations(stops, routes, spark.createDataFrame([], schemas.STATION), F.lit(1)).explain()
    exchanges = [line for line in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning(naptan_id" in line]
    assert exchanges and not any(", mode#" in line for line in exchanges)


def test_scope_reads_stations_made_once(spark, tmp_path):
    items = [(o, p, s, flag) for o, (p, s, flag) in enumerate([(4, 2, "A"), (5, 1, "R"), (6, 3, "N"), (6, 3, "A"), (None, 1, "A"), (5, None, "R")])]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(p, f"part {p}", "STEEL", "Brand#11", p, 900.0) for p in (4, 5, 6)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = queries.existing_scope(spark, str(tmp_path))
    assert not [f for f in got.inputFiles() if "lineitem.parquet" in f or "part.parquet" in f]
    assert sorted(map(tuple, got.collect())) == [("bus", "p4"), ("line", "p5"), ("rail", "p5"), ("rail", "p6")]
