"""Cycles in parts, board-only cycles, late cycles: the barrier, the fence and the stream against batch replays."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_replication import START, land, rows_of, snapshot

from deltaboard import schemas
from deltaboard.operators import changes
from deltaboard.plans.arrivals import run_cycles
from deltaboard.session import Staging
from deltaboard.settings import Settings
from deltaboard.sources import feeds, outbox
from deltaboard.sources.tables import VersionedTable
from deltaboard.streaming import barrier, jobs

CYCLES = 7
COUNTS = "mode string, cycle bigint, n bigint"
SMALL = Settings(wipe_guard_arrivals=10, block_cycles=4)


def scalar_verdicts(seen, log, boards, fence, patience):
    """One cycle after the other, by the rules as they are written down."""
    out = {}
    for mode in {m for m, _ in [*seen, *log]}:
        cycles = sorted({c for m, c in [*seen, *log] if m == mode})
        whole = {}
        for c in cycles:
            told = log.get((mode, c))
            whole[c] = told is not None and seen.get((mode, c), 0) >= told[0] and boards.get((mode, c), 0) >= (told[1] or 0)
        late = {c for c in cycles if mode in fence and c <= fence[mode]}
        newest = max((c for c in cycles if whole[c] and c not in late), default=None)
        blocked = False
        for c in cycles:
            if c in late:
                out[mode, c] = barrier.LATE
            elif not whole[c] and newest is not None and c <= newest - patience:
                out[mode, c] = barrier.INCOMPLETE
            elif whole[c] and not blocked:
                out[mode, c] = barrier.RELEASED
            else:
                blocked = blocked or not whole[c]
                out[mode, c] = barrier.WAITING
    return out


def test_verdicts_against_a_scalar_model(spark):
    draw = random.Random(5)
    modes = ["bus", "tube", None] + [f"m{i}" for i in range(60)]
    seen, log, boards, fence = {}, {}, {}, {}
    for mode, cycle in itertools.product(modes, range(8)):
        if draw.random() < 0.8:
            seen[mode, cycle] = draw.randint(1, 3)
        if draw.random() < 0.8:
            log[mode, cycle] = (draw.randint(0, 3), draw.choice([None, 0, 2]))
        if draw.random() < 0.7:
            boards[mode, cycle] = draw.randint(1, 3)
    for mode in modes:
        if draw.random() < 0.5:
            fence[mode] = draw.randint(-1, 4)
    stamp = datetime(2026, 1, 1)
    got = barrier.cycle_verdicts(
        spark.createDataFrame([(*k, n) for k, n in seen.items()], COUNTS),
        spark.createDataFrame([(*k, stamp, *v) for k, v in log.items()], schemas.POLL),
        spark.createDataFrame(list(fence.items()), schemas.FENCE),
        2,
        spark.createDataFrame([(*k, n) for k, n in boards.items()], COUNTS),
    )
    assert {(r.mode, r.cycle): r.verdict for r in got.collect()} == scalar_verdicts(seen, log, boards, fence, 2)


def test_release_sorts_rows_and_moves_the_fence(spark, tmp_path):
    rows = [("bus", 1, "a"), ("bus", 2, "b"), ("bus", 3, "c"), (None, 1, "d"), ("bus", None, "e"), ("tube", 0, "f"), ("tube", 9, "g")]
    log = [("bus", 1, None, 1, None), ("bus", 2, None, 2, None), ("bus", 3, None, 1, None), (None, 1, None, 1, None), ("tube", 0, None, 1, None), ("tube", 9, None, 1, None), ("tube", 4, None, 7, None)]
    with Staging(spark, str(tmp_path)) as stage:
        got = barrier.release(
            spark.createDataFrame(rows, "mode string, cycle bigint, id string"), spark.createDataFrame(log, schemas.POLL),
            spark.createDataFrame([("tube", 2)], schemas.FENCE), stage, patience=3,
        )
        assert {r.id for r in got.rows.collect()} == {"a", "d", "g"}
        assert {r.id for r in got.waiting.collect()} == {"b", "c"}
        assert {(r.id, r.reason) for r in got.refused.collect()} == {("e", "no_cycle"), ("f", "late_cycle")}
        assert {(r.mode, r.cycle) for r in got.log.collect()} == {("bus", 2), ("bus", 3)}
        assert {tuple(r) for r in got.fence.collect()} == {("bus", 1), (None, 1), ("tube", 9)}
        nothing = barrier.release(
            spark.createDataFrame([], "mode string, cycle bigint, id string"), spark.createDataFrame([], schemas.POLL),
            spark.createDataFrame([], schemas.FENCE), stage, patience=3,
        )
        assert nothing.rows.count() == nothing.refused.count() == nothing.fence.count() == 0


def test_late_rows_change_nothing(spark):
    schema = "mode string, station_key string, cycle bigint, digest string"
    state = spark.createDataFrame([("bus", "S490A", 5, "x", 5), (None, "S490N", 5, "x", 5)], schemas.STATION_STATE)
    came = [("bus", "S490A", 3, "x"), ("bus", "S490A", 5, "y"), ("bus", "S490A", 6, "z"), ("bus", "S490B", 4, "w"), ("bus", "S490B", 7, "w"), (None, "S490N", 2, "x"), ("tube", "S940A", 1, "t")]
    settled = spark.createDataFrame([("bus", 4), ("bus", 2), ("dlr", 9)], schemas.FENCE)
    good, late = changes.timely(spark.createDataFrame(came, schema), state, settled)
    assert {(r.station_key, r.cycle) for r in good.collect()} == {("S490A", 6), ("S490B", 7), ("S940A", 1)}
    assert {(r.station_key, r.cycle, r.reason) for r in late.collect()} == {
        ("S490A", 3, "late_station"), ("S490A", 5, "late_station"), ("S490B", 4, "late_cycle"), ("S490N", 2, "late_station"),
    }


def test_a_late_cycle_is_reported_and_emits_nothing(spark):
    def cycles(*wanted):
        rows = [r for c in wanted for r in snapshot(c)]
        return feeds.normalise_arrivals(spark.createDataFrame([{**r, "expectedArrival": r["expectedArrival"][:-1], "fetched_at": r["fetched_at"][:-1]} for r in rows], ", ".join(f"{n} {'string' if k == 'timestamp' else k}" for n, k in schemas.RAW_ARRIVAL.types.items())).withColumns({c: F.col(c).cast("timestamp") for c in ("expectedArrival", "fetched_at")}))

    first = run_cycles(cycles(0, 1, 5), settings=SMALL)
    late = run_cycles(cycles(3), state=first.state, settings=SMALL)
    assert late.messages.count() == 0 and rows_of(late.state) == rows_of(first.state)
    assert {(r.station_key, r.cycle, r.reason) for r in late.late.collect()} == {("Station_490A", 3, "late_station"), ("Station_490B", 3, "late_station")}


def board_rows(cycle):
    now = START + timedelta(seconds=30 * cycle)
    due = (START + timedelta(minutes=30 + cycle)).isoformat() + "Z"
    return [
        {
            "mode": "tube", "cycle": cycle, "feed_seq": i, "fetched_at": now.isoformat() + "Z", "requestedStation": "940X", "requestedLine": "v",
            "lineId": "v", "platformName": "1", "destinationName": f"End {i}", "destinationNaptanId": f"t{i}", "departureStatus": "OnTime",
            "estimatedTimeOfDeparture": due, "scheduledTimeOfDeparture": due,
        }
        for i in range(2)
    ]


@pytest.mark.parametrize("per_trigger", [1, 2, 3])
def test_stream_of_parts_equals_batch_replay(spark, tmp_path, per_trigger):
    """Each poll lands in two files, its log row after them; the tube has boards only, and one cycle comes too late."""
    arrivals, boards, log, whole = (str(tmp_path / n) for n in ("arrivals", "boards", "log", "whole"))
    stamp = 1_700_000_000

    def put(folder, name, rows):
        import os

        nonlocal stamp
        land(folder, name, rows)
        stamp += 1
        os.utime(os.path.join(folder, f"{name}.json"), (stamp, stamp))

    def poll(mode, cycle, n, boards_n=None):
        return {"mode": mode, "cycle": cycle, "fetched_at": (START + timedelta(seconds=30 * cycle)).isoformat() + "Z", "arrivals": n, "boards": boards_n}

    for cycle in range(CYCLES):
        rows = snapshot(cycle)
        put(boards, f"{cycle:03d}", board_rows(cycle))
        put(whole, f"{cycle:03d}", rows)
        for part in range(2):
            put(arrivals, f"{cycle:03d}-{part}", rows[part::2])
        put(log, f"{cycle:03d}", [poll("bus", cycle, len(rows)), poll("tube", cycle, 0, 2)])
    put(arrivals, "late", [{**r, "cycle": 4, "feed_seq": 900 + i} for i, r in enumerate(snapshot(1))])

    planned = spark.createDataFrame([("tube", c, "940X", "X", "v", "Vic") for c in range(CYCLES)], schemas.PLANNED)
    tables = {"boards": feeds.boards(spark, boards), "planned": planned}
    polled = spark.createDataFrame([(m, c) for c in range(CYCLES) for m in ("bus", "tube")], schemas.FENCE)
    batch = run_cycles(feeds.arrivals(spark, whole), settings=SMALL, polled=polled, **tables)
    expected = rows_of(batch.emissions.select("cycle", "station_key", "reason"))
    assert ("Station_940X" in {r[1] for r in expected}) and {r[2] for r in expected} == {"changed", "heartbeat", "wipe"}

    root = str(tmp_path / "out")
    stream = spark.readStream.schema(schemas.RAW_ARRIVAL).option("maxFilesPerTrigger", per_trigger).json(arrivals)
    # The log keeps step with the rows or is ahead of them; the late file comes after its cycle either way.
    polls = spark.readStream.schema(schemas.POLL).option("maxFilesPerTrigger", 3 if per_trigger == 3 else 1).json(log)
    jobs.station_updates(
        feeds.normalise_arrivals(stream), root, polls=polls, context=lambda s: tables, settings=SMALL
    ).awaitTermination()
    sent = spark.read.parquet(f"{root}/emitted/stations")
    assert rows_of(sent.select("cycle", "station_key", "reason")) == expected
    state = VersionedTable(spark, f"{root}/state/stations", schemas.STATION_STATE).read()
    assert rows_of(state) == rows_of(batch.state)
    refused = spark.read.parquet(f"{root}/refused/arrivals")
    assert {(r.cycle, r.reason) for r in refused.collect()} == {(4, "late_cycle")} and refused.count() == 18
    # No wipe but the one of the station that went.
    assert [r for r in expected if r[2] == "wipe"] == [(3, "Station_490C", "wipe")]
    assert outbox.read_outbox(spark, f"{root}/outbox/stations").count() > 0
    waiting = VersionedTable(spark, f"{root}/waiting/arrivals", schemas.ARRIVAL).read()
    assert waiting.count() == 0
