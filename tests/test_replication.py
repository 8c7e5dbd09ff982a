"""Versioned tables, checkpoints, change feeds, outboxes and streams."""

import hashlib
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from deltaboard import schemas
from deltaboard.functions.timing import to_epoch_ms
from deltaboard.operators import replicate
from deltaboard.plans import replication
from deltaboard.plans.arrivals import run_cycles
from deltaboard.plans.statuses import run_syncs
from deltaboard.session import Staging
from deltaboard.settings import Settings
from deltaboard.sources import feeds, outbox
from deltaboard.sources.tables import Checkpoints, KeyedTable, VersionedTable
from deltaboard.streaming import jobs

DOC = schemas.Schema("id string, body string, stamp bigint")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(params=["versioned", "keyed"])
def table(spark, tmp_path, request):
    if request.param == "keyed":
        return KeyedTable(spark, str(tmp_path / "t"), DOC, "id", partitions=8)
    return VersionedTable(spark, str(tmp_path / "t"), DOC)


@pytest.fixture
def marks(spark, tmp_path):
    return Checkpoints(VersionedTable(spark, str(tmp_path / "m"), schemas.SYNC_METADATA))


def test_upsert_delete_and_clear(spark, table):
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("a", "2", 2)], DOC), "id", [F.col("stamp")])
    assert rows_of(table.read()) == [("a", "2", 2), ("b", "1", 1)]
    table.upsert(spark.createDataFrame([("b", "9", 0), (None, "x", 1)], DOC), "id", [F.col("stamp")])
    assert rows_of(table.find("id", "b")) == [("b", "9", 0)]
    table.delete(spark.createDataFrame([("a",)], "id string"), "id")
    assert rows_of(table.read()) == [("b", "9", 0)] and table.count().head()[0] == 1
    table.clear()
    assert table.read().count() == 0 and len(table.versions()) == 4


def test_unfinished_version_is_not_read(spark, table):
    table.upsert(spark.createDataFrame([("a", "1", 1)], DOC), "id", [F.col("stamp")])
    broken = spark.createDataFrame([("a", "1", 1)], DOC).withColumn("body", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception):
        table.upsert(broken, "id", [F.col("stamp")])
    assert rows_of(table.read()) == [("a", "1", 1)]


def test_a_write_costs_what_it_touches(spark, tmp_path):
    """Of a thousand rows in 16 partitions, a batch on one key makes one partition anew; old versions go, rows stay."""
    table = KeyedTable(spark, str(tmp_path / "k"), DOC, "id", partitions=16)
    table.upsert(spark.range(1000).select(F.col("id").cast("string"), F.lit("0" * 200).alias("body"), "id").toDF("id", "body", "stamp"), "id", [F.col("stamp")], 0)
    size = lambda: {f: sum(os.path.getsize(os.path.join(d, x)) for d, _, xs in os.walk(os.path.join(table.path, "data", f)) for x in xs if x.endswith(".parquet")) for f in os.listdir(os.path.join(table.path, "data"))}
    first = size()
    for batch in range(1, 6):
        table.upsert(spark.createDataFrame([("7", f"v{batch}", batch)], DOC), "id", [F.col("stamp")], batch)
    made = [n for f, n in size().items() if f not in first]
    assert len(made) == 5 and max(made) * 8 < sum(first.values())
    table.delete(spark.createDataFrame([("8",), ("none",), (None,)], "id string"), "id", 6)
    table.expire(2)
    assert len(table.versions()) == 2 and len(size()) == 3  # the first write, and two of the single partitions
    assert table.read().count() == 999 and rows_of(table.find("id", "7")) == [("7", "v5", 5)]
    assert rows_of(table.find("body", "v5")) == [("7", "v5", 5)] and table.find("id", "8").count() == 0
    # A replay of the last batch builds on the version before it.
    table.delete(spark.createDataFrame([("9",)], "id string"), "id", 6)
    assert table.read().count() == 999 and table.find("id", "8").count() == 1
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([("7", "x", 1)], DOC), "body", [F.col("stamp")])


def test_old_versions_expire(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "v"), DOC)
    for i in range(5):
        table.write(spark.createDataFrame([("a", str(i), i)], DOC), i)
    table.expire(2)
    assert table.versions() == [3, 4] and rows_of(table.read()) == [("a", "4", 4)] and rows_of(table.read(4)) == [("a", "3", 3)]


def test_set_replacement(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "s"), schemas.SUBSCRIBED)
    table.replace_set(spark.createDataFrame([("a",), ("a",), ("",), (None,), ("b",)], schemas.SUBSCRIBED), "naptan_id")
    assert rows_of(table.read()) == [("a",), ("b",)]
    doc = spark.createDataFrame([("d", {"c": 1, "z": 0}, "1")], schemas.SUBSCRIBED_DOC)
    replication.mirror_subscriptions(doc, table)
    assert rows_of(table.read()) == [("c",)]
    replication.mirror_subscriptions(doc.limit(0), table)
    assert rows_of(table.read()) == [("c",)]


def test_checkpoint_only_moves_forward(marks):
    assert marks.get("x") is None
    for value, expected in [
        ("2026-06-01T02:06:13", "2026-06-01T02:06:13"), ("1748372000000", "1748372000000"),
        ("2027-01-01", "1748372000000"), ("1748372000000.9", "1748372000000"), ("1748372000001", "1748372000001"),
    ]:
        marks.advance("x", value)
        assert marks.get("x") == expected
    assert marks.get("y") is None


def test_delta_sync(spark, table, marks):
    source = [("a", "1", 10), ("b", "1", 20), (None, "1", 99)]
    sync = lambda rows: replication.delta_sync(spark.createDataFrame(rows, DOC), table, marks, "docs", "id", "stamp")
    assert sync(source) == "20"
    assert rows_of(table.read()) == [("a", "1", 10), ("b", "1", 20)]
    assert sync([("a", "old", 20), ("c", "1", 21)]) == "21"  # strictly newer only
    assert rows_of(table.read()) == [("a", "1", 10), ("b", "1", 20), ("c", "1", 21)]
    assert sync([]) == "21"


def test_boot_then_feed_then_replay(spark, table, marks):
    """Boot rows outlive the first batch; a replay and a later boot change nothing; the mark never goes back."""
    boot = spark.createDataFrame([("a", "1", 10), ("b", "1", 20)], DOC)
    assert replication.delta_sync(boot, table, marks, "docs", "id", "stamp") == "20"
    feed = f"{DOC}, op string, change_seq bigint"
    first = spark.createDataFrame([("c", "1", 15, None, 1)], feed)
    second = spark.createDataFrame([("a", None, None, "REMOVED", 2), ("c", "2", 30, None, 3)], feed)
    apply = lambda rows, batch: replication.apply_feed(rows, table, marks, "docs", "id", "stamp", batch)
    for _ in range(2):
        apply(first, 0)
        assert rows_of(table.read()) == [("a", "1", 10), ("b", "1", 20), ("c", "1", 15)]
        assert marks.get("docs") == "20"
    apply(second, 1)
    assert replication.delta_sync(boot, table, marks, "docs", "id", "stamp") == "30"
    apply(second, 1)
    assert rows_of(table.read()) == [("b", "1", 20), ("c", "2", 30)] and marks.get("docs") == "30"


def test_watermarks_of_fractional_types(spark):
    got = spark.sql("select 1748372000000.0D as d, cast(1748372000000.50 as decimal(20, 2)) as m, '12.5' as t")
    assert tuple(got.select(*[to_epoch_ms(F.col(c)) for c in "dmt"]).head()) == (1748372000000, 1748372000000, 0)


def test_boards_are_cut_to_the_cycles_of_the_batch(spark):
    rows = [("bus", 1, "x"), ("bus", 2, "x"), ("tube", 1, "x"), (None, 1, "x")]
    boards = spark.createDataFrame(rows, "mode string, cycle bigint, naptan_id string")
    batch = spark.createDataFrame([("bus", 1), ("bus", 1), (None, 1)], "mode string, cycle bigint")
    got = jobs.tables_of_batch({"boards": boards, "planned": None, "patterns": {"a": 1}}, batch)
    assert {tuple(r) for r in got["boards"].collect()} == {("bus", 1, "x"), (None, 1, "x")}
    assert got["planned"] is None and got["patterns"] == {"a": 1}


def test_merge_takes_the_last_change(spark):
    base = spark.createDataFrame([("a", "0", 0), ("b", "0", 0)], DOC)
    feed = spark.createDataFrame(
        [("a", "1", 1, "MODIFIED", 1), ("a", None, None, "REMOVED", 2), ("b", None, None, "removed", 3), ("b", "4", 4, "ADDED", 4), ("c", None, None, "REMOVED", 5)],
        f"{DOC}, op string, change_seq bigint",
    )
    assert rows_of(replicate.merge_changes(base, feed, "id", [F.col("change_seq")])) == [("b", "4", 4)]


def land(folder, name, rows):
    """Write a landed file in one step, as the landing job does."""
    os.makedirs(folder, exist_ok=True)
    hidden = os.path.join(folder, f".{name}")
    with open(hidden, "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    os.rename(hidden, os.path.join(folder, f"{name}.json"))


START = datetime(2026, 7, 19, 12)


def snapshot(cycle):
    """One bus poll: a steady station, a changing one, and one that disappears."""
    now = START + timedelta(seconds=30 * cycle)
    rows = []
    for i in range(6):
        for station in ["490A", "490B", "490C"]:
            if station == "490C" and 3 <= cycle < 8:
                continue
            eta = START + timedelta(minutes=20 + i + (cycle // 2 if station == "490B" else 0))
            rows.append(
                {
                    "mode": "bus", "modeName": "bus", "cycle": cycle, "feed_seq": len(rows), "fetched_at": now.isoformat() + "Z",
                    "naptanId": station, "stationName": station, "lineId": "24", "lineName": "24", "direction": "inbound",
                    "destinationId": f"d{i}", "destinationName": "Pimlico", "expectedArrival": eta.isoformat() + "Z", "unknownField": 1,
                }
            )
    return rows


SMALL = Settings(wipe_guard_arrivals=10, block_cycles=4)


@pytest.fixture
def landed(tmp_path):
    folder = str(tmp_path / "arrivals")
    for cycle in range(12):
        land(folder, f"{cycle:03d}", snapshot(cycle))
        stamp = 1_700_000_000 + cycle
        os.utime(os.path.join(folder, f"{cycle:03d}.json"), (stamp, stamp))
    return folder


def test_stream_equals_batch_replay(spark, landed, tmp_path):
    batch = run_cycles(feeds.arrivals(spark, landed), settings=SMALL)
    expected = rows_of(batch.messages.select("cycle", "topic", "reason", "payload"))
    assert {r[2] for r in expected} == {"changed", "heartbeat", "wipe"}
    assert [(r[0], r[1]) for r in expected if r[2] == "wipe"] == [(3, "Station_490C")]

    root = str(tmp_path / "out")
    raw = spark.readStream.schema(schemas.RAW_ARRIVAL).option("maxFilesPerTrigger", 3).json(landed)
    jobs.station_updates(feeds.normalise_arrivals(raw), root, settings=SMALL).awaitTermination()
    sent = outbox.read_outbox(spark, f"{root}/outbox/stations").where("channel = 'push'")
    got = sorted((r.batch_id, r.topic, r.payload) for r in sent.collect())
    # Three cycles make a batch, and a later payload replaces an earlier one.
    newest = {(c // 3, t): p for c, t, _, p in expected}
    assert got == sorted((b, t, p) for (b, t), p in newest.items())
    assert {(r.priority, r.ttl_ms) for r in sent.collect()} == {("HIGH", 90000)}

    state = VersionedTable(spark, f"{root}/state/stations", schemas.STATION_STATE).read()
    assert rows_of(state) == rows_of(batch.state)


def test_cycle_summary_counts(spark, landed):
    result = run_cycles(feeds.arrivals(spark, landed), settings=SMALL)
    rows = {r.cycle: r for r in result.summary.collect()}
    assert (rows[3].arrivals, rows[3].stations, rows[3].wipe_out) == (12, 2, 1)
    assert (rows[0].arrivals, rows[0].changed_out) == (18, 3)


def test_empty_subscription_emits_nothing(spark, landed):
    nobody = spark.createDataFrame([], "naptan_id string")
    result = run_cycles(feeds.arrivals(spark, landed), subscribed=nobody, settings=SMALL)
    assert result.messages.count() == 0 and result.state.count() == 0


def status_rows(sync):
    d = ["Good Service", "Good Service", "Minor Delays", "Good Service"][sync % 4]
    return [
        {"sync_id": sync, "feed_seq": i, "mode": "tube", "id": line, "name": line, "lineStatuses": [{"statusSeverity": 10, "statusSeverityDescription": d if line == "v" else "Good Service"}]}
        for i, line in enumerate(["v", "c"])
    ]


def test_status_stream(spark, tmp_path):
    folder, root = str(tmp_path / "statuses"), str(tmp_path / "out")
    for sync in range(6):
        land(folder, f"{sync}", status_rows(sync))
        os.utime(os.path.join(folder, f"{sync}.json"), (1_700_000_000 + sync,) * 2)
    raw = spark.readStream.schema(schemas.RAW_LINE_STATUS).option("maxFilesPerTrigger", 2).json(folder)
    jobs.status_updates(raw, root).awaitTermination()
    got = sorted((r.batch_id, r.channel, r.topic) for r in outbox.read_outbox(spark, f"{root}/outbox/statuses").collect())
    batch = run_syncs(feeds.line_statuses(spark, folder), updated_ms=F.lit(0)).messages
    expected = {(r.sync_id // 2, r.channel, r.topic) for r in batch.collect()}
    assert set(got) == expected and len(got) == len(expected)


def test_change_feed_stream(spark, tmp_path):
    folder, root = str(tmp_path / "feed"), str(tmp_path / "out")
    land(folder, "0", [{"id": "a", "body": "1", "stamp": 5, "op": "ADDED", "change_seq": 1}, {"id": "b", "body": "1", "stamp": 6, "op": "ADDED", "change_seq": 2}])
    land(folder, "1", [{"id": "a", "op": "REMOVED", "change_seq": 3}, {"id": "b", "body": "2", "stamp": 9, "op": "MODIFIED", "change_seq": 4}])
    for i in range(2):
        os.utime(os.path.join(folder, f"{i}.json"), (1_700_000_000 + i,) * 2)
    stream = feeds.change_feed(spark, folder, DOC, stream=True)
    jobs.replicate_changes(stream, root, "docs", "id", "stamp", DOC).awaitTermination()
    assert rows_of(KeyedTable(spark, f"{root}/tables/docs", DOC, "id").read()) == [("b", "2", 9)]
    marks = Checkpoints(VersionedTable(spark, f"{root}/tables/docs_sync", schemas.SYNC_METADATA))
    assert marks.get("docs") == "9"


def test_pending_replaces_and_caps(spark):
    rows = [("push", f"t{i % 1200}", f"p{i}", i) for i in range(2400)] + [("stream", f"t{i}", "x", i) for i in range(300)]
    df = spark.createDataFrame(rows, "channel string, topic string, payload string, seq int")
    got = outbox.pending(df, [F.col("seq")])
    sizes = {(r.channel, r.batch_no): r["count"] for r in got.groupBy("channel", "batch_no").count().collect()}
    assert sizes == {("push", 0): 500, ("push", 1): 500, ("push", 2): 200, ("stream", 0): 250, ("stream", 1): 50}
    assert all(int(r.payload[1:]) >= 1200 for r in got.where("channel = 'push'").collect())


def test_the_queue_against_a_scalar_one(spark, tmp_path):
    """Three batches with more topics than the cap, a replay, and ticks without messages until nothing is left."""
    small = Settings(push_batch=3, station_batch=2, line_batch=1, ticks_per_batch=2)
    caps = {"push": 3, "stream": 2, "stream_lines": 1}
    line, path = outbox.Queue(spark, str(tmp_path / "queue")), str(tmp_path / "outbox")
    waiting, sent, expected = {}, [], []
    batches = [[(c, f"t{(7 * b + i) % 11}", f"{b}-{i}", i) for c in caps for i in range(9)] + [("push", "t1", f"{b}-late", 99)] for b in range(3)]
    for b in range(8):
        rows = batches[b] if b < 3 else []
        for channel, topic, payload, _ in rows:
            waiting[channel, topic] = (payload, waiting.get((channel, topic), (None, b))[1])
        for channel, cap in caps.items():
            mine = sorted((since, hashlib.md5(t.encode()).hexdigest(), t, p) for (c, t), (p, since) in waiting.items() if c == channel)
            for place, (_, _, topic, payload) in enumerate(mine[: 2 * cap]):
                expected.append((b, channel, topic, payload, place // cap))
                del waiting[channel, topic]
        frame = spark.createDataFrame(rows, "channel string, topic string, payload string, seq int") if rows else None
        for _ in range(2 if b == 1 else 1):
            with Staging(spark, str(tmp_path)) as stage:
                line.tick(frame, [F.col("seq")], path, b, stage, small)
        left = {(r.channel, r.topic): (r.payload, r.since) for r in line.table.read().collect()}
        assert left == waiting
    got = [(r.batch_id, r.channel, r.topic, r.payload, r.batch_no) for r in outbox.read_outbox(spark, path).collect()]
    assert sorted(got) == sorted(expected) and not waiting
    assert {r.priority for r in outbox.read_outbox(spark, path).where("channel = 'stream'").collect()} == {None}


def test_feed_settings_and_aliases():
    assert feeds.mode_list(" bus, ,tube,") == ["bus", "tube"]
