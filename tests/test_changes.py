"""Change detection against a scalar model on random histories."""

import random

import pytest

from deltaboard import schemas
from deltaboard.operators import changes
from deltaboard.settings import Settings

PATTERNS = {"bus": "490", "tube": "940", "dlr": "940GZZD"}


def model(presence, polls, guard, every, own_mode=True):
    """State machine over cycles, as the poller runs it: change, heartbeat, wipe."""
    state, out = {}, []
    for cycle in sorted({c for _, c in polls}):
        for mode in sorted({m for m, c in polls if c == cycle}):
            here = {k: d for (m, k, c), d in presence.items() if m == mode and c == cycle}
            for key, digest in here.items():
                slot = (mode, key)
                last = state.get(slot)
                changed = last is None or last[0] != digest
                if changed or cycle - last[1] >= every:
                    out.append((mode, key, cycle, "changed" if changed else "heartbeat", digest))
                    last = (digest, cycle)
                state[slot] = (*last[:2], cycle)
            if guard is not None and polls[mode, cycle] > guard:
                for m, key in list(state):
                    if key in here or PATTERNS.get(mode, "\0") not in key:
                        continue
                    if m != mode:
                        continue
                    out.append((m, key, cycle, "wipe", None))
                    del state[m, key]
    left = sorted((m, k, c, d, e) for (m, k), (d, e, c) in state.items())
    return sorted(out, key=str), left


def random_history(seed, cycles):
    rnd = random.Random(seed)
    modes = {"bus": "Station_490", "tube": "Station_940GZZLU", "overground": "Station_910G"}
    presence, polls = {}, {}
    for mode, prefix in modes.items():
        for c in range(cycles):
            if rnd.random() < 0.15:
                continue  # no poll in this cycle
            polls[mode, c] = rnd.choice([10, 50, 51, 200])
            for i in range(4):
                if rnd.random() < [0.95, 0.6, 0.2, 0.8][i]:
                    same = rnd.random() < 0.8
                    presence[mode, f"{prefix}{i}", c] = "a" if same else rnd.choice("bc")
    return presence, polls


def frames(spark, presence, polls, lo=0, hi=10**9):
    rows = [(m, k, c, d) for (m, k, c), d in presence.items() if lo <= c < hi]
    logs = [(m, c, n) for (m, c), n in polls.items() if lo <= c < hi]
    return (
        spark.createDataFrame(rows, "mode string, station_key string, cycle bigint, digest string"),
        spark.createDataFrame(logs, "mode string, cycle bigint, arrivals bigint"),
    )


def listed(df):
    return sorted((tuple(r) for r in df.select("mode", "station_key", "cycle", "reason", "digest").collect()), key=str)


@pytest.mark.parametrize(("block", "group"), [(1, 1024), (7, 1), (2, 3)])
@pytest.mark.parametrize("guard", [None, 50])
def test_replay_equals_the_model(spark, block, group, guard):
    for seed in (1, 2):
        presence, polls = random_history(seed, 60)
        seen, log = frames(spark, presence, polls)
        sent, state = changes.replay(seen, log, guard=guard, settings=Settings(block_cycles=block, group_blocks=group))
        expected, left = model(presence, polls, guard, 5)
        assert listed(sent) == expected
        assert sorted(tuple(r) for r in state.select("mode", "station_key", "cycle", "digest", "last_emit").collect()) == left


@pytest.mark.parametrize("cuts", [[13, 14, 40], [5, 10, 11, 45]])
def test_micro_batches_equal_one_replay(spark, cuts):
    presence, polls = random_history(3, 60)
    expected, left = model(presence, polls, 50, 5)
    edges, state, got = [0, *cuts, 60], None, []
    for lo, hi in zip(edges, edges[1:]):
        seen, log = frames(spark, presence, polls, lo, hi)
        sent, after = changes.replay(seen, log, state=state, settings=Settings(block_cycles=4, group_blocks=2))
        got += listed(sent)
        state = spark.createDataFrame(after.collect(), schemas.STATION_STATE)
    assert sorted(got, key=str) == expected
    assert sorted(tuple(r) for r in state.collect()) == left


def emitted(spark, presence, polls, **kw):
    seen, log = frames(spark, presence, polls)
    return [r[1:4] for r in listed(changes.replay(seen, log, **kw)[0])]


def test_heartbeat_is_due_at_exactly_five_cycles(spark):
    key = "Station_490A"
    presence = {("bus", key, c): "a" for c in (1, 5, 6, 10, 12)}
    polls = {("bus", c): 9 for c in range(1, 13)}
    assert emitted(spark, presence, polls) == [(key, 1, "changed"), (key, 12, "heartbeat"), (key, 6, "heartbeat")]


def test_wipe_needs_more_than_fifty_arrivals(spark):
    key = "Station_490A"
    presence = {("bus", key, 1): "a", ("bus", key, 4): "a"}
    polls = {("bus", 1): 60, ("bus", 2): 50, ("bus", 3): 51, ("bus", 4): 60}
    assert emitted(spark, presence, polls) == [(key, 1, "changed"), (key, 3, "wipe"), (key, 4, "changed")]


def test_wipe_relevance_across_modes(spark):
    """With station-only keys a tube poll may wipe a light-rail station."""
    key = "Station_940GZZDL1"
    presence = {("dlr", key, 1): "a"}
    polls = {("dlr", 1): 60, ("tube", 1): 60, ("tube", 2): 60}
    assert emitted(spark, presence, polls) == [(key, 1, "changed")]
    loose = emitted(spark, presence, polls, keys=["station_key"], own_mode_only=False)
    assert loose == [(key, 1, "changed"), (key, 2, "wipe")]


def test_rail_without_a_pattern_is_never_wiped(spark):
    presence = {("overground", "Station_910G1", 1): "a"}
    polls = {("overground", c): 500 for c in range(1, 5)}
    assert emitted(spark, presence, polls) == [("Station_910G1", 1, "changed")]


def test_one_station_with_a_third_of_all_rows(spark):
    """A long history of one key is walked in bounded blocks, with the same result."""
    from pyspark.sql import functions as F

    n = 9000
    hot = spark.range(n).select(F.lit("bus").alias("mode"), F.lit("Station_490HOT").alias("station_key"), F.col("id").alias("cycle"), F.floor(F.col("id") / 97).cast("string").alias("digest"))
    rest = spark.range(2 * n).select(F.lit("bus").alias("mode"), F.concat(F.lit("Station_490"), (F.col("id") % 300).cast("string")).alias("station_key"), F.floor(F.col("id") / 300).alias("cycle"), F.lit("x").alias("digest"))
    seen = hot.unionByName(rest)
    sent, _ = changes.replay(seen, changes.polls_of(seen), guard=None, settings=Settings(block_cycles=64))
    got = sorted((r.cycle, r.reason) for r in sent.where("station_key = 'Station_490HOT'").collect())
    expected, last = [], None
    for c in range(n):
        changed = c % 97 == 0
        if changed or c - last >= 5:
            expected.append((c, "changed" if changed else "heartbeat"))
            last = c
    assert got == expected


def test_a_million_cycles_of_one_key(spark):
    """Blocks, groups of blocks and the list of groups are all short."""
    from pyspark.sql import functions as F

    n = 1_000_000
    one = spark.range(n).select(
        F.lit("bus").alias("mode"), F.lit("Station_490").alias("station_key"), F.col("id").alias("cycle"),
        F.floor(F.col("id") / 97).cast("string").alias("digest"),
    )
    polls = spark.createDataFrame([("bus", 0, 0)], "mode string, cycle bigint, arrivals bigint")
    small = Settings(block_cycles=100, group_blocks=100)
    sent, state = changes.replay(one, polls, guard=None, settings=small)
    got = sent.groupBy("reason", (F.col("cycle") % 97).alias("at")).count().collect()
    expected = {}
    for c in range(n):
        at = c % 97
        if at % 5 == 0:
            key = ("changed" if at == 0 else "heartbeat", at)
            expected[key] = expected.get(key, 0) + 1
    assert {(r["reason"], r["at"]): r["count"] for r in got} == expected
    assert state.select("cycle", "last_emit").head()[:] == (n - 1, n - 1 - (n - 1) % 97 % 5)
