"""Line status change detection: reference cases and a scalar model."""

import random

import pytest
from pyspark.sql import functions as F

from deltaboard import schemas
from deltaboard.functions.lookups import GOOD_SERVICE_MESSAGES
from deltaboard.operators import linestatus
from deltaboard.plans.statuses import run_syncs
from deltaboard.settings import Settings


def raw(spark, rows):
    """Rows (sync, line, description, reason) with one status entry and no code."""
    full = [(s, i, None, "tube", line, line.title(), [(None, d, r)]) for i, (s, line, d, r) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.RAW_LINE_STATUS)


def channels(spark, rows, **kw):
    result = run_syncs(raw(spark, rows), updated_ms=F.lit(7), **kw)
    got = {"push": [], "stream_lines": []}
    for r in result.messages.orderBy("sync_id").collect():
        got[r.channel].append((r.sync_id, r.topic))
    return got["push"], got["stream_lines"], result


def test_first_sync_primes_without_push(spark):
    push, stream, _ = channels(spark, [(1, "victoria", "Severe Delays", "Signal failure")])
    assert push == [] and stream == [(1, "victoria")]


def test_empty_sync_does_not_prime(spark):
    """Sync 1 returned nothing, so sync 2 is the one that primes."""
    push, stream, _ = channels(spark, [(2, "victoria", "Severe Delays", "Signal failure")])
    assert push == [] and stream == [(2, "victoria")]


def test_change_is_pushed(spark):
    push, stream, _ = channels(spark, [(1, "victoria", "Good Service", ""), (2, "victoria", "Minor Delays", "Busy")])
    assert push == [(2, "LineStatus_tube_victoria")] and stream == [(1, "victoria"), (2, "victoria")]


def test_no_change_keeps_the_message(spark):
    push, stream, result = channels(spark, [(1, "victoria", "Good Service", ""), (2, "victoria", "Good Service", "")])
    assert push == [] and stream == [(1, "victoria")]
    shown = [r.shown_reason for r in result.history.orderBy("sync_id").collect()]
    assert shown[0] in GOOD_SERVICE_MESSAGES and shown[1] == shown[0]


def test_stream_is_keyed_by_the_bare_line(spark):
    _, stream, _ = channels(
        spark, [(1, "victoria", "Good Service", ""), (2, "victoria", "Severe Delays", "Signal failure")], primed=True
    )
    assert stream[-1] == (2, "victoria")


def blank(x):
    return x is None or x.strip() == ""


def model(rows, baseline=None):
    """The sync loop: compare with the old baseline, then store the changed rows."""
    cache, out = dict(baseline or {}), []
    for sync in sorted({r[0] for r in rows}):
        old_cache = dict(cache)
        for s, seq, line, desc, reason in sorted(rows):
            if s != sync:
                continue
            good, shown = desc.lower() == "good service", reason
            old = old_cache.get(line)
            if old is None:
                changed = True
            else:
                changed = old[0] != desc
                if not blank(reason):
                    changed |= old[1] != reason
                elif good and old[0].lower() == "good service":
                    shown = old[1]
                elif good:
                    changed = True
                else:
                    changed |= not blank(old[1])
            if changed and good and blank(shown):
                shown = GOOD_SERVICE_MESSAGES[seq % 12]
            if changed:
                cache[line] = (desc, shown)
            out.append((s, seq, line, shown, changed))
    return sorted(out), cache


def random_rows(seed, n=300):
    rnd = random.Random(seed)
    rows = []
    for seq in range(n):
        desc = rnd.choice(["Good Service", "Good Service", "good service", "Minor Delays", "Severe Delays"])
        rows.append((seq // 4 * (1 + seq // 150), seq, f"l{seq % 4}", desc, rnd.choice([None, "", " ", "x", "y"])))
    return rows


def history(spark, rows, **kw):
    df = spark.createDataFrame([(s, q, "tube", line, line, d, r) for s, q, line, d, r in rows], "sync_id bigint, feed_seq bigint, mode string, id string, name string, description string, reason string")
    return linestatus.status_history(df, index=F.col("feed_seq"), **kw)


def listed(df):
    # A blank reason that stays blank may be null, '' or spaces; it shows nothing.
    rows = df.select("sync_id", "feed_seq", "id", "shown_reason", "changed").collect()
    return sorted((r[0], r[1], r[2], None if blank(r[3]) else r[3], r[4]) for r in rows)


def tidy(rows):
    return [(s, q, line, None if blank(r) else r, c) for s, q, line, r, c in rows]


@pytest.mark.parametrize("block", [3, 1024])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_history_equals_the_model(spark, seed, block):
    rows = random_rows(seed)
    assert listed(history(spark, rows, settings=Settings(block_cycles=block))) == tidy(model(rows)[0])


def test_micro_batches_equal_one_run(spark):
    rows, state, got = random_rows(4), None, []
    for lo, hi in [(0, 50), (50, 51), (51, 400)]:
        part = [r for r in rows if lo <= r[0] < hi]
        df = history(spark, part, state=state) if part else None
        if df is None:
            continue
        got += listed(df)
        state = spark.createDataFrame(linestatus.state_after(df, state).collect(), schemas.STATUS_STATE)
    assert sorted(got) == tidy(model(rows)[0])


def test_line_listed_twice_compares_with_the_sync_before(spark):
    rows = [(1, 0, "a", "Minor Delays", "x"), (2, 1, "a", "Minor Delays", "x"), (2, 2, "a", "Severe Delays", "y"), (3, 3, "a", "Severe Delays", "y")]
    assert [r[4] for r in listed(history(spark, rows))] == [True, False, True, False]


def test_flat_pick_equals_array_pick(spark):
    rnd = random.Random(5)
    rows = [(i // 5, i % 5, rnd.choice(["6", "9", "10", "x", None, "20", "99"]), f"d{i}", f"r{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "k int, pos int, sev string, description string, reason string")
    flat = linestatus.worst_of_rows(df, ["k"], "pos", "sev", ["description", "reason"])
    nested = df.groupBy("k").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "sev", "description", "reason"))),
            lambda e: F.struct(e["sev"].alias("statusSeverity"), e["description"].alias("statusSeverityDescription"), e["reason"].alias("reason")),
        ).alias("lineStatuses")
    )
    picked = nested.select("k", linestatus.worst_status(F.col("lineStatuses")).alias("w")).select("k", "w.*")
    assert sorted(flat.collect()) == sorted(picked.collect())
