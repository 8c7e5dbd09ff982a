"""Change detection, heartbeats and disappearance wipes over a feed's history.

Works on presence rows, one per key and cycle in which the station was in the
feed. With ``state`` from an earlier run the history simply goes on, so a
replay in one go and micro-batches of any size give the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaboard.operators.history import BLOCK, laid_out, nearest, with_block
from deltaboard.settings import DEFAULTS, WIPE_PATTERNS, Settings

STATE_KEYS = ["mode", "station_key"]
CHANGED, HEARTBEAT, WIPE = "changed", "heartbeat", "wipe"
LATE_STATION, LATE_CYCLE = "late_station", "late_cycle"


def polls_of(arrivals: DataFrame) -> DataFrame:
    """Poll log of a feed: arrivals per mode and cycle, after the filters."""
    return arrivals.groupBy("mode", "cycle").agg(F.count(F.lit(1)).alias("arrivals"))


def polls_of_summary(summary: DataFrame, polled: DataFrame | None = None) -> DataFrame:
    """The same from a feed summary, which has the counts already.

    ``polled`` (mode, cycle) adds the polls that have no arrivals.
    """
    counts = summary.select("mode", "cycle", "n")
    if polled is not None:
        counts = counts.unionByName(polled.select("mode", "cycle", F.lit(0).cast("bigint").alias("n")))
    return counts.groupBy("mode", "cycle").agg(F.sum("n").alias("arrivals"))


def relevant(key: Column, mode: Column, patterns: Mapping[str, str] = WIPE_PATTERNS) -> Column:
    """Whether a poll of ``mode`` may wipe a station; never for modes without a pattern."""
    hit = F.lit(False)
    for name, text in patterns.items():
        hit = hit | ((F.lower(mode) == name) & key.contains(text))
    return F.coalesce(hit, F.lit(False))


def _next_healthy_polls(
    polls: DataFrame, modes: Sequence[str], guard: int, size: int
) -> DataFrame:
    """Per cycle, for each mode, the next cycle with more than ``guard`` arrivals."""
    wide = polls.groupBy("cycle").agg(
        *[F.max(F.when(F.lower("mode") == m, F.col("arrivals"))).alias(f"_n{i}") for i, m in enumerate(modes)]
    )
    spread = wide.withColumn("_all", F.lit(0))
    found = nearest(
        laid_out(spread, ["_all"], "cycle", size),
        ["_all"],
        "cycle",
        after={f"_next{i}": F.when(F.col(f"_n{i}") > guard, F.col("cycle")) for i in range(len(modes))},
    )
    return found.select("cycle", *[f"_next{i}" for i in range(len(modes))])


def with_wipe_cycle(
    presence: DataFrame,
    polls: DataFrame,
    *,
    guard: int | None,
    patterns: Mapping[str, str],
    own_mode_only: bool,
    size: int,
) -> DataFrame:
    """Add ``_healthy``: first later poll that would wipe the station if it is absent.

    Looking up one row per cycle replaces a range join of gaps and polls.
    """
    if guard is None or not patterns:
        return presence.withColumn("_healthy", F.lit(None).cast("bigint"))
    modes = [m.lower() for m in patterns]
    # Cycles known from the state only have no poll of their own.
    ticks = polls.select("mode", "cycle", F.col("arrivals").cast("bigint").alias("arrivals"))
    if "_start" in presence.columns:
        old = presence.where(F.col("_start").isNotNull()).select("cycle").distinct()
        ticks = ticks.unionByName(
            old.select(F.lit(None).cast("string").alias("mode"), "cycle", F.lit(0).cast("bigint").alias("arrivals"))
        )
    following = _next_healthy_polls(ticks, modes, guard, size)
    choices = []
    for i, (m, text) in enumerate(patterns.items()):
        applies = F.col("station_key").contains(text)
        if own_mode_only:
            applies = applies & (F.lower("mode") == m.lower())
        choices.append(F.when(applies, F.col(f"_next{i}")))
    first = F.least(*choices) if len(choices) > 1 else choices[0]
    return presence.join(following, "cycle", "left").withColumn("_healthy", first).drop(
        *[f"_next{i}" for i in range(len(modes))]
    )


def timely(presence: DataFrame, state: DataFrame, settled: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Split presence rows into those to judge and those that come too late, with the reason.

    A row is late if the state of its station is of the same or a later cycle, or
    if ``settled`` (mode, cycle) has a cycle of its mode that is not before it: a
    station that was wiped has no state any more, but the wipe had its cycle.
    """
    seen = state.select(*[F.col(c).alias(f"_{c}") for c in STATE_KEYS], F.col("cycle").alias("_judged"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in STATE_KEYS]
    marked = presence.join(seen, same[0] & same[1], "left").drop(*[f"_{c}" for c in STATE_KEYS])
    if settled is not None:
        last = settled.groupBy(F.col("mode").alias("_of")).agg(F.max("cycle").alias("_settled"))
        marked = marked.join(F.broadcast(last), F.col("mode").eqNullSafe(F.col("_of")), "left").drop("_of")
    else:
        marked = marked.withColumn("_settled", F.lit(None).cast("bigint"))
    reason = F.when(F.col("cycle") <= F.col("_judged"), LATE_STATION).when(F.col("cycle") <= F.col("_settled"), LATE_CYCLE)
    judged = marked.withColumn("reason", reason).drop("_judged", "_settled")
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def _step_rule(every: int):
    """Last emission after a row: brought in by state, due now, or as before."""

    def after(last: Column, tick: Column, changed: Column, start: Column) -> Column:
        return F.when(start.isNotNull(), start).when(changed | (tick - last >= every), tick).otherwise(last)

    return after


def _differs(prev: Column, tick: Column, digest: Column, start: Column) -> Column:
    """Whether a row changes against the row before: other content, or wiped in between."""
    wiped = F.coalesce(prev["healthy"] < tick, F.lit(False))
    return start.isNull() & (prev.isNull() | wiped | ~prev["digest"].eqNullSafe(digest))


def _flagged(steps: Column, first_changed: Column) -> Column:
    """Steps of a block with ``changed``; the first one's flag comes from outside."""

    def flag(s: Column, i: Column) -> Column:
        own = _differs(F.get(steps, i - 1), s["tick"], s["digest"], s["start"])
        return s.withField("changed", F.when(i == 0, first_changed).otherwise(own))

    return F.transform(steps, flag)


def _entry_age(last: Column, link: Column, changed: Column, every: int, size: int) -> Column:
    """Age of the last emission at a link's start; a change emits at once, as every age from ``every`` up does."""
    return F.when(changed, every).otherwise(F.least(link["block"] * size - last, F.lit(every))).cast("int")


def _linked(links: Column) -> Column:
    """Links with ``changed`` and ``next_tick`` from their neighbours; the ends get theirs from outside."""

    def mark(b: Column, i: Column) -> Column:
        first, prev = b["first"], F.get(links, i - 1)["last"]
        return F.struct(
            b["block"].alias("block"),
            b["ends"].alias("ends"),
            ((i > 0) & _differs(prev, first["tick"], first["digest"], first["start"])).alias("changed"),
            F.get(links, i + 1)["first"]["tick"].alias("next_tick"),
        )

    return F.transform(links, mark)


def _walked(marks: Column, before: Column, changed: Column, next_tick: Column, every: int, size: int) -> Column:
    """Last emission after the links, and for each link what it starts with."""
    kind = "array<struct<block:bigint,entry:bigint,changed:boolean,next_tick:bigint>>"
    origin = F.struct(before.cast("bigint").alias("last"), F.array().cast(kind).alias("links"))

    def step(state: Column, b: Column) -> Column:
        first = F.size(state["links"]) == 0
        now = F.when(first, changed).otherwise(b["changed"])
        entry = F.struct(
            b["block"].alias("block"), state["last"].alias("entry"), now.alias("changed"),
            F.coalesce(b["next_tick"], next_tick).alias("next_tick"),
        )
        age = _entry_age(state["last"], b, now, every, size)
        return F.struct(F.element_at(b["ends"], age).alias("last"), F.array_append(state["links"], entry).alias("links"))

    return F.aggregate(marks, origin, step)


def _chain(blocks: DataFrame, keys: list[str], every: int, size: int, group: int) -> tuple[DataFrame, DataFrame]:
    """What each block starts with, and per key the last row and emission.

    How a block goes on depends on the age of the last emission at its start
    only, and all ages from ``every`` up act alike: they emit at once, as a change
    does. So a block is a map from ages to ends, plus its first and last row, and
    such maps compose: ``group`` blocks in a row are summed up in the same form.
    The groups of a key are chained, then the blocks of each group, so no list is
    longer than ``group`` blocks or the groups of a key.
    """
    rule = _step_rule(every)
    ages = F.array(*[F.col(BLOCK) * size - age for age in range(1, every + 1)])
    ends = F.aggregate(
        _flagged(F.col("_steps"), F.lit(False)),
        ages,
        lambda lasts, s: F.transform(lasts, lambda last: rule(last, s["tick"], s["changed"], s["start"])),
    )
    parts = ["block", "first", "last", "ends"]
    single = blocks.select(
        *keys,
        F.col(BLOCK).alias("block"),
        F.element_at("_steps", 1).alias("first"),
        F.element_at("_steps", -1).alias("last"),
        ends.alias("ends"),
    )
    gathered = F.array_sort(F.collect_list(F.struct(*parts)))
    groups = (
        single.groupBy(*keys, F.floor(F.col("block") / group).alias("_group"))
        .agg(gathered.alias("_links"))
        .withColumn("_marks", _linked(F.col("_links")))
    )
    head = F.element_at("_links", 1)
    entry_ages = F.array(*[head["block"] * size - age for age in range(1, every + 1)])
    composed = F.aggregate(
        "_marks",
        entry_ages,
        lambda lasts, b: F.transform(
            lasts, lambda last: F.element_at(b["ends"], _entry_age(last, b, b["changed"], every, size))
        ),
    )
    summary = groups.select(
        *keys, head["block"].alias("block"), head["first"].alias("first"), F.element_at("_links", -1)["last"].alias("last"),
        composed.alias("ends"),
    )
    chained = summary.groupBy(*keys).agg(gathered.alias("_links"))
    long_ago, never = F.lit(-(2**62)), F.lit(None).cast("bigint")
    outer = chained.select(
        *keys,
        F.element_at("_links", -1)["last"].alias("_newest"),
        # The first row of a key has nothing before it: it changes, unless it is the state.
        _walked(_linked(F.col("_links")), long_ago, F.element_at("_links", 1)["first"]["start"].isNull(), never, every, size).alias("_walked"),
    )
    # explode_outer: there is always a link, and explode would walk twice to check.
    starts = outer.select(*keys, F.explode_outer("_walked.links").alias("_start")).select(
        *keys, F.col("_start.block").alias("_head"), "_start.entry", "_start.changed", "_start.next_tick"
    )
    inner = groups.select(*keys, head["block"].alias("_head"), "_marks").join(starts, [*keys, "_head"])
    entries = inner.select(
        *keys,
        F.explode_outer(
            _walked(F.col("_marks"), F.col("entry"), F.col("changed"), F.col("next_tick"), every, size)["links"]
        ).alias("_link"),
    ).select(*keys, F.col("_link.block").alias(BLOCK), "_link.entry", "_link.changed", "_link.next_tick")
    return outer, entries


def replay(
    presence: DataFrame,
    polls: DataFrame,
    *,
    keys: Sequence[str] = tuple(STATE_KEYS),
    state: DataFrame | None = None,
    guard: int | None = DEFAULTS.wipe_guard_arrivals,
    patterns: Mapping[str, str] = WIPE_PATTERNS,
    own_mode_only: bool = True,
    settings: Settings = DEFAULTS,
) -> tuple[DataFrame, DataFrame]:
    """Emissions and the state after the last cycle.

    ``presence``: mode, station_key, cycle, digest; one row per key and cycle.
    ``polls``: mode, cycle, arrivals. ``guard=None`` switches wipes off.
    Emissions: mode, station_key, cycle, reason, digest (null for a wipe). The
    state holds the keys that are not wiped by the last poll.

    A key's history is walked in blocks of ``settings.block_cycles`` cycles and
    groups of ``settings.group_blocks`` blocks, so no task holds more than one
    block of a key, one small row per block of a group, and one per group.
    """
    keys = list(keys)
    size, every = settings.block_cycles, settings.heartbeat_cycles
    others = [c for c in STATE_KEYS if c not in keys]
    rows = presence.select(*STATE_KEYS, "cycle", "digest", F.lit(None).cast("bigint").alias("_start"))
    if state is not None:
        rows = rows.unionByName(
            state.select(*STATE_KEYS, "cycle", "digest", F.col("last_emit").cast("bigint").alias("_start"))
        )
    gapped = with_wipe_cycle(
        rows, polls, guard=guard, patterns=patterns, own_mode_only=own_mode_only, size=size
    )
    step = F.struct(
        F.col("cycle").cast("bigint").alias("tick"), "digest", F.col("_healthy").alias("healthy"),
        F.col("_start").alias("start"), *others,
    )
    blocks = (
        with_block(gapped, keys, "cycle", size)
        .groupBy(*keys, BLOCK)
        .agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    )
    chain, entries = _chain(blocks, keys, every, size, settings.group_blocks)

    rule = _step_rule(every)
    flagged = _flagged(F.col("_steps"), F.col("changed"))
    opening = F.struct(F.col("entry").alias("last"), F.array().cast("array<bigint>").alias("beats"))

    def walk(acc: Column, s: Column) -> Column:
        due = s["start"].isNull() & ~s["changed"] & (s["tick"] - acc["last"] >= every)
        return F.struct(
            rule(acc["last"], s["tick"], s["changed"], s["start"]).alias("last"),
            F.when(due, F.array_append(acc["beats"], s["tick"])).otherwise(acc["beats"]).alias("beats"),
        )

    def sent(beats: Column) -> Column:
        def judge(s: Column, i: Column) -> Column:
            later = F.coalesce(
                F.get(F.col("_steps"), i + 1)["tick"], F.col("next_tick"), F.lit(2**62).cast("bigint")
            )
            return F.struct(
                *[s[c].alias(c) for c in ("tick", "digest", "changed", *others)],
                (~s["changed"] & F.array_contains(beats, s["tick"])).alias("beat"),
                F.when(s["healthy"] < later, s["healthy"]).alias("wiped"),
            )

        return F.filter(F.transform(flagged, judge), lambda s: s["changed"] | s["beat"] | s["wiped"].isNotNull())

    # The heartbeats are bound to a lambda variable, so the walk is done once per block.
    found = F.element_at(F.transform(F.array(F.aggregate(flagged, opening, walk)["beats"]), sent), 1)
    no_digest = F.lit(None).cast("string")
    kinds = F.array(
        F.when(F.col("_s.changed"), F.struct(F.col("_s.tick").alias("cycle"), F.lit(CHANGED).alias("reason"), F.col("_s.digest").alias("digest"))),
        F.when(F.col("_s.beat"), F.struct(F.col("_s.tick").alias("cycle"), F.lit(HEARTBEAT).alias("reason"), F.col("_s.digest").alias("digest"))),
        F.when(F.col("_s.wiped").isNotNull(), F.struct(F.col("_s.wiped").alias("cycle"), F.lit(WIPE).alias("reason"), no_digest.alias("digest"))),
    )
    emissions = (
        blocks.join(entries, [*keys, BLOCK])
        .select(*keys, F.explode(found).alias("_s"))
        .select(*keys, *[F.col(f"_s.{c}").alias(c) for c in others], F.explode(kinds).alias("_e"))
        .where(F.col("_e").isNotNull())
        .select(*STATE_KEYS, "_e.cycle", "_e.reason", "_e.digest")
    )
    after = chain.where(F.col("_newest.healthy").isNull()).select(
        *keys,
        *[F.col(f"_newest.{c}").alias(c) for c in others],
        F.col("_newest.tick").alias("cycle"),
        F.col("_newest.digest").alias("digest"),
        F.col("_walked.last").alias("last_emit"),
    )
    return emissions, after.select(*STATE_KEYS, "cycle", "digest", "last_emit")


def cycle_summary(polls: DataFrame, docs: DataFrame, emissions: DataFrame) -> DataFrame:
    """Arrivals in, stations and emissions per reason, per mode and cycle."""
    stations = docs.groupBy("mode", "cycle").agg(F.count(F.lit(1)).alias("stations"))
    sent = emissions.groupBy("mode", "cycle").agg(
        *[F.count_if(F.col("reason") == r).alias(f"{r}_out") for r in (CHANGED, HEARTBEAT, WIPE)]
    )
    zero = F.lit(0).cast("bigint")
    return (
        polls.join(stations, ["mode", "cycle"], "left")
        .join(sent, ["mode", "cycle"], "left")
        .select(
            "mode",
            "cycle",
            "arrivals",
            *[F.coalesce(c, zero).alias(c) for c in ("stations", "changed_out", "heartbeat_out", "wipe_out")],
        )
    )
