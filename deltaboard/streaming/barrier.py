"""Whole cycles out of parts, and nothing out of cycles that come too late.

Landed rows of one poll may reach a stream in several micro-batches. They wait in
a pending store until the poll log says that the poll is complete, so a station is
never taken for gone because its rows were still on their way, and a poll without
arrivals is a cycle as well. Cycles of a mode leave in order. A cycle that is not
complete when ``patience`` later ones are is given up; rows of a cycle that was
released or given up before are late. Both go to a side output with the reason.

A mode may be null and is then a mode of its own. All tables hold a few rows per
cycle, apart from the rows themselves, which are only filtered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaboard import schemas
from deltaboard.session import Staging

RELEASED, WAITING = "released", "waiting"
LATE, INCOMPLETE, NO_CYCLE = "late_cycle", "incomplete_cycle", "no_cycle"


def _nothing() -> Column:
    return F.lit(None).cast("bigint")


def cycle_verdicts(
    arrived: DataFrame, log: DataFrame, fence: DataFrame, patience: int, boards: DataFrame | None = None
) -> DataFrame:
    """What becomes of each known cycle: mode, cycle, fetched_at, verdict.

    ``arrived`` counts the rows that are there (mode, cycle, n), ``boards``
    likewise the board rows. ``log`` has one row per finished poll: mode, cycle,
    fetched_at, arrivals and boards (how many rows it fetched; null boards are not
    waited for). ``fence`` has the last settled cycle per mode. A poll that is
    logged twice must have the larger count of rows. More rows than logged are
    taken as they are.
    """
    columns = ["mode", "cycle", "seen", "boards_seen", "expected", "boards_expected", "fetched_at", "last"]
    kinds = dict.fromkeys(columns[2:], "bigint") | {"fetched_at": "timestamp"}

    def shaped(df: DataFrame, **given: Column) -> DataFrame:
        filled = {name: given.get(name, F.lit(None)).cast(kind) for name, kind in kinds.items()}
        return df.select("mode", "cycle", *[c.alias(name) for name, c in filled.items()])

    parts = shaped(arrived, seen=F.col("n")).unionByName(
        shaped(log, expected=F.col("arrivals"), boards_expected=F.col("boards"), fetched_at=F.col("fetched_at"))
    )
    if boards is not None:
        parts = parts.unionByName(shaped(boards, boards_seen=F.col("n")))
    # The fence is a row without a cycle, so that a null mode meets its own.
    parts = parts.where(F.col("cycle").isNotNull()).unionByName(
        shaped(fence.withColumn("last", F.col("cycle")).withColumn("cycle", _nothing()), last=F.col("last"))
    )
    totals = parts.groupBy("mode", "cycle").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("seen", "boards_seen")],
        *[F.max(c).alias(c) for c in ("expected", "boards_expected", "fetched_at", "last")],
    )
    of_mode = W.partitionBy("mode")
    known = totals.withColumn("last", F.max("last").over(of_mode)).where(F.col("cycle").isNotNull())
    late = F.coalesce(F.col("cycle") <= F.col("last"), F.lit(False))
    whole = F.coalesce(F.col("seen") >= F.col("expected"), F.lit(False)) & F.coalesce(
        F.col("boards_seen") >= F.col("boards_expected"), F.lit(True)
    )
    # Boards alone say nothing about a poll: they may be there for cycles to come.
    told = (F.col("seen") > 0) | F.col("expected").isNotNull()
    judged = known.where(told).withColumns({"_late": late, "_whole": whole & ~late})
    judged = judged.withColumn("_newest", F.max(F.when(F.col("_whole"), F.col("cycle"))).over(of_mode))
    given_up = ~F.col("_whole") & ~F.col("_late") & (F.col("cycle") <= F.col("_newest") - patience)
    judged = judged.withColumn("_given_up", F.coalesce(given_up, F.lit(False)))
    open_ = ~F.col("_whole") & ~F.col("_late") & ~F.col("_given_up")
    judged = judged.withColumn("_barrier", F.min(F.when(open_, F.col("cycle"))).over(of_mode))
    verdict = (
        F.when(F.col("_late"), LATE)
        .when(F.col("_given_up"), INCOMPLETE)
        .when(F.col("_whole") & (F.col("_barrier").isNull() | (F.col("cycle") < F.col("_barrier"))), RELEASED)
        .otherwise(WAITING)
    )
    return judged.select("mode", "cycle", "fetched_at", "seen", "expected", verdict.alias("verdict"))


def of_cycles(rows: DataFrame, cycles: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` of the given cycles (mode, cycle); null modes are equal."""
    named = cycles.select(F.col("mode").alias("_mode"), F.col("cycle").alias("_cycle")).distinct()
    return rows.join(named, F.col("mode").eqNullSafe(F.col("_mode")) & (F.col("cycle") == F.col("_cycle")), how)


@dataclass
class Release:
    """``rows`` and ``cycles`` that are whole, what waits on, what is refused and why, and the fence after that."""

    rows: DataFrame
    cycles: DataFrame
    waiting: DataFrame
    log: DataFrame
    refused: DataFrame
    fence: DataFrame


def release(
    rows: DataFrame, log: DataFrame, fence: DataFrame, stage: Staging, *, patience: int, boards: DataFrame | None = None
) -> Release:
    """Sort arrival rows by what becomes of their cycle; see ``cycle_verdicts``.

    ``rows`` and ``log`` hold what waited before and what is new; ``boards``
    (mode, cycle, ...) the board rows that are there. Rows without a cycle belong
    to no poll and are refused.
    """
    arrived = rows.where(F.col("cycle").isNotNull()).groupBy("mode", "cycle").agg(F.count(F.lit(1)).alias("n"))
    board_rows = None if boards is None else boards.groupBy("mode", "cycle").agg(F.count(F.lit(1)).alias("n"))
    verdicts = stage(cycle_verdicts(arrived, log, fence, patience, board_rows), "verdicts")

    def having(df: DataFrame, verdict: str) -> DataFrame:
        return of_cycles(df, verdicts.where(F.col("verdict") == verdict))

    refused = rows.where(F.col("cycle").isNull()).withColumn("reason", F.lit(NO_CYCLE))
    for reason in (LATE, INCOMPLETE):
        refused = refused.unionByName(having(rows, reason).withColumn("reason", F.lit(reason)))
    settled = verdicts.where(F.col("verdict").isin(RELEASED, INCOMPLETE)).select("mode", "cycle")
    after = fence.select("mode", "cycle").unionByName(settled).groupBy("mode").agg(F.max("cycle").alias("cycle"))
    released = verdicts.where(F.col("verdict") == RELEASED).select("mode", "cycle", "fetched_at")
    return Release(
        having(rows, RELEASED), released, having(rows, WAITING), having(log, WAITING).select(*schemas.POLL.names), refused, after
    )
