"""Which departure boards to read in a cycle: from the station dimension to a plan table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaboard import schemas
from deltaboard.functions.lookups import BOARD_MODES, STATION_ALIASES
from deltaboard.operators import filters, topology
from deltaboard.session import Staging
from deltaboard.settings import DEFAULTS, Settings
from deltaboard.sources.tables import VersionedTable


@dataclass
class BoardPlan:
    """``planned`` (the plan table, one row per station and line), ``calls`` (the record to ask for each),
    ``summary`` per mode, and the rotation counter for the next plan."""

    planned: DataFrame
    calls: DataFrame
    summary: DataFrame
    rotation: int


def plan_boards(
    stations: DataFrame,
    departing: DataFrame,
    subscribed: DataFrame | None,
    *,
    cycle: int,
    rotation: int = 0,
    modes: Sequence[str] = tuple(BOARD_MODES),
    aliases: Sequence[filters.Alias] = tuple(STATION_ALIASES),
    stage: Staging | None = None,
    settings: Settings = DEFAULTS,
) -> BoardPlan:
    """Boards of one cycle, mode after mode in the order of ``modes``.

    Candidates are the subscribed stations (None: all) with a line of the mode.
    Termini come first, the others on a ring that starts at the counter, and each
    is taken whole if its calls still fit the mode's budget. The counter is shared:
    it moves on by one with every mode that has a through station.
    """
    stage = stage or Staging(stations.sparkSession)
    lines = stage(topology.station_lines(filters.subscribed_only(stations, subscribed), modes), "board_lines")
    candidates = stage(topology.board_candidates(lines, departing), "board_candidates")
    # One small row per mode.
    through = {
        r["mode"] for r in candidates.where(~F.col("is_terminus")).select("mode").distinct().collect()
    }
    starts, counter = {}, rotation
    for mode in modes:
        starts[mode], counter = counter, counter + (mode in through)
    start = F.lit(rotation)
    for mode, value in starts.items():
        start = F.when(F.col("mode") == mode, F.lit(value)).otherwise(start)
    picked = stage(
        topology.planned_stations(candidates.withColumn("rotation", start), F.col("rotation"), settings.board_budget),
        "picked",
    )
    chosen = lines.join(picked.select("mode", "naptan_id", "pick_no"), ["mode", "naptan_id"])
    planned = chosen.withColumn("cycle", F.lit(cycle).cast("bigint")).select(*schemas.PLANNED.names)
    source = filters.board_source_station(F.col("mode"), F.col("naptan_id"), aliases)
    calls = chosen.select(
        "mode", F.lit(cycle).cast("bigint").alias("cycle"), "pick_no", "naptan_id", source.alias("source_id"), "line_id"
    )
    counts = candidates.groupBy("mode").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("is_terminus").alias("termini")
    )
    taken = chosen.groupBy("mode").agg(F.count_distinct("naptan_id").alias("stations"), F.count(F.lit(1)).alias("calls"))
    zero = F.lit(0).cast("bigint")
    summary = counts.join(taken, "mode", "left").select(
        "mode", "candidates", "termini", F.coalesce("stations", zero).alias("stations"), F.coalesce("calls", zero).alias("calls"),
        (F.col("candidates") - F.coalesce("stations", zero)).alias("skipped"),
    )
    return BoardPlan(planned, calls, summary, counter)


class BoardPlanner:
    """The plan of each cycle and the rotation counter, as stored state."""

    COUNTER = "board_rotation"

    def __init__(self, spark, root: str, settings: Settings = DEFAULTS):
        self.settings = settings
        self.counter = VersionedTable(spark, f"{root}/state/rotation", schemas.SYNC_METADATA)
        self.plans = VersionedTable(spark, f"{root}/state/planned", schemas.PLANNED)
        self.calls = VersionedTable(spark, f"{root}/state/board_calls", schemas.BOARD_CALL)
        self.summaries = VersionedTable(spark, f"{root}/state/board_summary", schemas.BOARD_SUMMARY)

    def rotation(self, cycle: int | None = None) -> int:
        """The counter that ``cycle`` starts from; a cycle that is planned again starts where it did."""
        found = self.counter.read(cycle).where(F.col("key") == self.COUNTER).select("value").head()
        return int(found[0]) if found else 0

    def plan(self, cycle: int, stations: DataFrame, departing: DataFrame, subscribed: DataFrame | None, **given) -> BoardPlan:
        """Plan a cycle and store its table and the counter. The last cycle may be planned again."""
        spark = stations.sparkSession
        with Staging(spark, f"{self.plans.path}/work") as stage:
            made = plan_boards(
                stations, departing, subscribed, cycle=cycle, rotation=self.rotation(cycle), stage=stage,
                settings=self.settings, **given,
            )
            self.plans.write(made.planned, cycle)
            self.calls.write(made.calls, cycle)
            self.summaries.write(made.summary, cycle)
            self.counter.write(spark.createDataFrame([(self.COUNTER, str(made.rotation))], schemas.SYNC_METADATA), cycle)
        for table in (self.plans, self.calls, self.summaries, self.counter):
            table.expire()
        return BoardPlan(self.plans.read(), self.calls.read(), self.summaries.read(), made.rotation)

    def planned(self) -> DataFrame:
        """The plan of the newest cycle, for ``run_cycles``."""
        return self.plans.read()
