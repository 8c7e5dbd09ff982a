"""Station dimension sync: fresh state, diff, chunked upsert rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from deltaboard.operators import topology
from deltaboard.operators.ranking import batched
from deltaboard.session import Staging
from deltaboard.settings import DEFAULTS, Settings


def sync_stations(
    lines: DataFrame,
    stop_points: DataFrame,
    sequences: DataFrame,
    stations: DataFrame,
    *,
    mode: str,
    now_ms: Column,
    line_id: str | None = None,
    rebuild: bool = False,
    stage: Staging | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """New or changed stations of one mode (or one of its lines), with ``chunk_no``.

    The stops, routes and known stations of the sync are staged, as the fold and
    the diff read them several times, and so is the diff, which is numbered.
    """
    stage = stage or Staging(stations.sparkSession)
    wanted = lines.where(lines["mode"] == mode)
    if line_id is not None:
        wanted = wanted.where(wanted["line_id"] == line_id)
    existing = stage(topology.existing_in_scope(stations, mode, line_id), "known_stations")
    fresh = topology.fresh_stations(
        stage(topology.mode_stops(wanted, stop_points), "mode_stops"),
        stage(topology.route_stops(sequences.join(wanted.select("line_id").distinct(), "line_id", "left_semi")), "route_stops"),
        existing,
        now_ms,
        rebuild=rebuild,
        settings=settings,
    )
    changed = stage(topology.changed_stations(fresh, existing), "changed_stations")
    return batched(changed, "naptan_id", settings.upsert_chunk, out="chunk_no")
