"""Route topology, board planning and the station dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaboard import schemas
from deltaboard.functions.geo import with_geohash
from deltaboard.functions.lookups import BOARD_MODES, BUS_STOP_TYPE, expected_stop_type
from deltaboard.functions.text import is_blank
from deltaboard.operators.filters import where_contains, where_except
from deltaboard.operators.ranking import budgeted_pick, rotated
from deltaboard.session import Staging
from deltaboard.settings import DEFAULTS, Settings

SCALARS = [
    "common_name", "lat", "lon", "stop_type", "indicator", "stop_letter", "ics_code", "towards",
    "compass_point", "station_naptan",
]


def direction_rows(directions: DataFrame) -> DataFrame:
    """Route documents (line_id, directions) to rows line, direction, destination.

    A direction name is lower-cased; if one document repeats it, the last list
    counts. A direction without destinations gives one row with a null id.
    """
    named = directions.select("line_id", F.posexplode("directions").alias("at", "d")).where(
        F.col("d.direction").isNotNull() & F.col("d.destinations").isNotNull()
    )
    last = (
        named.withColumn("direction", F.lower("d.direction"))
        .groupBy("line_id", "direction")
        .agg(F.max_by("d.destinations", "at").alias("destinations"))
    )
    return last.select("line_id", "direction", F.explode_outer("destinations").alias("dest")).select(
        "line_id", "direction", F.col("dest.id").alias("dest_id")
    )


def departing_directions(rows: DataFrame, stage: Staging | None = None) -> DataFrame:
    """Way out of each terminus: the one direction of its line that does not go there.

    Directions of a line are numbered from 1. A terminus that is missing from
    exactly one direction is missing the one whose number is the line's sum less
    its own sum. So sums and counts are enough and no set is collected.
    """
    pairs = rows.select(F.lower("line_id").alias("line_id"), F.lower("direction").alias("direction"), "dest_id")
    if stage is not None:
        pairs = stage(pairs.distinct(), "route_ends")
    per_line = W.partitionBy("line_id")
    numbers = (
        pairs.select("line_id", "direction")
        .distinct()
        .withColumn("_no", F.row_number().over(per_line.orderBy("direction")).cast("bigint"))
    )
    lines = numbers.groupBy("line_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("_no").alias("_sum"))
    served = (
        pairs.where(F.col("dest_id").isNotNull())
        .distinct()
        .join(numbers, ["line_id", "direction"])
        .groupBy("line_id", "dest_id")
        .agg(F.count(F.lit(1)).alias("_m"), F.sum("_no").alias("_part"))
    )
    away = served.join(lines, "line_id").where(F.col("_n") - F.col("_m") == 1)
    return away.withColumn("_no", F.col("_sum") - F.col("_part")).join(numbers, ["line_id", "_no"]).select(
        "line_id", F.col("dest_id").alias("naptan_id"), F.col("direction").alias("departing")
    )


# Board planning.


def station_lines(stations: DataFrame, modes: Sequence[str] = tuple(BOARD_MODES)) -> DataFrame:
    """Lines per station of the modes that have boards, ids in lower case."""
    groups = stations.select("naptan_id", "common_name", F.explode("modes").alias("g"))
    wanted = groups.withColumn("mode", F.lower("g.mode")).where(F.col("mode").isin(*modes))
    flat = wanted.select("mode", "naptan_id", "common_name", F.explode("g.lines").alias("line"))
    return (
        flat.where(~is_blank(F.col("line.id")))
        .groupBy("mode", "naptan_id", F.lower("line.id").alias("line_id"))
        .agg(F.min("common_name").alias("common_name"), F.min("line.name").alias("line_name"))
    )


def board_candidates(lines: DataFrame, departing: DataFrame) -> DataFrame:
    """One row per station: cost in board calls, and whether it is a terminus."""
    termini = departing.select("line_id", "naptan_id", F.lit(1).alias("_t"))
    return (
        lines.join(termini, ["line_id", "naptan_id"], "left")
        .groupBy("mode", "naptan_id")
        .agg(
            F.count(F.lit(1)).alias("cost"),
            F.coalesce(F.max("_t") == 1, F.lit(False)).alias("is_terminus"),
        )
    )


def rotated_candidates(candidates: DataFrame, rotation: int | Column) -> DataFrame:
    """Termini first, then the through stations on their ring; ``place`` orders both."""
    through = rotated(candidates.where(~F.col("is_terminus")), "naptan_id", ["mode"], rotation)
    termini = candidates.where("is_terminus").withColumn("place", F.lit(-1).cast("bigint"))
    return termini.unionByName(through)


def planned_stations(candidates: DataFrame, rotation: int | Column = 0, budget: int = DEFAULTS.board_budget) -> DataFrame:
    """Stations whose boards are read this cycle, under the mode's call budget.

    ``rotation`` is a counter that all modes share and that moves on with every
    plan that has a through station, so that the budget starves nobody.
    """
    placed = rotated_candidates(candidates, rotation)
    return budgeted_pick(placed, ["mode"], "naptan_id", "cost", ["place"], budget)


# Station dimension.


def route_stops(sequences: DataFrame) -> DataFrame:
    """Distinct stops per line and direction; missing routes give none."""
    return (
        sequences.select("line_id", "direction", F.explode("orderedLineRoutes").alias("r"))
        .select("line_id", "direction", F.explode("r.naptanIds").alias("naptan_id"))
        .distinct()
    )


def mode_stops(lines: DataFrame, stop_points: DataFrame) -> DataFrame:
    """Stops of the lines' mode whose stop type fits that mode."""
    return stop_points.join(lines.select("mode", "line_id"), "line_id").where(
        F.col("stop_type") == expected_stop_type(F.col("mode"))
    )


def existing_in_scope(stations: DataFrame, mode: str, line_id: str | None = None) -> DataFrame:
    """Known stations that a sync of this mode or line may have to merge with."""
    if line_id is not None:
        return where_contains(stations, "search_keys", line_id)
    if mode.lower() in ("bus", "tram"):
        return where_contains(stations, "search_keys", mode)
    return where_except(stations, "stop_type", BUS_STOP_TYPE)


def in_order(texts: Column) -> Column:
    """The texts of an array in order, nulls last, without ``array_sort``'s interpreted comparison of each pair."""
    marked = F.transform(texts, lambda t: F.struct(t.isNull().alias("none"), t.alias("text")))
    return F.sort_array(marked)["text"]


def search_keys(modes: Column) -> Column:
    """Sorted distinct mode, line, mode_line, line_direction and mode_line_direction."""

    def of_line(mode: Column, line: Column) -> Column:
        own = F.array(line["id"], F.concat_ws("_", mode, line["id"]))
        directed = F.flatten(
            F.transform(
                line["directions"],
                lambda d: F.array(F.concat_ws("_", line["id"], d), F.concat_ws("_", mode, line["id"], d)),
            )
        )
        return F.flatten(F.array(own, directed))

    def of_mode(m: Column) -> Column:
        lines = F.flatten(F.transform(m["lines"], lambda line: of_line(m["mode"], line)))
        return F.flatten(F.array(F.array(m["mode"]), lines))

    return in_order(F.array_distinct(F.flatten(F.transform(modes, of_mode))))


def _nested_modes(rows: DataFrame) -> DataFrame:
    """Rows (naptan, mode, line, name, directions) to the modes array per station."""
    by_mode = rows.groupBy("naptan_id", "mode").agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("line_id").alias("id"), F.col("line_name").alias("name"), "directions"))
        ).alias("lines")
    )
    return by_mode.groupBy("naptan_id").agg(F.sort_array(F.collect_list(F.struct("mode", "lines"))).alias("modes"))


def fresh_stations(
    stops: DataFrame,
    routes: DataFrame,
    existing: DataFrame,
    now_ms: Column,
    *,
    rebuild: bool = False,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Stations as the lines of this sync leave them.

    Modes, lines and directions only add up: what is known already stays, unless
    ``rebuild`` is set. Scalars come from the stop row of the line that sorts
    last. A new line is named by its id.
    """
    routed = stops.select("naptan_id", "mode", "line_id").join(
        routes.select("line_id", "naptan_id", "direction"), ["line_id", "naptan_id"], "left"
    )
    fresh = routed.select("naptan_id", "mode", "line_id", F.lit(None).cast("string").alias("line_name"), "direction")
    if not rebuild:
        touched = existing.join(stops.select("naptan_id").distinct(), "naptan_id", "left_semi")
        known = (
            touched.select("naptan_id", F.explode("modes").alias("m"))
            .select("naptan_id", F.col("m.mode").alias("mode"), F.explode("m.lines").alias("line"))
            .select(
                "naptan_id", "mode", F.col("line.id").alias("line_id"), F.col("line.name").alias("line_name"),
                F.explode_outer("line.directions").alias("direction"),
            )
        )
        fresh = fresh.unionByName(known)
    # By station at once: the groups of its lines, its modes and itself then need no further exchange.
    merged = fresh.repartition("naptan_id").groupBy("naptan_id", "mode", "line_id").agg(
        F.coalesce(F.max("line_name"), F.col("line_id")).alias("line_name"),
        F.sort_array(F.collect_set("direction")).alias("directions"),
    )
    scalars = stops.groupBy("naptan_id").agg(F.max_by(F.struct(*SCALARS), F.col("line_id")).alias("_s"))
    shaped = _nested_modes(merged).join(scalars, "naptan_id").select("naptan_id", "_s.*", "modes")
    return with_geohash(shaped, precision=settings.geohash_precision).withColumns(
        {"last_updated": now_ms.cast("bigint"), "search_keys": search_keys(F.col("modes"))}
    ).select(*schemas.STATION.names)


def content_digest() -> Column:
    """Digest of what counts as a change of a station: scalars, search keys and modes in canonical order."""
    parts = [in_order(F.col("search_keys")).alias("search_keys"), F.array_sort("modes").alias("modes")]
    return F.sha2(F.to_json(F.struct(*SCALARS, *parts), {"ignoreNullFields": "false"}), 256)


def changed_stations(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """Fresh stations that are new or differ; geohash and time stamp do not count.

    ``change`` is 'new' or 'changed'. List order of the nested parts is not a
    difference. The sides meet as digests; a stored table may bring its own as
    ``content_digest``, so that its nested columns are not read.
    """
    known = F.col("content_digest") if "content_digest" in existing.columns else content_digest()
    old = existing.select("naptan_id", known.alias("_old"))
    paired = fresh.withColumn("_new", content_digest()).join(old, "naptan_id", "left")
    return (
        paired.withColumn("change", F.when(F.col("_old").isNull(), "new").otherwise("changed"))
        .where(F.col("_old").isNull() | (F.col("_old") != F.col("_new")))
        .drop("_old", "_new")
    )
