"""Station documents: nesting, payload JSON, byte budget, content digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaboard import schemas
from deltaboard.functions.text import station_topic
from deltaboard.functions.timing import iso_local
from deltaboard.operators.countdown import KEYS

KEEP_NULLS = {"ignoreNullFields": "false"}


def feed_summary(arrivals: DataFrame) -> DataFrame:
    """Per station and line: number of arrivals and the names on the first one.

    One pass over the feed for everything that needs all rows, filtered ones
    included. The result is small, and names and poll counts come out of it.
    """
    return arrivals.groupBy(*KEYS, "line_id").agg(
        F.min(F.struct("feed_seq", "line_name", "station_name")).alias("first"), F.count(F.lit(1)).alias("n")
    )


def line_spine(summary: DataFrame) -> DataFrame:
    """Lines that a station's arrivals mention, with the name on the first one."""
    return summary.where(F.col("naptan_id").isNotNull() & F.col("line_id").isNotNull()).select(
        *KEYS, "line_id", "first.line_name"
    )


def station_spine(summary: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """Stations to publish, with names. Either feed may be missing a station.

    ``has_arrivals`` is false for a station that only has a board; it is named
    by its metadata, else by its id.
    """
    seen = (
        summary.where(F.col("naptan_id").isNotNull())
        .groupBy(*KEYS)
        .agg(F.min("first").alias("_first"))
        .select(*KEYS, F.col("_first.station_name").alias("_first_name"), F.lit(True).alias("_seen"))
    )
    if planned is None:
        return seen.select(*KEYS, F.col("_first_name").alias("name"), F.lit(True).alias("has_arrivals"))
    known = planned.groupBy(*KEYS).agg(F.min("common_name").alias("_common"))
    has = F.coalesce("_seen", F.lit(False))
    return seen.join(known, KEYS, "full_outer").select(
        *KEYS,
        F.when(has, F.col("_first_name")).otherwise(F.coalesce("_common", "naptan_id")).alias("name"),
        has.alias("has_arrivals"),
    )


def item_struct() -> Column:
    return F.struct(
        F.col("dest_id").alias("destId"),
        F.col("platform").alias("platform"),
        F.col("eta_text").alias("eta"),
        F.col("display").alias("displayName"),
    )


def nest_lines(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Items and named lines to one array of lines per station.

    Every level is bounded: at most k items per direction after the top-k.
    """
    directions = items.groupBy(*KEYS, "line_id", "direction").agg(
        F.array_sort(F.collect_list(F.struct("pos", item_struct().alias("item")))).alias("_items")
    )
    by_line = directions.groupBy(*KEYS, "line_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("direction", F.transform("_items", lambda i: i["item"]).alias("preds"))
            )
        ).alias("dirs")
    )
    full = lines.join(by_line, [*KEYS, "line_id"], "left")
    no_dirs = F.array().cast(f"array<{schemas.DIRECTION}>")
    entry = F.struct("line_id", "line_name", F.coalesce("dirs", no_dirs).alias("dirs"))
    return full.groupBy(*KEYS).agg(F.array_sort(F.collect_list(entry)).alias("lines"))


def station_docs(items: DataFrame, lines: DataFrame, stations: DataFrame, now: Column) -> DataFrame:
    """One document per station. A board-only station without lines has none."""
    no_lines = F.array().cast(f"array<{schemas.LINE}>")
    docs = stations.join(nest_lines(items, lines), KEYS, "left")
    published = docs.where(F.col("has_arrivals") | F.col("lines").isNotNull())
    return published.select(
        "mode",
        "cycle",
        station_topic(F.col("naptan_id")).alias("station_key"),
        F.col("naptan_id").alias("id"),
        "name",
        iso_local(now).alias("lut"),
        F.coalesce("lines", no_lines).alias("lines"),
    )


def payload_json(id_: Column, name: Column, lut: Column, lines: Column) -> Column:
    """Wire form of a station document, with nulls written out."""
    dirs = lambda line: F.map_from_entries(
        F.transform(line["dirs"], lambda d: F.struct(d["direction"], F.struct(d["preds"].alias("preds"))))
    )
    by_line = F.map_from_entries(
        F.transform(
            lines,
            lambda line: F.struct(
                line["line_id"],
                F.struct(line["line_id"].alias("id"), line["line_name"].alias("name"), dirs(line).alias("dirs")),
            ),
        )
    )
    doc = F.struct(id_.alias("id"), name.alias("name"), lut.alias("lut"), by_line.alias("lines"))
    return F.to_json(doc, KEEP_NULLS)


def with_payload(docs: DataFrame, out: str = "payload") -> DataFrame:
    return docs.withColumn(out, payload_json(F.col("id"), F.col("name"), F.col("lut"), F.col("lines")))


def with_digest(docs: DataFrame, out: str = "digest") -> DataFrame:
    """Digest of the lines only: name and time stamp do not count as a change."""
    return docs.withColumn(out, F.sha2(F.to_json("lines"), 256))


def _place(line: Column, d: Column, item: Column, i: Column) -> Column:
    """Removal order of an item: latest first means largest place first.

    Without its final Z the text of an instant sorts by time, fraction or not.
    """
    return F.struct(
        item["eta"].isNull().alias("last"),
        F.replace(item["eta"], F.lit("Z"), F.lit("")).alias("eta"),
        line["line_id"].alias("line"),
        d["direction"].alias("direction"),
        i.alias("i"),
    )


def prune_to_budget(docs: DataFrame, limit: int) -> DataFrame:
    """Cut the latest predictions until the payload fits ``limit`` bytes.

    Taking off the latest item again and again leaves the items that come first
    by time and whose sizes, added to the size of the empty document, still fit.
    A direction may end up empty but stays. Documents that fit are not touched.
    """
    over = F.octet_length(payload_json(F.col("id"), F.col("name"), F.col("lut"), F.col("lines"))) > limit

    def emptied(line: Column) -> Column:
        return line.withField(
            "dirs", F.transform(line["dirs"], lambda d: d.withField("preds", F.slice(d["preds"], 1, 0)))
        )

    skeleton = F.transform("lines", emptied)
    fixed = F.octet_length(payload_json(F.col("id"), F.col("name"), F.col("lut"), skeleton))

    def costed(line: Column) -> Column:
        return F.flatten(
            F.transform(
                line["dirs"],
                lambda d: F.transform(
                    d["preds"],
                    lambda p, i: F.struct(
                        _place(line, d, p, i).alias("place"),
                        (F.octet_length(F.to_json(p, KEEP_NULLS)) + F.when(i > 0, 1).otherwise(0)).alias("bytes"),
                    ),
                ),
            )
        )

    in_order = F.array_sort(F.flatten(F.transform("lines", costed)))
    empty_place = "struct<last:boolean,eta:string,line:string,direction:string,i:int>"
    start = F.struct(
        fixed.cast("bigint").alias("size"), F.lit(True).alias("open"), F.lit(None).cast(empty_place).alias("place")
    )

    def take(state: Column, e: Column) -> Column:
        fits = state["open"] & (state["size"] + e["bytes"] <= limit)
        return F.struct(
            F.when(fits, state["size"] + e["bytes"]).otherwise(state["size"]).alias("size"),
            fits.alias("open"),
            F.when(fits, e["place"]).otherwise(state["place"]).alias("place"),
        )

    def kept(line: Column, until: Column) -> Column:
        return line.withField(
            "dirs",
            F.transform(
                line["dirs"],
                lambda d: d.withField(
                    "preds",
                    F.filter(d["preds"], lambda p, i: F.coalesce(_place(line, d, p, i) <= until, F.lit(False))),
                ),
            ),
        )

    # The last place that fits is bound to a lambda variable; as a column it
    # would be folded into the inner lambda and worked out again per item.
    last_fit = F.array(F.aggregate(in_order, start, take)["place"])
    cut = F.transform(last_fit, lambda until: F.transform("lines", lambda line: kept(line, until)))
    return docs.withColumn("lines", F.when(over, F.element_at(cut, 1)).otherwise(F.col("lines")))


def document_rows(docs: DataFrame) -> DataFrame:
    """Flat rows of documents, one per prediction; empty levels give no row.

    The outer explode spares a filter that would work out the lines again; the
    next explode drops its empty rows.
    """
    return (
        docs.select("mode", "cycle", "station_key", "id", "name", "lut", F.explode_outer("lines").alias("line"))
        .select("*", F.explode("line.dirs").alias("dir"))
        .select("*", F.posexplode("dir.preds").alias("i", "item"))
        .select(
            "mode",
            "cycle",
            "station_key",
            "id",
            "name",
            "lut",
            F.col("line.line_id").alias("line_id"),
            F.col("line.line_name").alias("line_name"),
            F.col("dir.direction").alias("direction"),
            (F.col("i") + 1).alias("pos"),
            "item.destId",
            "item.platform",
            "item.eta",
            "item.displayName",
        )
    )
