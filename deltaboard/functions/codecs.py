"""JSON columns of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaboard import schemas

KEEP_NULLS = {"ignoreNullFields": "false"}


def decode_list(text: Column, element: str = "string") -> Column:
    """JSON array text; bad or missing text is an empty list."""
    kind = f"array<{element}>"
    return F.coalesce(F.from_json(text, kind), F.array().cast(kind))


def decode_map(text: Column, kind: str) -> Column:
    """JSON object text; bad or missing text is an empty map."""
    return F.coalesce(F.from_json(text, kind), F.create_map().cast(kind))


def encode(value: Column) -> Column:
    return F.to_json(value, KEEP_NULLS)


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def modes_to_json(modes: Column) -> Column:
    lines = lambda m: F.map_from_entries(F.transform(m["lines"], lambda x: F.struct(x["id"], x)))
    return encode(
        F.map_from_entries(
            F.transform(
                modes, lambda m: F.struct(m["mode"], F.struct(m["mode"].alias("modeName"), lines(m).alias("lines")))
            )
        )
    )


def modes_from_json(text: Column) -> Column:
    """Stored map text to the canonical sorted arrays."""
    no_dirs = F.array().cast("array<string>")

    def lines(group: Column) -> Column:
        entries = F.map_entries(group["lines"])
        return F.array_sort(
            F.transform(
                entries,
                lambda e: F.struct(
                    e["key"].alias("id"),
                    e["value"]["name"].alias("name"),
                    F.array_sort(F.coalesce(e["value"]["directions"], no_dirs)).alias("directions"),
                ),
            )
        )

    return F.array_sort(
        F.transform(
            F.map_entries(decode_map(text, schemas.MODES_JSON)),
            lambda e: F.struct(e["key"].alias("mode"), lines(e["value"]).alias("lines")),
        )
    )


def stations_from_rows(rows: DataFrame) -> DataFrame:
    """Stored station rows with their nested columns decoded."""
    from deltaboard.functions.timing import to_epoch_ms

    return rows.withColumns(
        {
            "modes": modes_from_json(F.col("modes_json")),
            "search_keys": decode_list(F.col("search_keys_json")),
            "last_updated": to_epoch_ms(F.col("last_updated")),
        }
    ).select(*schemas.STATION.names)


def rows_from_stations(stations: DataFrame) -> DataFrame:
    return stations.withColumns(
        {
            "modes_json": modes_to_json(F.col("modes")),
            "search_keys_json": encode(F.col("search_keys")),
            "last_updated": F.col("last_updated").cast("string"),
        }
    ).select(*schemas.STATION_ROW.names)


def directions_from_rows(rows: DataFrame) -> DataFrame:
    """Stored route documents with their directions decoded."""
    return rows.withColumn("directions", F.from_json("directions_json", schemas.DIRECTIONS_JSON)).drop("directions_json")
