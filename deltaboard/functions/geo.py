"""Geohash as a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def _cell(value: Column, span: int, bits: int) -> Column:
    """Index of the cell that holds ``value`` among 2**bits cells over [-span, span].

    The floor may be one off where the sum rounds; comparing with the cell's own
    edges, which are exact, puts it right.
    """
    cells = 1 << bits
    width = 2.0 * span / cells
    guess = F.floor((value + span) / width).cast("bigint")
    guess = F.when(value < guess * F.lit(width) - span, guess - 1).otherwise(guess)
    guess = F.when(value >= (guess + 1) * F.lit(width) - span, guess + 1).otherwise(guess)
    # greatest and least pass over nulls.
    return F.when(value.isNotNull(), F.least(F.greatest(guess, F.lit(0)), F.lit(cells - 1)))


def with_geohash(df: DataFrame, lat: str = "lat", lon: str = "lon", out: str = "geo_hash", precision: int = 9) -> DataFrame:
    """Add the base-32 geohash of two coordinate columns; null where one is null."""
    total = 5 * precision
    lon_bits, lat_bits = (total + 1) // 2, total // 2
    cells = df.withColumns(
        {"_lon_cell": _cell(F.col(lon), 180, lon_bits), "_lat_cell": _cell(F.col(lat), 90, lat_bits)}
    )
    letters = []
    for start in range(0, total, 5):
        digit = F.lit(0).cast("bigint")
        for place in range(5):
            at = start + place
            name, bits = ("_lon_cell", lon_bits) if at % 2 == 0 else ("_lat_cell", lat_bits)
            bit = F.shiftright(F.col(name), bits - 1 - at // 2).bitwiseAND(F.lit(1))
            digit = digit + bit * (1 << (4 - place))
        letters.append(F.substring(F.lit(BASE32), (digit + 1).cast("int"), F.lit(1)))
    return cells.withColumn(out, F.concat(*letters)).drop("_lon_cell", "_lat_cell")
