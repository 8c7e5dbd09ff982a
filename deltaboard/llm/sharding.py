"""Shards of near-equal bytes: groups that stay together, longest first, to the least-loaded shard."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from deltaboard.session import Staging

UNITS_PER_SHARD = 1000
SLOTS_PER_RUN = 100_000


def longest_first(units: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """``unit -> shard``: by falling size, each to the shard with the least load so far.

    Equal sizes go by unit, equal loads to the lower shard.
    """
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for unit, size in sorted(units, key=lambda u: (-u[1], u[0])):
        load, shard = heap[0]
        placed[unit] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return placed


def balanced_shards(
    docs: DataFrame, stage: Staging, shards: int = 24, units_per_shard: int = UNITS_PER_SHARD, overhead: int = 8
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of ``docs(doc_id, text)``; equal texts share a shard.

    A group is all rows of one text. The scheduler sees at most
    ``2 * shards * units_per_shard`` units whatever the input: a group over the
    mean unit size is a unit of its own (there cannot be more of those than units),
    and smaller groups are merged by the hash of their text into as many units. So
    the heap and what is broadcast are bounded, and a shard is off the mean by
    about one small unit unless a single group is larger than a shard.

    A null text has size ``overhead`` and the group of the empty text's neighbour,
    its own; its crc is that of no bytes. Repeated rows are rows of one group. A
    null doc_id is numbered first. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = stage(
        docs.select(
            "doc_id",
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.xxhash64("text")).alias("group"),
        ),
        "sizes",
    )
    groups = stage(base.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    total, rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    most = shards * units_per_shard
    large = F.col("bytes") * most > total
    small = F.pmod(F.xxhash64("group"), F.lit(most))
    alone = groups.where(large).select("group", "bytes")
    merged = groups.where(~large).groupBy(small.alias("unit")).agg(F.sum("bytes").alias("bytes"))
    names = [(0, r["group"], r["bytes"]) for r in alone.collect()] + [(1, r["unit"], r["bytes"]) for r in merged.collect()]
    names.sort()
    placed = longest_first([(k, size) for k, (_, _, size) in enumerate(names)], shards)
    spark = docs.sparkSession

    def mapping(kind: int, key: str, value: str) -> DataFrame:
        rows_of = [(name, placed[k]) for k, (what, name, _) in enumerate(names) if what == kind]
        return F.broadcast(spark.createDataFrame(rows_of, f"{key} long, {value} int"))

    runs = max(16, -(-rows // (shards * SLOTS_PER_RUN)))
    put = (
        base.withColumn("unit", small)
        .join(mapping(0, "group", "own"), "group", "left")
        .join(mapping(1, "unit", "shared"), "unit", "left")
        .select(
            "doc_id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard"),
            F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs)).alias("run"),
        )
    )
    # Slots: each shard is numbered in runs; only the counts of the runs are summed up.
    counts = put.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = put.withColumn("at", at).join(starts, ["shard", "run"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).alias("slot"))
