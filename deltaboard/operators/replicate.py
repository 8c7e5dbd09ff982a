"""Replication by high-water mark and change feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaboard.functions.timing import numeric_prefix, to_epoch_ms
from deltaboard.operators.ranking import latest_per_key

ADDED, MODIFIED, REMOVED = "ADDED", "MODIFIED", "REMOVED"


def delta_since(df: DataFrame, stamp: str, checkpoint: object) -> DataFrame:
    """Rows strictly newer than the checkpoint; a plain comparison reaches the scan."""
    if checkpoint is None:
        return df
    return df.where(F.col(stamp) > F.lit(checkpoint))


def max_watermark(df: DataFrame, stamp: str, out: str = "watermark") -> DataFrame:
    """Largest stamp of a table, 0 for an empty one."""
    return df.agg(F.coalesce(F.max(stamp), F.lit(0)).cast("bigint").alias(out))


def newest_ms(delta: DataFrame, stamp: str, checkpoint: str | None) -> DataFrame:
    """Newest stamp of a delta in epoch ms, never before the checkpoint."""
    base = to_epoch_ms(F.lit(checkpoint).cast("string"))
    top = delta.agg(F.max(to_epoch_ms(F.col(stamp))).alias("_top"))
    return top.select(F.greatest(F.coalesce("_top", F.lit(0)), base).alias("newest_ms"))


def advance(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Checkpoints after an update; a value only replaces a numerically smaller one.

    Both sides hold (key, value) texts. Values compare by their leading integer,
    so epoch milliseconds replace an ISO stamp of an older format.
    """
    both = current.select("key", "value", F.lit(0).alias("_new")).unionByName(
        incoming.select("key", "value", F.lit(1).alias("_new"))
    )
    # On equal numbers the stored value stays.
    rank = F.struct(numeric_prefix(F.col("value")), -F.col("_new"), F.col("value"))
    return both.groupBy("key").agg(F.max(rank).alias("_r")).select("key", F.col("_r.value").alias("value"))


def merge_changes(
    table: DataFrame, changes: DataFrame, key: str, order: Sequence[Column], op: str = "op"
) -> DataFrame:
    """Table after a batch of changes: the last one per key is an upsert or a delete.

    ``changes`` has the table's columns, ``op`` and whatever ``order`` uses.
    """
    last = latest_per_key(changes.where(F.col(key).isNotNull()), [key], order)
    kept = table.join(last.select(key), key, "left_anti")
    upserts = last.where(F.coalesce(F.upper(op), F.lit(MODIFIED)) != REMOVED).select(*table.columns)
    return kept.unionByName(upserts)


def upsert(table: DataFrame, rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Insert or replace by key; the last writer of the batch wins."""
    return merge_changes(table, rows.withColumn("_op", F.lit(MODIFIED)), key, order, "_op")


def delete_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def replacement_set(ids: DataFrame, key: str) -> DataFrame:
    """Ids of a set that is replaced as a whole: not null, not empty, distinct."""
    return ids.where(F.col(key).isNotNull() & (F.col(key) != "")).select(key).distinct()
