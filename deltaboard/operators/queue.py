"""The pending queue: the newest payload per topic, drained a capped number at a time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["channel", "topic"]


def enqueue(queue: DataFrame, incoming: DataFrame, tick: int) -> DataFrame:
    """``queue`` (channel, topic, payload, since) with one newer payload per topic of ``incoming``.

    A topic that is pending takes the newer payload and keeps its place in the
    queue; a new one joins at ``tick``.
    """
    newer = incoming.select(*KEY, "payload", F.lit(None).cast("bigint").alias("since"))
    old = queue.select(*KEY, F.lit(None).cast("string").alias("payload"), "since", F.col("payload").alias("_was"))
    both = old.unionByName(newer.withColumn("_was", F.lit(None).cast("string")))
    # A payload is never null, so null says that this side has none.
    merged = both.groupBy(*KEY).agg(F.max("payload").alias("_new"), F.max("_was").alias("_was"), F.min("since").alias("since"))
    return merged.select(
        *KEY, F.coalesce("_new", "_was").alias("payload"), F.coalesce("since", F.lit(tick)).cast("bigint").alias("since")
    )


def cap_of(channel: Column, caps: Mapping[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, cap in caps.items():
        out = F.when(channel == name, F.lit(cap)).otherwise(out)
    return out


def drain(queue: DataFrame, caps: Mapping[str, int], ticks: int = 1) -> tuple[DataFrame, DataFrame]:
    """What leaves in ``ticks`` ticks, with its ``batch_no``, and what stays.

    Topics that joined first leave first; topics of one tick go by the digest of
    their name. ``caps`` has the messages per tick of each channel; channels that
    it does not name are not drained.
    """
    order = [F.col("since"), F.md5("topic"), F.col("topic")]
    placed = queue.withColumn("_place", F.row_number().over(W.partitionBy("channel").orderBy(*order)))
    most = max(caps.values(), default=0) * ticks
    # The plain limit cuts each partition before the shuffle; the channel's own cap is applied after it.
    first = placed.where(F.col("_place") <= most)
    cap = cap_of(F.col("channel"), caps)
    sent = first.where(F.col("_place") <= cap * ticks).withColumn("batch_no", F.floor((F.col("_place") - 1) / cap).cast("bigint"))
    sent = sent.drop("_place")
    return sent, queue.join(sent.select(*KEY), KEY, "left_anti")
