"""Top-k, latest per key, batch numbers, rotation and budgeted picks.

None of them needs all rows of one key in one task. A row number with a fixed
limit is cut to the limit before the shuffle, so a hot key sends at most k rows
per input partition. Batch numbers are counted in digest buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BUCKET_DIGITS = 3  # 16**3 buckets over the digest, whose values are uniform


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str | None = None) -> DataFrame:
    """First ``k`` rows per key in ``order``; ``out`` keeps the 1-based place."""
    place = out or "_place"
    ranked = df.withColumn(place, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(place) <= k)
    return kept if out else kept.drop(place)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The newest row per key: a later payload replaces a pending one."""
    return first_k(df, keys, [o.desc_nulls_last() for o in order], 1)


def numbered(df: DataFrame, key: str, within: Sequence[str] = (), out: str = "seq") -> DataFrame:
    """Dense 0-based numbers over unique keys, in the order of the keys' digests.

    ``within`` columns, if any, are not null.

    A plain global row number would put all rows in one task. Here rows are
    numbered in buckets of their digest and each bucket starts where the ones
    before it end; only the bucket counts, a fixed number, are summed up.
    """
    within = list(within)
    hashed = df.withColumn("_digest", F.md5(F.col(key).cast("string"))).withColumn(
        "_bucket", F.substring("_digest", 1, _BUCKET_DIGITS)
    )
    counts = hashed.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*within).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(W.partitionBy(*within, "_bucket").orderBy("_digest", key)) - 1
    return (
        hashed.join(starts, [*within, "_bucket"])
        .withColumn(out, (F.col("_start") + local).cast("bigint"))
        .select(*df.columns, out)
    )


def batched(df: DataFrame, key: str, cap: int, within: Sequence[str] = (), out: str = "batch_no") -> DataFrame:
    """Split unique keys into batches of ``cap``; only the last one is smaller."""
    return numbered(df, key, within, "_seq").withColumn(out, F.floor(F.col("_seq") / cap).cast("bigint")).drop("_seq")


def rotated(df: DataFrame, key: str, within: Sequence[str], rotation: int | Column, out: str = "place") -> DataFrame:
    """Place of each row on a ring per group that starts at ``rotation mod n``; the rotation may be a column of ``df``."""
    sizes = df.groupBy(*within).agg(F.count(F.lit(1)).alias("_n"))
    ring = numbered(df, key, within, "_seq").join(sizes, list(within))
    return ring.withColumn(out, F.pmod(F.col("_seq") - F.lit(rotation), F.col("_n")).cast("bigint")).drop("_seq", "_n")


def budgeted_pick(
    df: DataFrame, within: Sequence[str], key: str, cost: str, order: Sequence[str], budget: int
) -> DataFrame:
    """Go through each group in ``order`` and take a row iff its cost still fits.

    Rows that do not fit are passed over and later, cheaper ones may be taken.
    ``order`` holds orderable columns. ``cost`` is a positive integer; any other
    value fails, as such a row would be taken for nothing or passed over unseen.

    Among rows of equal cost c the taken ones are the first ones, and at most
    budget // c of them, so no other row can matter. That leaves fewer than
    budget * (1 + ln budget) rows per group for the walk, whatever its size.
    """
    within = list(within)
    checked = F.when(F.col(cost) >= 1, F.col(cost)).otherwise(
        F.raise_error(F.concat(F.lit("a cost must be 1 or more, not "), F.coalesce(F.col(cost).cast("string"), F.lit("null"))))
    )
    # The check takes the column's place, so that no filter on it comes before.
    fits = df.withColumn(cost, checked.cast(df.schema[cost].dataType)).where(F.col(cost) <= budget)
    sort = [F.col(c) for c in [*order, key]]
    able = first_k(fits, [*within, cost], sort, budget, "_nth").where(
        F.col("_nth") <= F.floor(F.lit(budget) / F.col(cost))
    )
    entry = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("key"), F.col(cost).cast("bigint").alias("cost"))
    key_type = df.schema[key].dataType.simpleString()
    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.array().cast(f"array<{key_type}>").alias("taken"))

    def walk(state: Column, e: Column) -> Column:
        return F.when(
            e["cost"] <= state["left"],
            F.struct((state["left"] - e["cost"]).alias("left"), F.array_append(state["taken"], e["key"]).alias("taken")),
        ).otherwise(state)

    walked = able.groupBy(*within).agg(
        F.aggregate(F.array_sort(F.collect_list(entry)), start, walk)["taken"].alias("_taken")
    )
    return walked.select(*within, F.posexplode("_taken").alias("pick_no", key))
