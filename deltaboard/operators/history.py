"""Walking the history of a key in blocks.

Replaying state over a key's history looks at the row before or after. A window
over the whole key would hold one key's full history in one task. Here history
is cut into blocks of a fixed number of ticks (cycles or syncs); a key has at
most one row per tick, so a (key, block) group is bounded. One small row per
block carries what the neighbouring blocks need.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "_block"


def with_block(df: DataFrame, keys: Sequence[str], tick: str, size: int) -> DataFrame:
    """Add the block of each row; rows without a key or tick have no history.

    A join on key and block implies the same filter, but on its own side only,
    and then both sides would shuffle the rows again.
    """
    blocked = df.withColumn(BLOCK, F.floor(F.col(tick) / size).cast("bigint"))
    return blocked.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, BLOCK]))


def laid_out(df: DataFrame, keys: Sequence[str], tick: str, size: int) -> DataFrame:
    """Place rows by key and block of ``tick``; later steps reuse this one shuffle."""
    return with_block(df, keys, tick, size).repartition(*keys, BLOCK)


def nearest(
    df: DataFrame,
    keys: Sequence[str],
    tick: str,
    before: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add, per name, the closest non-null value on the rows before or after.

    ``df`` comes from :func:`laid_out`, with unique, non-null (keys, tick). One
    aggregate sums up the blocks for all names, and one join brings it back.
    """
    keys = list(keys)
    before, after = dict(before or {}), dict(after or {})
    names = [*before, *after]
    raw = df.withColumns({f"_v_{name}": value for name, value in [*before.items(), *after.items()]})

    def edge(name: str) -> Column:
        pick = F.max_by if name in before else F.min_by
        value = F.col(f"_v_{name}")
        return pick(value, F.when(value.isNotNull(), F.col(tick))).alias(f"_e_{name}")

    def seen(name: str, value: str, partition: list[str], col: str) -> Column:
        side = "lag" if name in before else "lead"
        by = ", ".join(f"`{c}`" for c in partition)
        return F.expr(f"{side}(`{value}`) IGNORE NULLS OVER (PARTITION BY {by} ORDER BY `{col}`)")

    edges = raw.groupBy(*keys, BLOCK).agg(*[edge(name) for name in names])
    carried = edges.select(
        *keys, BLOCK, *[seen(name, f"_e_{name}", keys, BLOCK).alias(f"_c_{name}") for name in names]
    )
    local = raw.withColumns({f"_l_{name}": seen(name, f"_v_{name}", [*keys, BLOCK], tick) for name in names})
    return (
        local.join(carried, [*keys, BLOCK], "left")
        .withColumns({name: F.coalesce(f"_l_{name}", f"_c_{name}") for name in names})
        .select(*df.columns, *names)
    )
