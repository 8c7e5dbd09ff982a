"""Incremental replication of reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaboard.functions.timing import to_epoch_ms
from deltaboard.operators import replicate
from deltaboard.operators.filters import active_stations
from deltaboard.session import Staging
from deltaboard.sources.tables import Checkpoints, KeyedTable, VersionedTable


def delta_sync(
    source: DataFrame, target: VersionedTable | KeyedTable, checkpoints: Checkpoints, collection: str, key: str, stamp: str
) -> str | None:
    """Boot catch-up: read what is newer than the checkpoint, upsert, advance.

    ``stamp`` is the source's epoch-ms column. The checkpoint moves last, so a
    failure in between only means that the same delta is applied again.
    """
    last = checkpoints.get(collection)
    since = None
    if last:
        since = source.sparkSession.range(1).select(to_epoch_ms(F.lit(last))).head()[0]
    with Staging(source.sparkSession) as stage:
        delta = stage(replicate.delta_since(source, stamp, since), collection)
        usable = delta.where(F.col(key).isNotNull())
        newest = replicate.newest_ms(usable, stamp, last).head()[0]
        if not delta.isEmpty():
            target.upsert(usable, key, [F.col(stamp)])
            if newest > 0:
                checkpoints.advance(collection, str(newest))
    return checkpoints.get(collection)


def apply_feed(
    changes: DataFrame,
    target: VersionedTable | KeyedTable,
    checkpoints: Checkpoints,
    collection: str,
    key: str,
    stamp: str,
    batch: int | None = None,
) -> None:
    """Change events (op, change_seq) into the table; then advance the checkpoint.

    An event without ``op`` is an upsert. The checkpoint never moves back.
    """
    last = checkpoints.get(collection, batch)
    with Staging(changes.sparkSession) as stage:
        staged = stage(changes, f"{collection}_feed")
        target.apply(staged, key, [F.col("change_seq")], "op", batch)
        op = F.coalesce(F.upper("op"), F.lit(replicate.MODIFIED))
        newest = replicate.newest_ms(staged.where(op != replicate.REMOVED), stamp, last).head()[0]
    checkpoints.advance(collection, str(newest) if newest > 0 else (last or "0"), batch)


def mirror_subscriptions(doc: DataFrame, mirror: VersionedTable, batch: int | None = None) -> None:
    """Keep the durable set in step with the subscription document.

    A missing document, or one without counts, leaves the mirror as it is.
    """
    usable = doc.where(F.col("stationCounts").isNotNull())
    if usable.isEmpty():
        if batch is not None:
            mirror.write(mirror.read(batch), batch)
        return
    mirror.replace_set(active_stations(usable), "naptan_id", batch)
