"""Outbox rows for the push and stream channels, written per micro-batch, and the queue before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaboard import schemas
from deltaboard.operators import queue
from deltaboard.operators.ranking import latest_per_key, numbered
from deltaboard.session import Staging
from deltaboard.settings import DEFAULTS, Settings
from deltaboard.sources.tables import VersionedTable

PUSH, STREAM, STREAM_LINES = "push", "stream", "stream_lines"
COLUMNS = schemas.OUTBOX.names


def _caps(settings: Settings) -> dict[str, int]:
    return {PUSH: settings.push_batch, STREAM: settings.station_batch, STREAM_LINES: settings.line_batch}


def _addressed(rows: DataFrame, settings: Settings) -> DataFrame:
    is_push = F.col("channel") == PUSH
    return rows.select(
        "channel",
        "topic",
        "payload",
        F.when(is_push, "HIGH").alias("priority"),
        F.when(is_push, F.lit(settings.push_ttl_ms)).cast("bigint").alias("ttl_ms"),
        "batch_no",
    )


def pending(messages: DataFrame, order: Sequence[Column], settings: Settings = DEFAULTS) -> DataFrame:
    """Newest payload per channel and topic, cut into capped batches.

    ``messages``: channel, topic, payload. Each channel has its own batch size;
    station and line messages of the stream go in separate channels.
    """
    newest = latest_per_key(messages, ["channel", "topic"], order)
    counted = numbered(newest, "topic", ["channel"], "_seq")
    cap = F.coalesce(queue.cap_of(F.col("channel"), _caps(settings)), F.lit(settings.push_batch))
    return _addressed(counted.withColumn("batch_no", F.floor(F.col("_seq") / cap).cast("bigint")), settings)


class Queue:
    """The stored queue of a stream's messages: a newer payload replaces one that has not left yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path, schemas.QUEUE)

    def tick(
        self, messages: DataFrame | None, order: Sequence[Column], path: str, batch_id: int, stage: Staging,
        settings: Settings = DEFAULTS, ticks: int | None = None,
    ) -> None:
        """Take in the messages of a micro-batch and write what leaves to the outbox at ``path``.

        As many ticks go by as fit into a micro-batch (``settings.ticks_per_batch``).
        A replay of the batch starts from the queue as it was before.
        """
        waiting = self.table.read(batch_id)
        if messages is not None:
            waiting = queue.enqueue(waiting, latest_per_key(messages, queue.KEY, order), batch_id)
        waiting = stage(waiting, "queue")
        sent, left = queue.drain(waiting, _caps(settings), settings.ticks_per_batch if ticks is None else ticks)
        write_outbox(_addressed(sent, settings), path, batch_id)
        self.table.write(left, batch_id)
        self.table.expire()


def write_rows(rows: DataFrame, path: str, batch_id: int) -> None:
    """Rows of one micro-batch in a folder of their own; a replay of the batch replaces it."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id:012d}")


def write_outbox(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch; a replay of the batch replaces its folder."""
    rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).select(*COLUMNS).write.mode("overwrite").partitionBy(
        "channel"
    ).parquet(f"{path.rstrip('/')}/batch={batch_id:012d}")


def read_outbox(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{schemas.OUTBOX}, batch bigint").parquet(path).select(*COLUMNS)
