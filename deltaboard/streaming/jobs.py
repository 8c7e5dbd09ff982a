"""Streams over landed snapshots.

Each micro-batch runs the batch plan on its rows and the state version before
it. Output folders and state versions are named by batch id, so a batch that is
run again replaces its own results: every message is there exactly once.
A disappeared station has no row, so the whole state table is looked at, which
is why this is ``foreachBatch`` and not per-key state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from deltaboard import schemas
from deltaboard.plans import arrivals as arrivals_plan
from deltaboard.plans import replication
from deltaboard.plans import statuses as statuses_plan
from deltaboard.session import Staging
from deltaboard.settings import DEFAULTS, Settings
from deltaboard.sources.outbox import PUSH, STREAM, Queue, write_rows
from deltaboard.sources.tables import Checkpoints, KeyedTable, VersionedTable
from deltaboard.streaming.barrier import of_cycles, release


def _start(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def tables_of_cycles(tables: dict, cycles: DataFrame) -> dict:
    """``tables`` with boards and planned cut to the given cycles (mode, cycle)."""
    cut = {name: of_cycles(tables[name], cycles) for name in ("boards", "planned") if tables.get(name) is not None}
    return tables | cut


def tables_of_batch(tables: dict, batch: DataFrame) -> dict:
    """``tables`` cut to the cycles that ``batch`` has rows of."""
    return tables_of_cycles(tables, batch.select("mode", "cycle"))


def with_polls(arrivals: DataFrame, polls: DataFrame) -> DataFrame:
    """One stream of both feeds: arrival rows, and poll rows in the column ``_poll``."""
    fields = F.struct(*schemas.POLL.names).alias("_poll")
    kind = f"struct<{','.join(f'{name}:{kind}' for name, kind in schemas.POLL.types.items())}>"
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in schemas.ARRIVAL.types.items()]
    return arrivals.select(*schemas.ARRIVAL.names, F.lit(None).cast(kind).alias("_poll")).unionByName(
        polls.select(*schemas.POLL.names).select(*empty, fields)
    )


def _send(
    result: arrivals_plan.CycleResult | None, root: str, batch_id: int, stage: Staging, settings: Settings
) -> None:
    """Messages into the queue and out of it; without a result the queue drains on."""
    line = Queue(stage.spark, f"{root}/waiting/stations")
    both = None
    if result is not None:
        both = result.messages.withColumn("channel", F.explode(F.array(F.lit(PUSH), F.lit(STREAM))))
        write_rows(result.emissions, f"{root}/emitted/stations", batch_id)
        write_rows(result.late, f"{root}/refused/stations", batch_id)
    line.tick(both, [F.col("cycle")], f"{root}/outbox/stations", batch_id, stage, settings)


def station_updates(
    stream: DataFrame,
    root: str,
    *,
    polls: DataFrame | None = None,
    context: Callable[[SparkSession], dict] = lambda spark: {},
    every: str | None = None,
    settings: Settings = DEFAULTS,
) -> StreamingQuery:
    """Arrival snapshots to the outbox under ``root``.

    With ``polls``, the stream of the poll log, the rows of a cycle may come in
    any number of parts: a cycle is worked on once all its rows, and its board
    rows in ``context``, have landed, also if it has boards only. Refused rows
    are under ``refused``. Without it a cycle must land in one file (or one
    trigger). ``context`` is called per batch and returns the tables to use:
    boards, planned, departing, subscribed, patterns. Boards and planned may hold
    other cycles too; only those of the batch are used.
    """

    def state_table(spark: SparkSession) -> VersionedTable:
        return VersionedTable(spark, f"{root}/state/stations", schemas.STATION_STATE)

    def whole(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = state_table(spark)
        with Staging(spark) as stage:
            tables = tables_of_batch(context(spark), batch)
            result = arrivals_plan.run_cycles(
                batch, state=table.read(batch_id), stage=stage, settings=settings, **tables
            )
            table.write(result.state, batch_id)
            table.expire()
            _send(result, root, batch_id, stage, settings)

    def in_parts(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = state_table(spark)
        rows_table = VersionedTable(spark, f"{root}/waiting/arrivals", schemas.ARRIVAL)
        log_table = VersionedTable(spark, f"{root}/waiting/polls", schemas.POLL)
        fence_table = VersionedTable(spark, f"{root}/state/cycles", schemas.FENCE)
        with Staging(spark) as stage:
            came = stage(batch, "batch")
            rows = rows_table.read(batch_id).unionByName(came.where("_poll IS NULL").drop("_poll"))
            log = log_table.read(batch_id).unionByName(came.where("_poll IS NOT NULL").select("_poll.*"))
            tables = context(spark)
            settled = fence_table.read(batch_id)
            found = release(rows, log, settled, stage, patience=settings.cycle_patience, boards=tables.get("boards"))
            if found.cycles.isEmpty():
                _send(None, root, batch_id, stage, settings)
            else:
                result = arrivals_plan.run_cycles(
                    found.rows, state=state.read(batch_id), polled=found.cycles, settled=settled, stage=stage,
                    settings=settings, **tables_of_cycles(tables, found.cycles),
                )
                state.write(result.state, batch_id)
                _send(result, root, batch_id, stage, settings)
            write_rows(found.refused, f"{root}/refused/arrivals", batch_id)
            rows_table.write(found.waiting, batch_id)
            log_table.write(found.log, batch_id)
            fence_table.write(found.fence, batch_id)
            for table in (state, rows_table, log_table, fence_table):
                table.expire()

    progress = f"{root}/progress/stations"
    if polls is None:
        return _start(stream, whole, progress, every)
    return _start(with_polls(stream, polls), in_parts, progress, every)


def status_updates(
    stream: DataFrame, root: str, *, every: str | None = None, settings: Settings = DEFAULTS
) -> StreamingQuery:
    """Line status snapshots to the outbox under ``root``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = VersionedTable(spark, f"{root}/state/statuses", schemas.STATUS_STATE)
        state = table.read(batch_id)
        with Staging(spark) as stage:
            result = statuses_plan.run_syncs(
                batch,
                stage=stage,
                state=state,
                primed=not state.isEmpty(),
                settings=settings,
            )
            table.write(result.state, batch_id)
            Queue(spark, f"{root}/waiting/statuses").tick(
                result.messages, [F.col("sync_id"), F.col("feed_seq")], f"{root}/outbox/statuses", batch_id, stage, settings
            )
            table.expire()

    return _start(stream, handle, f"{root}/progress/statuses", every)


def replicate_changes(
    stream: DataFrame,
    root: str,
    collection: str,
    key: str,
    stamp: str,
    schema,
    *,
    every: str | None = None,
    partitions: int = 64,
) -> StreamingQuery:
    """A change feed (op, change_seq) into a keyed table with its checkpoint.

    A batch costs what its keys' partitions cost, not what the table does.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = KeyedTable(spark, f"{root}/tables/{collection}", schema, key, partitions)
        marks = Checkpoints(VersionedTable(spark, f"{root}/tables/{collection}_sync", schemas.SYNC_METADATA))
        replication.apply_feed(batch, target, marks, collection, key, stamp, batch_id)
        target.expire()
        marks.table.expire()

    return _start(stream, handle, f"{root}/progress/{collection}", every)


def mirror_subscriptions(stream: DataFrame, root: str, *, every: str | None = None) -> StreamingQuery:
    """Versions of the subscription document into the durable set of stations."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        table = VersionedTable(batch.sparkSession, f"{root}/tables/subscribed", schemas.SUBSCRIBED)
        newest = batch.orderBy(F.col("last_updated").desc_nulls_last()).limit(1)
        replication.mirror_subscriptions(newest, table, batch_id)

    return _start(stream, handle, f"{root}/progress/subscribed", every)
