"""Keyed tables as versioned Parquet folders.

Each write makes a new folder ``v=<n>``, or ``v=<n>-batch-<id>`` for a micro-batch.
A version exists once its ``_SUCCESS`` file does, which Spark writes last, so
readers see a whole version or the one before. A batch builds on the newest
version that it did not write itself, so boot loads and streams may share a table,
and a replayed batch replaces its own version. One stream writes a table; a stream
that starts anew with batch 0 needs a new table as it needs a new progress folder.

A small table, or one that each batch looks at as a whole, is a ``VersionedTable``.
A large one of which a batch changes some keys is a ``KeyedTable``: its rows lie in
partitions by the key's hash, a write makes the partitions anew that its keys fall
in, and the version is the list of where each partition is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaboard.operators import replicate
from deltaboard.schemas import Schema
from deltaboard.session import Staging, hadoop_path

#: Complete versions that a job leaves behind: the newest, and what a replay or a slow reader may need.
KEPT_VERSIONS = 3


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: Schema):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema

    def _listed(self) -> list[tuple[int, int | None, str]]:
        """(number, batch, folder) of the complete versions, oldest first."""
        fs, pattern = hadoop_path(self.spark, f"{self.path}/v=*/_SUCCESS")
        listed = []
        for status in fs.globStatus(pattern) or []:
            folder = status.getPath().getParent().getName()
            number, _, batch = folder[2:].partition("-batch-")
            listed.append((int(number), int(batch) if batch else None, folder))
        return sorted(listed, key=lambda v: v[0])

    def versions(self) -> list[int]:
        """Numbers of the complete versions, oldest first."""
        return [number for number, _, _ in self._listed()]

    def _base(self, batch: int | None) -> tuple[list[tuple[int, int | None, str]], tuple[int, int | None, str] | None]:
        """Versions that ``batch`` builds on, and the version it wrote before, if any.

        Only the last batch of a stream is ever replayed.
        """
        listed = self._listed()
        streamed = [v for v in listed if v[1] is not None]
        if batch is None or not streamed or streamed[-1][1] != batch:
            return listed, None
        mine = streamed[-1]
        return [v for v in listed if v[0] < mine[0]], mine

    def current(self, batch: int | None = None) -> int | None:
        usable, _ = self._base(batch)
        return usable[-1][0] if usable else None

    def read(self, batch: int | None = None) -> DataFrame:
        """The newest version, or the one that ``batch`` builds on; empty if there is none."""
        usable, _ = self._base(batch)
        if not usable:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{usable[-1][2]}")

    def write(self, df: DataFrame, batch: int | None = None) -> int:
        usable, mine = self._base(batch)
        if mine is not None:
            number, _, folder = mine
        else:
            number = usable[-1][0] + 1 if usable else 0
            folder = f"v={number}" if batch is None else f"v={number}-batch-{batch}"
        columns = [F.col(name).cast(kind).alias(name) for name, kind in self.schema.types.items()]
        df.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{folder}")
        return number

    def expire(self, keep: int = KEPT_VERSIONS) -> None:
        """Remove all complete versions but the newest ``keep``."""
        for _, _, folder in self._listed()[:-keep]:
            fs, path = hadoop_path(self.spark, f"{self.path}/{folder}")
            fs.delete(path, True)

    def clear(self, batch: int | None = None) -> int:
        return self.write(self.spark.createDataFrame([], self.schema), batch)

    def upsert(self, rows: DataFrame, key: str, order: list, batch: int | None = None) -> int:
        return self.write(replicate.upsert(self.read(batch), rows, key, order), batch)

    def apply(self, changes: DataFrame, key: str, order: list, op: str = "op", batch: int | None = None) -> int:
        return self.write(replicate.merge_changes(self.read(batch), changes, key, order, op), batch)

    def delete(self, keys: DataFrame, key: str, batch: int | None = None) -> int:
        return self.write(replicate.delete_keys(self.read(batch), keys, key), batch)

    def replace_set(self, ids: DataFrame, key: str, batch: int | None = None) -> int:
        """Swap in a whole set; a failing write leaves the old version current."""
        return self.write(replicate.replacement_set(ids, key), batch)

    def count(self) -> DataFrame:
        return self.read().agg(F.count(F.lit(1)).alias("n"))

    def find(self, field: str, value: object) -> DataFrame:
        return self.read().where(F.col(field) == F.lit(value))


class KeyedTable:
    """A table with one row per key, in ``partitions`` by the key's hash.

    ``data/<write>/part=<p>`` holds the partitions of one write, and the versions
    of ``parts`` say which write has each partition's rows. A batch reads and
    writes the partitions that its keys fall in; the others stay where they are.
    A write that fails leaves no trace in ``parts``. Rows without a key are not
    stored. ``partitions`` must not change while a table exists.
    """

    def __init__(self, spark: SparkSession, path: str, schema: Schema, key: str, partitions: int = 64):
        self.spark, self.path, self.schema, self.key, self.partitions = spark, path.rstrip("/"), schema, key, partitions
        self.parts = VersionedTable(spark, f"{self.path}/parts", Schema("part int, folder string"))

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.partitions)).cast("int")

    def _placed(self, batch: int | None = None) -> dict[int, str]:
        return {r["part"]: r["folder"] for r in self.parts.read(batch).collect()}

    def _rows(self, placed: dict[int, str]) -> DataFrame:
        if not placed:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/{folder}/part={part}" for part, folder in sorted(placed.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def versions(self) -> list[int]:
        return self.parts.versions()

    def read(self, batch: int | None = None) -> DataFrame:
        """The newest version, or the one that ``batch`` builds on; empty if there is none."""
        return self._rows(self._placed(batch))

    def find(self, field: str, value: object) -> DataFrame:
        """Rows by one field; by the key, one partition is read."""
        placed = self._placed()
        if field == self.key:
            part = self.spark.range(1).select(self._part(F.lit(value))).head()[0]
            placed = {p: folder for p, folder in placed.items() if p == part}
        return self._rows(placed).where(F.col(field) == F.lit(value))

    def count(self) -> DataFrame:
        return self.read().agg(F.count(F.lit(1)).alias("n"))

    def _replace(self, placed: dict[int, str], touched: list[int], rows: DataFrame, batch: int | None) -> int:
        """``rows`` are all rows of the ``touched`` partitions from now on."""
        columns = [F.col(name).cast(kind).alias(name) for name, kind in self.schema.types.items()]
        folder = uuid.uuid4().hex
        now = {p: f for p, f in placed.items() if p not in set(touched)}
        if touched:
            path = f"{self.path}/data/{folder}"
            laid = rows.select(*columns, self._part(F.col(self.key)).alias("part")).repartition("part")
            laid.write.partitionBy("part").parquet(path)
            fs, found = hadoop_path(self.spark, f"{path}/part=*")
            now |= {int(s.getPath().getName()[5:]): folder for s in fs.globStatus(found) or []}
        return self.parts.write(self.spark.createDataFrame(sorted(now.items()), self.parts.schema), batch)

    def _touched(self, keys: DataFrame) -> list[int]:
        """Partitions that the keys fall in; at most ``partitions`` numbers."""
        return sorted(r[0] for r in keys.select(self._part(F.col(self.key))).distinct().collect())

    def apply(self, changes: DataFrame, key: str, order: list, op: str = "op", batch: int | None = None) -> int:
        """Upserts and deletes; the last change per key counts. ``key`` is the table's."""
        if key != self.key:
            raise ValueError(f"the table's key is {self.key}, not {key}")
        with Staging(self.spark, f"{self.path}/work") as stage:
            usable = stage(changes.where(F.col(key).isNotNull()), "changes")
            placed, touched = self._placed(batch), self._touched(usable)
            old = self._rows({p: placed[p] for p in touched if p in placed})
            return self._replace(placed, touched, replicate.merge_changes(old, usable, key, order, op), batch)

    def upsert(self, rows: DataFrame, key: str, order: list, batch: int | None = None) -> int:
        return self.apply(rows.withColumn("_op", F.lit(replicate.MODIFIED)), key, order, "_op", batch)

    def delete(self, keys: DataFrame, key: str, batch: int | None = None) -> int:
        placed, touched = self._placed(batch), self._touched(keys.where(F.col(key).isNotNull()))
        touched = [p for p in touched if p in placed]
        old = self._rows({p: placed[p] for p in touched})
        return self._replace(placed, touched, replicate.delete_keys(old, keys, key), batch)

    def clear(self, batch: int | None = None) -> int:
        return self.parts.clear(batch)

    def expire(self, keep: int = KEPT_VERSIONS) -> None:
        """Remove old versions, and the data that none of the newest ``keep`` versions names.

        Only for the table's one writer, between writes.
        """
        self.parts.expire(keep)
        folders = [f"{self.parts.path}/{folder}" for _, _, folder in self.parts._listed()]
        used = {r[0] for r in self.spark.read.schema(self.parts.schema).parquet(*folders).select("folder").distinct().collect()} if folders else set()
        fs, found = hadoop_path(self.spark, f"{self.path}/data/*")
        for status in fs.globStatus(found) or []:
            if status.getPath().getName() not in used:
                fs.delete(status.getPath(), True)


class Checkpoints:
    """High-water marks per collection; they never move back."""

    PREFIX = "last_sync_"

    def __init__(self, table: VersionedTable):
        self.table = table

    def get(self, collection: str, batch: int | None = None) -> str | None:
        rows = self.table.read(batch).where(F.col("key") == self.PREFIX + collection).select("value").head(1)
        return rows[0][0] if rows else None

    def advance(self, collection: str, value: str, batch: int | None = None) -> int:
        spark = self.table.spark
        incoming = spark.createDataFrame([(self.PREFIX + collection, value)], self.table.schema)
        return self.table.write(replicate.advance(self.table.read(batch), incoming), batch)
