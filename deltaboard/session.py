"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: Public setting since 4.1; earlier versions do not read it.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("deltaboard")
    settings = {
        **SESSION_CONF,
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cores),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all machines must reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return folder


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """File system and path of a folder or pattern, wherever it is; the one place that reaches for the JVM."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


class Staging:
    """Tables written once to the shared folder for results that several branches use.

    Reading back cuts the lineage, survives the loss of executors, and lets each
    branch read only the columns it needs. ``close`` removes the folder, as does
    leaving a ``with`` block, failed or not.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.made, self.paths = spark, 0, {}
        self.folder = f"{(folder or shared_folder(spark)).rstrip('/')}/staged/{uuid.uuid4().hex}"

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *failure: object) -> None:
        self.close()

    def __call__(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` and read it back; ``options`` are the writer's.

        The shuffle files of the write are of no use after it and are removed.
        """
        self.made += 1
        path = f"{self.folder}/{self.made:03d}-{name}"
        before = self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.options(**options).parquet(path)
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove the last table of that name, once nothing reads it any more."""
        fs, path = hadoop_path(self.spark, self.paths.pop(name))
        fs.delete(path, True)

    def close(self) -> None:
        fs, path = hadoop_path(self.spark, self.folder)
        fs.delete(path, True)
