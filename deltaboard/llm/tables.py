"""Small shared parts of the operators: reading, staging, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaboard.session import Staging


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def connected_components(edges: DataFrame, stage: Staging) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``; label is the component's least node.

    Alternates large-star and small-star steps: each hangs the neighbours of a
    node on the least of them, until all edges point at the least node. Minima
    combine before the shuffle, and the joins back are plain equi-joins whose hot
    keys Spark splits. Each round is a written table.
    """
    current = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0")
    before = None
    for turn in range(1, 100):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = stage(large.distinct(), f"large{turn}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .where("a <> b")
        )
        current = stage(small.distinct(), f"edges{turn}")
        sums = [F.count("*").alias("n")] + [F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")]
        now = tuple(current.agg(*sums).first())
        if now == before:
            break
        before = now
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
