"""From raw documents to sampled token ids: the stages of the corpus pipeline.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all rows the stage
before it kept; its result is written as Parquet and read again as the next
stage's ``docs``. Ids may be null or shared by several rows, texts may be null or
empty, and other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaboard.llm.containment import contained_items
from deltaboard.llm.pieces import encode_samples
from deltaboard.llm.quality import quality_rules
from deltaboard.llm.secrets import redact, scan_secrets
from deltaboard.llm.simhash import near_copies
from deltaboard.llm.tables import table
from deltaboard.session import Staging

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents, and from the others the lines that too many documents of their host share.

    Each row is judged by its own text; null texts have no words and are rejected.
    """
    judged = quality_rules(docs, Staging(spark), keep=("lang", "source"))
    return judged.where("kept").select(
        "doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars")
    )


def numbered(docs: DataFrame, stage: Staging) -> DataFrame:
    """The documents with a ``row`` of their own: ids may be null or shared, and decisions are about rows."""
    return stage(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")


def by_row(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` for an operator that goes by doc_id, which is the row here."""
    return rows.select(F.col("row").alias("doc_id"), *columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the one with the least id, nulls last; of equal ids any one."""
    stage = Staging(spark)
    rows = numbered(docs, stage)
    groups = near_copies(by_row(rows, "text"), stage).select(F.col("doc_id").alias("row"), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = rows.select("row", "doc_id").join(groups, "row").groupBy("component_id").agg(F.min(place).alias("first"))
    return rows.join(first.select("first.row"), "row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text contains a benchmark item, whatever their id, and no other."""
    stage = Staging(spark)
    rows = numbered(docs, stage)
    found = contained_items(by_row(rows, "text"), table(spark, sf_dir, "benchmark"))
    hit = stage(found.select(F.col("doc_id").alias("row")).distinct(), "contaminated")
    return rows.join(hit, "row", "left_anti").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a filler, in rows with and without an id; all documents stay."""
    stage = Staging(spark)
    clean = redact(docs, stage(scan_secrets(docs, stage), "findings"), COLUMNS)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled SentencePiece ids of every row; rows without an id keep null there, a null text has no pieces."""
    return encode_samples(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

# The near-copy fingerprints, the trained forest and the sampled segmentations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Staging(spark)
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
