"""Collocations by relational mining of occurrences, one phrase length after the other.

The occurrence relation of length k holds, in order of piece and position, the
phrases of k words that are frequent. It is packed by chunk of documents: one
array of phrase numbers in which -1 stands wherever two neighbours are not
adjacent, and a row for each distinct phrase, so that no reader or writer holds
the phrases of a chunk at once. Merging the relation with itself at the next position gives the phrases
of k + 1 words; they are counted over all chunks, and a semi-join with the
frequent ones comes before the next length. Every relation is a written table.

What a chunk sends into the counts is each of its distinct phrases once, with a
number. No text, piece or count leaves its chunk otherwise, so a very common
word or phrase is one row per chunk.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaboard.session import Staging

LONGEST, LEAST, TOP = 4, 30, 2000
SCALE = 2_000_000
#: Words after which a chunk of documents is closed; a document is never cut.
CHUNK = 500_000
#: Up to this many bytes, as counted, the frequent phrases of a length are broadcast; beyond, both sides shuffle.
BROADCAST_BYTES = 32 << 20
#: A phrase inside a longer one with this percentage of its count is dropped.
INSIDE = 80

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
BREAKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(UPPER + b"\t" + BREAKS, LOWER + b" " + b"\n" * len(BREAKS))

#: Rows of a relation that are handed on at once.
ROWS = 1 << 16
#: How a relation is written: what a writer buffers and a reader opens is a few MB, however many chunks a file has.
LAID_OUT = {"compression": "zstd", "parquet.block.size": str(16 << 20)}

# Either a chunk's ``items`` or one of its phrases; number ``block * 256 + place`` is stored so that it takes no room.
FIRST = "chunk bigint, lang string, items array<int>, block int, place int, words binary, c bigint"
NEXT = "chunk bigint, items array<int>, block int, place int, a bigint, b bigint, c bigint"
_FIRST = pa.schema([
    ("chunk", pa.int64()), ("lang", pa.string()), ("items", pa.list_(pa.int32())), ("block", pa.int32()),
    ("place", pa.int32()), ("words", pa.binary()), ("c", pa.int64()),
])
_NEXT = pa.schema([
    ("chunk", pa.int64()), ("items", pa.list_(pa.int32())), ("block", pa.int32()), ("place", pa.int32()),
    ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()),
])


class _Numbers(dict):
    """Words to numbers in order of appearance; 0 is the gap between two blanks, 1 a break between pieces."""

    def __init__(self) -> None:
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _squeezed(items: np.ndarray) -> np.ndarray:
    """``items`` without its first -1 and without any -1 that follows another."""
    used = items >= 0
    keep = used.copy()
    keep[1:] |= used[:-1]
    return items[keep]


def _rows(schema: pa.Schema, chunk: dict, items: np.ndarray, phrases: dict) -> Iterator[pa.RecordBatch]:
    """The row of ``items`` and those of ``phrases`` in the order of their numbers; ``chunk`` has what all rows share."""
    for start in (None, *range(0, len(phrases["c"]), ROWS)):
        if start is None:
            n, cells = 1, {"items": [items]}
        else:
            number = np.arange(start, min(start + ROWS, len(phrases["c"])), dtype=np.int32)
            n, cells = len(number), {k: v[start : start + ROWS] for k, v in phrases.items()}
            cells |= {"block": number >> 8, "place": number & 255}
        shared = {k: pa.repeat(pa.scalar(v, schema.field(k).type), n) for k, v in chunk.items()}
        made = [
            shared[f.name] if f.name in shared else pa.array(cells[f.name], f.type) if f.name in cells else pa.nulls(n, f.type)
            for f in schema
        ]
        yield pa.RecordBatch.from_arrays(made, schema=schema)


class _Open:
    """A chunk that still takes documents of one language."""

    def __init__(self) -> None:
        self.numbers, self.parts, self.size = _Numbers(), [], 0

    def add(self, text: bytes) -> int:
        words = text.translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        # A break ends the document too.
        self.parts.append(np.append(found[found > 0], np.int32(1)) - 2)
        self.size += len(words)
        return len(words)

    def rows(self, chunk: int, lang: str) -> Iterator[pa.RecordBatch]:
        items = np.concatenate(self.parts)
        counts = np.bincount(items[items >= 0], minlength=len(self.numbers) - 2)
        words = list(self.numbers)[2:]
        return _rows(_FIRST, {"chunk": chunk, "lang": lang}, _squeezed(items), {"words": words, "c": counts})


def _first(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """The relation of single words from ``lang`` and ``text``."""
    open_, total = {}, 0
    # Only one attempt of a task is kept, so its partition makes the numbers of its chunks unique.
    chunks = itertools.count(TaskContext.get().partitionId() << 32)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if lang not in open_:
                open_[lang] = _Open()
            total += open_[lang].add(text.as_py())
            while total >= 2 * chunk:
                fullest = max(open_, key=lambda k: open_[k].size)
                full = open_.pop(fullest)
                total -= full.size
                yield from full.rows(next(chunks), fullest)
    for lang, rest in open_.items():
        yield from rest.rows(next(chunks), lang)


def _extended(left: pa.Table, right: pa.Table) -> pa.Table:
    """One chunk: its occurrences, cut to the frequent phrases, merged with themselves at the next position.

    ``left`` has the row of the chunk, ``right`` the frequent phrases in it: the
    number they have in the chunk (``local``) and everywhere (``id``).
    """
    if not left.num_rows or not right.num_rows:
        return _NEXT.empty_table()
    items = left["items"].combine_chunks().values.to_numpy(zero_copy_only=False).astype(np.int64)
    local = right["local"].to_numpy().astype(np.int64)
    ids = np.full(max(int(local.max()), int(items.max(initial=0))) + 1, -1, np.int64)
    ids[local] = right["id"].to_numpy()
    known = (items >= 0) & (ids[np.maximum(items, 0)] >= 0)
    both = known[:-1] & known[1:]
    if not both.any():
        return _NEXT.empty_table()
    codes = items[:-1][both] * len(ids) + items[1:][both]
    distinct, place, counts = np.unique(codes, return_inverse=True, return_counts=True)
    following = np.full(len(both), -1, np.int32)
    following[both] = place
    a, b = np.divmod(distinct, len(ids))
    found = {"a": ids[a], "b": ids[b], "c": counts}
    return pa.Table.from_batches(_rows(_NEXT, {"chunk": left["chunk"][0].as_py()}, _squeezed(following), found))


def _numbered(counted: DataFrame, stage: Staging, name: str) -> tuple[DataFrame, int]:
    """``counted`` staged with a short unique ``id`` (place in its file times files, plus the file), and its bytes in memory."""
    made = stage(counted.withColumn("_at", F.monotonically_increasing_id()), name)
    texts = F.sum(F.octet_length("words")) if "words" in made.columns else F.lit(0)
    last, rows, bytes_ = made.agg(F.max(F.shiftright("_at", 33)), F.count("*"), texts).first()
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return made.withColumn("id", place * ((last or 0) + 1) + F.shiftright("_at", 33)).drop("_at"), 40 * rows + (bytes_ or 0)


def _as_local(relation: DataFrame) -> DataFrame:
    """One row per distinct phrase of a chunk: chunk, local number, keys, count."""
    found = relation.where(F.col("place").isNotNull()).withColumn("local", F.col("block") * 256 + F.col("place"))
    return found.drop("items", "block", "place")


def phrase_counts(
    docs: DataFrame, stage: Staging, longest: int = LONGEST, least: int = LEAST, chunk: int = CHUNK,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language, and the frequent phrases of each length from 1 on.

    ``(lang, n)`` counts all words. The first table has lang, words (one word),
    f and id, the later ones a, b, f and id: the phrase is phrase ``a`` of the
    table before with the last word of its phrase ``b``, which starts one word
    later. Both are frequent whenever the phrase is.

    ``docs`` needs text and lang; other columns are not read. A null text is
    empty and a null language is ``und``. Repeated rows count as often as they
    come. Empty tables give empty tables.
    """
    texts = docs.select(
        F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    )
    relation = stage(texts.mapInArrow(lambda rows: _first(rows, chunk), FIRST), "occurrences1", **LAID_OUT)
    spread = _as_local(relation)
    counted = stage(spread.groupBy("lang", "words").agg(F.sum("c").alias("f")), "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    tables, keys = [], ["lang", "words"]
    for length in range(1, longest + 1):
        if length > 1:
            counted = spread.groupBy(*keys).agg(F.sum("c").alias("f"))
        frequent, size = _numbered(counted.where(F.col("f") >= least), stage, f"frequent{length}")
        tables.append(frequent)
        if length == longest:
            break
        sought = F.broadcast(frequent) if size <= broadcast_bytes else frequent
        kept = spread.join(sought, keys).select(F.col("chunk").alias("owner"), "local", "id")
        items = relation.select("chunk", "items").where(F.col("items").isNotNull())
        grown = items.groupBy("chunk").cogroup(kept.groupBy("owner")).applyInArrow(_extended, NEXT)
        relation, keys = stage(grown, f"occurrences{length + 1}", **LAID_OUT), ["a", "b"]
        # The counts and the longer occurrences are written, so nothing goes back to the shorter ones.
        stage.drop(f"occurrences{length}")
        spread = _as_local(relation)
    return totals, tables


#: floor(2000000 a / (l + r)) in whole numbers of 38 digits.
_SCORE = f"cast({SCALE} AS decimal(8,0)) * cast(a AS decimal(28,0)) div (cast(l AS decimal(28,0)) + cast(r AS decimal(28,0)))"
_NOT_INSIDE = f"most IS NULL OR cast(most AS decimal(28,0)) * 100 < cast(f AS decimal(28,0)) * {INSIDE}"


def _phrases(tables: list[DataFrame], stage: Staging) -> list[DataFrame]:
    """Phrases of each length from 2 on: length, id, lang, phrase, f, cuts and parts.

    ``cuts`` has l and r of every cut in its order, ``parts`` the (length, id) of
    every shorter phrase inside. ``heads`` and ``tails`` are the counts of the
    first and the last 1, 2, ... words.
    """
    found = tables[0].select(
        "id", "lang", F.col("words").alias("phrase"), F.col("words").alias("last"), F.array("f").alias("heads"),
        F.array("f").alias("tails"), F.array().cast("array<struct<length:int,id:bigint>>").alias("parts"),
    )
    made = []
    for length, table in enumerate(tables[1:], start=2):
        x = found.select("id", "lang", "phrase", "heads", "parts").toDF("a", "lang", "a_phrase", "a_heads", "a_parts")
        y = found.select("id", "last", "tails", "parts").toDF("b", "last", "b_tails", "b_parts")
        cuts = [
            F.struct(F.get("a_heads", F.lit(k - 1)).alias("l"), F.get("b_tails", F.lit(length - k - 1)).alias("r"))
            for k in range(1, length)
        ]
        halves = F.array(*[F.struct(F.lit(length - 1).alias("length"), F.col(c).alias("id")) for c in ("a", "b")])
        found = stage(
            table.join(x, "a").join(y, "b").select(
                F.lit(length).alias("length"), "id", "lang", F.concat("a_phrase", F.lit(b" "), "last").alias("phrase"), "last",
                "f", F.concat("a_heads", F.array("f")).alias("heads"), F.concat("b_tails", F.array("f")).alias("tails"),
                F.array(*cuts).alias("cuts"), F.array_distinct(F.concat("a_parts", "b_parts", halves)).alias("parts"),
            ),
            f"phrases{length}",
        )
        made.append(found)
    return made


def _top(scored: DataFrame, top: int, slices: int = 64) -> DataFrame:
    """The first ``top`` rows per language with their rank, cut within slices of a language first."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = Window.partitionBy("lang", "_slice").orderBy(*order)
    cut = scored.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(slices)))
    cut = cut.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= top).drop("_rank", "_slice")
    whole = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return cut.withColumn("rank", whole.cast("bigint")).where(F.col("rank") <= top)


def collocations(
    docs: DataFrame, stage: Staging, *, least: int = LEAST, top: int = TOP, chunk: int = CHUNK,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The best phrases of 2 to 4 words per language: lang, rank, phrase, a, l, r, n, score.

    A phrase occurs at least ``least`` times within pieces. Its score is that of
    its worst cut, floor(2000000 a / (l + r)); of equal cuts the first counts. It
    is dropped if a longer phrase around it has at least 80 % of its count. Ties
    go to the more frequent phrase, then to the one that is first in byte order.
    A language without phrases has no row. See ``phrase_counts`` for odd rows.
    """
    totals, tables = phrase_counts(docs, stage, least=least, chunk=chunk, broadcast_bytes=broadcast_bytes)
    found = _phrases(tables, stage)
    columns = ["length", "id", "lang", "phrase", "f", "cuts", "parts"]
    candidates = functools.reduce(DataFrame.unionByName, [t.select(*columns) for t in found])
    around = candidates.select("f", F.explode("parts").alias("_p")).groupBy("_p.length", "_p.id").agg(F.max("f").alias("most"))
    alone = candidates.drop("parts").join(around, ["length", "id"], "left").where(_NOT_INSIDE)
    cut = alone.select("lang", "phrase", F.col("f").alias("a"), F.posexplode("cuts").alias("_k", "_cut")).select(
        "lang", "phrase", "a", "_k", "_cut.l", "_cut.r"
    )
    worst = F.min(F.struct(F.expr(_SCORE).alias("score"), "_k", "l", "r")).alias("_worst")
    best = cut.groupBy("lang", "phrase", "a").agg(worst).select(
        "lang", F.col("phrase").cast("string").alias("phrase"), "a", "_worst.l", "_worst.r", "_worst.score"
    )
    return _top(best, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
