"""Finds short test items inside long documents: size-partitioned MinHash, verified by exact containment.

Items are partitioned by their number of word shingles. For a partition with at
most ``u`` shingles, documents are cut into blocks of ``u / 4`` shingles and
every five neighbouring blocks are one window, so a passage of an item lies in
some window of at most ``1.25 u`` shingles and its similarity with the window
stays high however long the document is. MinHash minima are taken per block once
and combined per window; a window that shares a minimum with an item is verified.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
PERMUTATIONS = 48
ITEMS_PER_BLOCK = 50_000
RUN_WORDS = 400_000
WORD = re.compile(r"\w+")
U = np.uint64


class _Hashes(dict):
    """Word hashes, computed once each; emptied when it grows over its bound."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= 400_000:
            self.clear()
        self[word] = value
        return value


HASHES = _Hashes()


def _words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if isinstance(text, str) else []


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, as if the array were one document."""
    n = max(0, len(words) - size + 1)
    found = np.zeros(n, dtype=U)
    for k in range(size):
        found = found * U(0x9E3779B97F4A7C15) + words[k : k + n]
    found = (found ^ (found >> U(32))) * U(0xD6E8FEB86659FD93)
    return found ^ (found >> U(32))


def _permutations(count: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**32, (count, 2), dtype=np.uint32) | np.array([1, 0], dtype=np.uint32)


class ItemIndex:
    """Items of one block by size partition, with the minima of each."""

    def __init__(self, items: list[tuple[object, list[str]]], shingle: int, permutations: int):
        self.turns = _permutations(permutations)
        self.words = {item: words for item, words in items if words}
        self.short: dict[int, dict[int, list[object]]] = defaultdict(lambda: defaultdict(list))
        self.sets: dict[object, np.ndarray] = {}
        by_size: dict[int, list[object]] = defaultdict(list)
        for item, words in self.words.items():
            hashes = np.fromiter((HASHES[w] for w in words), dtype=U, count=len(words))
            if len(words) < shingle:
                self.short[len(words)][int(_shingles(hashes, len(words))[0])].append(item)
                continue
            self.sets[item] = np.unique(_shingles(hashes, shingle))
            by_size[max(8, 1 << (len(self.sets[item]) - 1).bit_length())].append(item)
        self.parts = []
        for most, names in sorted(by_size.items()):
            minima = np.stack([self._minima(self.sets[name]) for name in names])
            bits = max(16, min(22, (len(names) * 64).bit_length()))
            seen = np.zeros((permutations, 1 << bits), dtype=bool)
            for j in range(permutations):
                seen[j, minima[:, j] & np.uint32((1 << bits) - 1)] = True
            lookup = [defaultdict(list) for _ in range(permutations)]
            for row, name in enumerate(names):
                for j in range(permutations):
                    lookup[j][int(minima[row, j])].append(name)
            self.parts.append((most, np.uint32((1 << bits) - 1), seen, lookup))

    def _minima(self, hashes: np.ndarray) -> np.ndarray:
        high = (hashes >> U(32)).astype(np.uint32)
        return np.array([(high * a + b).min() for a, b in self.turns], dtype=np.uint32)

    def search(self, texts: list[str | None], shingle: int, least: float) -> Iterator[tuple[int, object, int, int]]:
        """``(text number, item, shingles, shingles found)`` for every item contained in a window of a text."""
        docs = [_words(t) for t in texts]
        sizes = np.array([len(d) for d in docs])
        ends = np.cumsum(sizes)
        hashes = np.fromiter((HASHES[w] for d in docs for w in d), dtype=U, count=int(ends[-1]) if len(ends) else 0)
        for size, wanted in self.short.items():
            found = _shingles(hashes, size)
            for at in np.nonzero(np.isin(found, np.array(list(wanted), dtype=U)))[0]:
                doc = int(np.searchsorted(ends, at, side="right"))
                if at + size <= ends[doc]:
                    for item in wanted[int(found[at])]:
                        if docs[doc][at - ends[doc] + sizes[doc] :][:size] == self.words[item]:
                            yield doc, item, 1, 1
        found = _shingles(hashes, shingle)
        if not len(found) or not self.parts:
            return
        counts = np.maximum(sizes - shingle + 1, 0)
        begins = ends - sizes
        high = (found >> U(32)).astype(np.uint32)
        for most, mask, seen, lookup in self.parts:
            step = most // 4
            per_doc = -(-counts // step)
            doc = np.repeat(np.arange(len(docs)), per_doc)
            first = np.cumsum(per_doc) - per_doc
            start = begins[doc] + (np.arange(len(doc)) - first[doc]) * step
            stop = np.minimum(start + step, (begins + counts)[doc])
            if not len(doc):
                continue
            # Between blocks lie words whose runs cross documents; their slots are dropped.
            edges = np.stack([start, stop], axis=1).ravel()
            edges = np.minimum(edges, len(high) - 1)
            tail = stop[-1] >= len(high)
            hits: dict[int, set[object]] = defaultdict(set)
            for j, (a, b) in enumerate(self.turns):
                turned = high * a + b
                minima = np.minimum.reduceat(turned, edges)[::2]
                if tail:
                    minima[-1] = turned[start[-1] :].min()
                window = minima.copy()
                for k in range(1, 5):
                    same = doc[k:] == doc[:-k]
                    window[:-k][same] = np.minimum(window[:-k][same], minima[k:][same])
                for at in np.nonzero(seen[j][window & mask])[0]:
                    if names := lookup[j].get(int(window[at])):
                        hits[int(at)].update(names)
            best: dict[tuple[int, object], int] = {}
            for at, names in hits.items():
                owner = int(doc[at])
                end = min(start[at] + 5 * step, begins[owner] + counts[owner])
                inside = np.unique(found[start[at] : end])
                for item in names:
                    shared = int(np.isin(self.sets[item], inside, assume_unique=True).sum())
                    if shared >= least * len(self.sets[item]):
                        shared = self._exact(item, docs[owner][start[at] - begins[owner] : end - begins[owner] + shingle - 1], shingle)
                        best[owner, item] = max(best.get((owner, item), 0), shared)
            for (owner, item), shared in best.items():
                if shared >= least * len(self.sets[item]):
                    yield owner, item, len(self.sets[item]), shared

    def _exact(self, item: object, words: list[str], shingle: int) -> int:
        own = self.words[item]
        return len(set(zip(*(own[k:] for k in range(shingle)))) & set(zip(*(words[k:] for k in range(shingle)))))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    shingle: int = SHINGLE,
    containment: float = CONTAINMENT,
    permutations: int = PERMUTATIONS,
    items_per_block: int = ITEMS_PER_BLOCK,
) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared, containment`` for items of ``items(item_id, text)`` in ``docs(doc_id, text)``.

    An item counts if one window of the document has at least ``containment`` of
    its distinct shingles, of ``shingle`` words in lower case; the best window is
    reported. An item with fewer words is one shingle of its own length; one
    without words, or with a null id or text, is in no document. Of several texts
    with one item_id the best contained one is reported. Repeated rows of ``docs`` each get
    their rows, a null doc_id comes back as null. Empty tables give no rows. Other
    columns are ignored.

    Items are sent to the tasks in blocks of at most ``items_per_block``, chosen by
    a hash of their id; each block is one pass over the documents, so neither the
    driver nor a task holds more. With 48 permutations a window with four fifths
    of an item is missed with a probability under 1e-6.
    """
    spark: SparkSession = docs.sparkSession
    known = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    blocks = max(1, -(-known.count() * 5 // (4 * items_per_block)))
    known = known.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    kind = dict(items.dtypes)["item_id"]
    result = None
    for block in range(blocks):
        rows = known.where(F.col("block") == block).orderBy(F.length("text"), "text").collect()
        # Several texts may have one item_id; each is looked for.
        sent = spark.sparkContext.broadcast([((r["item_id"], k), _words(r["text"])) for k, r in enumerate(rows)])

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = ItemIndex(sent.value, shingle, permutations)
            for batch in batches:
                rows: list[tuple] = []
                ids, run, size, base = batch["doc_id"].to_list(), [], 0, 0
                texts = batch["text"].to_list()
                for k, text in enumerate(texts):
                    run.append(text)
                    size += len(text) if isinstance(text, str) else 0
                    if size > 6 * RUN_WORDS or k == len(texts) - 1:
                        best: dict[tuple[int, object], tuple[float, int, int]] = {}
                        for at, (item, _), total, shared in index.search(run, shingle, containment):
                            best[at, item] = max(best.get((at, item), (0.0, 0, 0)), (shared / total, total, shared))
                        for (at, item), (part, total, shared) in best.items():
                            rows.append((ids[base + at], item, total, shared, part))
                        base, run, size = k + 1, [], 0
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_shingles", "n_shared", "containment"]).astype({"doc_id": "Int64"})

        found = docs.select("doc_id", "text").mapInPandas(
            search, f"doc_id long, item_id {kind}, n_shingles long, n_shared long, containment double"
        )
        result = found if result is None else result.unionByName(found)
    return result
