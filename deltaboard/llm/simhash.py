"""Near copies by SimHash, found by the general pigeonhole principle."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaboard.llm.tables import connected_components
from deltaboard.session import Staging

BITS = 64
SHINGLE = 3
DISTANCE = 3
SEED = 42
SAMPLE = 2000
BUCKET = 4096
ONE = np.uint64(1)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, each as often as it occurs; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = map(b" ".join, zip(*(words[k:] for k in range(size))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), dtype="<u8")
    set_bits = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (as signed long) for every row of ``docs(doc_id, text)``; a null text is empty."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": found.view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(of, "doc_id long, fp long")


def correlated_parts(sample: np.ndarray, count: int) -> list[list[int]]:
    """``count`` parts of near-equal size: each takes the free bits most correlated with those it has."""
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & ONE
    spread = bits.astype(float) - bits.mean(axis=0)
    scale = np.sqrt((spread**2).mean(axis=0)) + 1e-9
    tied = np.abs(spread.T @ spread / max(1, len(sample)) / np.outer(scale, scale))
    np.fill_diagonal(tied, 0)
    free, parts = set(range(BITS)), []
    for k in range(count):
        size = BITS * (k + 1) // count - BITS * k // count
        part = [max(free, key=lambda b: (tied[b, sorted(free)].max(), -b))]
        free.discard(part[0])
        while len(part) < size:
            best = max(free, key=lambda b: (tied[b, part].sum(), -b))
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def part_costs(sample: np.ndarray, part: list[int], rows: int, most: int) -> list[float]:
    """Estimated rows and candidate pairs for thresholds -1 to ``most`` of one part."""
    mask = np.uint64(sum(1 << b for b in part))
    own = sample & mask
    apart = np.bitwise_count(own[:, None] ^ own[None, :])
    pairs = max(1, len(sample) * (len(sample) - 1))
    costs = [0.0]
    for t in range(most + 1):
        near = max(0, int((apart <= t).sum()) - len(sample)) / pairs
        keys = sum(math.comb(len(part), j) for j in range(t + 1))
        costs.append(rows * float(keys) + rows * float(rows) * max(near, keys / 2.0 ** len(part)) / 2)
    return costs


def thresholds(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Least total cost with thresholds >= -1 that sum to ``distance - parts + 1``, by dynamic programming.

    If every part were further apart than its threshold, the distances would sum
    to more than ``distance``; so each pair within it meets in some part.
    """
    best = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for extra, c in enumerate(cost):  # extra = threshold + 1
                now = (total + c, [*chosen, extra - 1])
                if used + extra <= distance + 1 and (used + extra not in step or now < step[used + extra]):
                    step[used + extra] = now
        best = step
    return best[distance + 1]


def probe_plan(sample: np.ndarray, rows: int, distance: int) -> list[tuple[list[int], int]]:
    """Parts and their thresholds, for the number of parts with the least estimated cost."""
    plans = []
    for count in range(2, max(4, distance + 1) + 1):
        parts = correlated_parts(sample, count)
        cost, chosen = thresholds([part_costs(sample, p, rows, min(distance, 2)) for p in parts], distance)
        plans.append((cost, count, list(zip(parts, chosen))))
    return min(plans, key=lambda p: p[:2])[2]


def _flips(part: list[int], most: int) -> np.ndarray:
    flips = [0]
    for _ in range(most):
        flips = sorted({f ^ (1 << b) for f in flips for b in part} | set(flips))
    return np.array(flips, dtype=np.uint64)


def _probes(distinct: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """``mask, key, fp, own``: each fingerprint under its own key and its probes, per part with a threshold >= 0."""
    used = [(np.uint64(sum(1 << b for b in part)), _flips(part, t)) for part, t in plan if t >= 0]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for mask, flips in used:
                keys = ((fp & mask)[:, None] ^ flips[None, :]).ravel()
                yield pd.DataFrame(
                    {
                        "mask": np.full(len(keys), mask, dtype=np.uint64).view(np.int64),
                        "key": keys.view(np.int64),
                        "fp": np.repeat(fp, len(flips)).view(np.int64),
                        "own": np.tile(flips == 0, len(fp)),
                    }
                )

    return distinct.select("fp").mapInPandas(of, "mask long, key long, fp long, own boolean")


def _divide(buckets: DataFrame, distance: int) -> DataFrame:
    """Buckets over the limit, divided by the plain pigeonhole principle on the bits outside their mask."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mask, rows in batch.groupby("mask", sort=False):
                held = int(mask) & (2**BITS - 1)
                rest = [b for b in range(BITS) if not held >> b & 1]
                fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
                key = rows["key"].to_numpy(np.int64).view(np.uint64)
                for k in range(distance + 1):
                    more = sum(1 << b for b in rest[k :: distance + 1])
                    yield pd.DataFrame(
                        {
                            "mask": np.full(len(fp), held | more, dtype=np.uint64).view(np.int64),
                            "key": (key | (fp & np.uint64(more))).view(np.int64),
                            "fp": fp.view(np.int64),
                            "own": rows["own"].to_numpy(bool),
                        }
                    )

    return buckets.mapInPandas(of, "mask long, key long, fp long, own boolean")


def _stars(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Edges of a spanning star per component of the links ``a - b`` (indices into ``nodes``)."""
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    kept = label != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[kept].view(np.int64), "b": nodes[label[kept]].view(np.int64)})


def _links(rows: pd.DataFrame, distance: int) -> pd.DataFrame:
    """Spanning edges of the links inside the buckets of ``rows``, which lie together in order."""
    fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
    own = rows["own"].to_numpy(bool)
    new = (rows["mask"].diff().ne(0) | rows["key"].diff().ne(0)).to_numpy()
    bucket = np.cumsum(new)
    nodes, at = np.unique(fp, return_inverse=True)
    first, second = [], []
    active, step = np.arange(len(fp)), 0
    while len(active):
        step += 1
        active = active[active + step < len(fp)]
        active = active[bucket[active] == bucket[active + step]]
        near = np.bitwise_count(fp[active] ^ fp[active + step]) <= distance
        hit = active[near & (own[active] | own[active + step])]
        first.append(at[hit])
        second.append(at[hit + step])
    return _stars(nodes, np.concatenate([np.zeros(0, int), *first]), np.concatenate([np.zeros(0, int), *second]))


def _verified(buckets: DataFrame, distance: int) -> DataFrame:
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (rows["mask"] == rows["mask"].iloc[-1]) & (rows["key"] == rows["key"].iloc[-1])
            yield _links(rows[~last].reset_index(drop=True), distance)
            held = rows[last].reset_index(drop=True)
        if held is not None:
            yield _links(held, distance)

    return buckets.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInPandas(of, "a long, b long")


def fingerprint_links(distinct: DataFrame, stage: Staging, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Edges ``a, b`` that connect all distinct fingerprints within ``distance``, no pair of a group more than needed.

    Bits are grouped by correlation and the thresholds of the parts chosen by
    dynamic programming on candidate counts estimated from ``SAMPLE`` fingerprints;
    the sample steers only the cost, any choice finds every pair. A bucket with
    more than ``bucket`` rows is divided on its other bits, again and again: once
    all but ``log2(bucket)`` bits are fixed it cannot be larger. Each task returns
    spanning edges only.
    """
    rows = distinct.count()
    taken = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r["fp"] for r in taken], dtype=np.int64).view(np.uint64)
    if rows < 2:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a <> b")
    buckets = stage(_probes(distinct, probe_plan(sample, rows, distance)), "probes0")
    found = []
    for turn in range(1, BITS):
        sizes = buckets.groupBy("mask", "key").agg(F.count("*").alias("n"))
        over = stage(sizes.where(F.col("n") > bucket).select("mask", "key"), f"over{turn}")
        if over.isEmpty():
            found.append(_verified(buckets, distance))
            break
        found.append(_verified(buckets.join(over, ["mask", "key"], "left_anti"), distance))
        buckets = stage(_divide(buckets.join(over, ["mask", "key"], "left_semi"), distance), f"probes{turn}")
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def near_copies(
    docs: DataFrame, stage: Staging, shingle: int = SHINGLE, distance: int = DISTANCE, bucket: int = BUCKET
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``.

    Texts with equal fingerprints are one node; nodes within ``distance`` bits are
    linked, and ``component_id`` is the least doc_id that links reach. Null and
    empty texts have fingerprint 0 and link like any other. A null doc_id gets its
    component's least id, null if it has none. Repeated rows each come back. An
    empty table gives no rows. Other columns are ignored.
    """
    each = stage(fingerprints(docs, shingle), "fingerprints")
    distinct = stage(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = connected_components(fingerprint_links(distinct, stage, distance, bucket), stage)
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    )
    named = stage(named, "labels")
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    component = stage(named.join(least, "label").select("fp", "component_id"), "components")
    return each.join(component, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
