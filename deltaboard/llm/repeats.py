"""Removes bytes of strings that occur earlier in the corpus, by longest-previous-factor arrays.

Equal strings of ``length`` bytes have equal minimizers (the least hash of their
short substrings), so only strings around one minimizer are ever compared:

1. each text gives its minimizers with the run of string starts they stand for and
   a digest of the bytes of the run (its region);
2. regions equal to an earlier one are removed whole. Within a batch of texts this
   is done at once, so a passage of many documents is sent on once per batch;
3. where a minimizer has several different regions, the first of each is cut by how
   far its strings start before the minimizer. Strings of one part have a middle in
   common (its core), so parts meet by their core, and one that meets no other has
   nothing earlier. A suffix array over those that meet finds the strings they share:
   its longest-previous-factor array tells which starts have an earlier match. A core
   with very many parts is handled in blocks, and what no block could match is
   compared by digest across blocks;
4. the spans of each document are united and cut from its text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaboard.session import Staging

LENGTH = 100
GRAM = 24
CHUNK_BITS = 20
#: Starts of a part of a region; its strings share all but this many bytes.
PART = 26
#: Regions that are cut at once.
RUNS = 10_000
#: Parts of one core in a suffix array.
BLOCK = 8192
NULL_ID = -(2**63)
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
PLACE = U((1 << CHUNK_BITS) - 1)
#: An odd number above the parts of a region.
SLOTS = 0x2545F4914F6CDD1D


@functools.lru_cache(maxsize=4)
def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, dtype=U)
    steps[0] = 1
    return np.cumprod(steps, dtype=U)


@functools.lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**64, 256, dtype=U)


def _gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash of every substring of ``gram`` values, by doubling."""
    found, size, h = None, 0, values
    step, power = 1, BASE
    while True:
        if gram & step:
            if found is None:
                found, size = h, step
            else:
                n = len(values) - size - step + 1
                found = h[:n] * U(pow(int(BASE), size, 2**64)) + found[step : step + n]
                size += step
        if 2 * step > gram:
            break
        h = h[:-step] * power + h[step:]
        power, step = power * power, 2 * step
    mixed = (found ^ (found >> U(31))) * U(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> U(29))


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    step, least = 1, keys
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = width - step
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def minimizers(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Arrays ``hash, digest, lo, hi``: string starts ``lo..hi`` share the leftmost minimizer with this hash."""
    parts = []
    chunk = (1 << CHUNK_BITS) - length
    for begin in range(0, len(data) - length + 1, chunk):
        part = np.frombuffer(data, dtype=np.uint8, count=min(chunk + length - 1, len(data) - begin), offset=begin)
        values = _byte_values()[part]
        hashes = _gram_hashes(values, gram)
        keys = (hashes & ~PLACE) | np.arange(len(hashes), dtype=U)
        least = _window_min(keys, length - gram + 1)
        lo = np.concatenate([[0], np.nonzero(least[1:] != least[:-1])[0] + 1])
        hi = np.concatenate([lo[1:] - 1, [len(least) - 1]])
        room = 1 << max(12, int(len(values)).bit_length())
        sums = np.concatenate([[U(0)], np.cumsum(values * _powers(int(BASE), room)[: len(values)], dtype=U)])
        digest = (sums[hi + length] - sums[lo]) * _powers(int(INVERSE), room)[lo]
        parts.append((hashes[(least[lo] & PLACE).astype(np.int64)], digest, lo + begin, hi + begin))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(U), none.astype(U), none, none
    return tuple(np.concatenate(x) for x in zip(*parts))


def longest_previous_factors(symbols: np.ndarray, limit: int) -> np.ndarray:
    """For each position the longest match, up to ``limit``, with an earlier position.

    The suffix array comes from rank doubling to ``limit``. The previous and the
    next smaller position in suffix order are reached by jumping over larger ones,
    and carry the least common prefix on the way.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    level = symbols.astype(np.int64) - int(symbols.min())
    base = int(level.max()) + 1
    levels, size = [level], 1

    def joined(gap: int) -> tuple[np.ndarray, int]:
        """The last level with itself ``gap`` further on, and what is above all its numbers; ranks only if they must be short."""
        level, most = levels[-1], base
        if most * (most + 1) >= 1 << 62:
            values, level = np.unique(level, return_inverse=True)
            most, levels[-1] = len(values), level
        behind = np.zeros(n, dtype=np.int64)
        behind[: n - gap] = level[gap:] + 1
        return level * np.int64(most + 1) + behind, most * (most + 1)

    while 2 * size <= limit and size < n:
        level, base = joined(size)
        levels.append(level)
        size *= 2
    full = levels[-1] if limit <= size or n <= size else joined(limit - size)[0]
    order = np.argsort(full, kind="stable")
    # Common prefixes of neighbours in suffix order, by the ranks of falling sizes.
    common = np.zeros(n, dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        for _ in range(2 if k == len(levels) - 1 else 1):
            inside = (a < n) & (b < n)
            same = np.zeros(n - 1, dtype=bool)
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            same &= np.maximum(a, b) + (1 << k) <= n
            a[same] += 1 << k
            b[same] += 1 << k
    common[1:] = np.minimum(a - order[:-1], limit)
    best = np.zeros(n, dtype=np.int64)
    for turned in (False, True):
        places = order[::-1] if turned else order
        least = np.concatenate([[0], common[1:][::-1]]) if turned else common.copy()
        smaller = np.arange(n) - 1
        while True:
            over = np.nonzero((smaller >= 0) & (places[smaller] > places))[0]
            over = over[least[over] > 0]
            if not len(over):
                break
            via = smaller[over]
            least[over] = np.minimum(least[over], least[via])
            smaller[over] = smaller[via]
        least[(smaller < 0) | (places[smaller] > places)] = 0
        best[places] = np.maximum(best[places], least)
    return best


SPANS = "id long, mark int, lo long, hi long"
ANCHORS = "m long, digest long, id long, mark int, lo long, hi long"


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(U).view(np.int64)


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """Minimizers of all texts; ``m`` is null for runs that repeat an earlier one of the same batch."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for doc, mark, text in zip(batch["id"], batch["mark"], batch["text"]):
                found = minimizers(text.encode("utf-8", "surrogatepass"), length)
                n = len(found[0])
                for column, value in zip(columns, (found[0], found[1], np.full(n, doc), np.full(n, mark), found[2], found[3])):
                    column.append(value)
            if not columns[0]:
                continue
            m, digest, doc, mark, lo, hi = (np.concatenate(c) for c in columns)
            order = np.lexsort((lo, mark, doc, digest, m))
            m, digest, doc, mark, lo, hi = (c[order] for c in (m, digest, doc, mark, lo, hi))
            new = np.ones(len(m), dtype=bool)
            new[1:] = (m[1:] != m[:-1]) | (digest[1:] != digest[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))
            again = (doc != doc[first]) | (mark != mark[first]) | (lo != lo[first])
            frame = pd.DataFrame(
                {"m": pd.array(_signed(m), dtype="Int64"), "digest": _signed(digest), "id": doc.astype(np.int64), "mark": mark.astype(np.int32), "lo": lo, "hi": hi}
            )
            yield frame[~again]
            spans = frame[again].sort_values(["id", "mark", "lo"])
            # Touching runs of a document become one span.
            fresh = (spans["id"].diff() != 0) | (spans["mark"].diff() != 0) | (spans["lo"] > spans["hi"].shift() + length)
            whole = spans.groupby(fresh.cumsum()).agg(id=("id", "first"), mark=("mark", "first"), lo=("lo", "min"), hi=("hi", "max"))
            yield whole.assign(m=pd.array([None] * len(whole), dtype="Int64"), digest=0)

    return texts.mapInPandas(of, ANCHORS)


def _compared(anchors: DataFrame) -> DataFrame:
    """Streams the runs of each minimizer in order: later equal runs are spans (``block`` -1), and the first of
    each different run is kept (``block`` 0) where the minimizer has several."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kinds, first = None, 0, None  # minimizer, different runs so far, its first row while it is alone
        digest, place = None, np.zeros(3, dtype=np.int64)  # the digest so far and where it came first
        for batch in batches:
            m, d = batch["m"].to_numpy(np.int64), batch["digest"].to_numpy(np.int64)
            where = batch[["id", "mark", "lo"]].to_numpy(np.int64)
            new_m = np.concatenate([[m[0] != last], m[1:] != m[:-1]])
            new_d = new_m | np.concatenate([[d[0] != digest], d[1:] != d[:-1]])
            begin = np.maximum.accumulate(np.where(new_d, np.arange(len(m)), -1))
            begun = where[begin]
            begun[begin < 0] = place
            later = (where != begun).any(axis=1)  # a repeated row is not later than itself
            group = np.cumsum(new_m)
            kind = np.cumsum(new_d)
            at = np.nonzero(new_m)[0]
            base = np.zeros(group[-1] + 1, dtype=np.int64)
            base[0] = -kinds
            base[group[at]] = kind[at] - 1
            number = kind - base[group] - 1  # which different run of its minimizer, from 0
            many = np.zeros(group[-1] + 1, dtype=bool)
            many[group[number > 0]] = True
            reps = new_d & many[group]
            if first is not None and many[0]:
                yield first.assign(block=0)
            alone = new_d & ~many[group] & (group == group[-1])
            if alone.any():
                first = batch[alone]
            elif group[-1] > 0 or many[0]:
                first = None
            yield batch[~new_d & later].assign(block=-1)
            yield batch[reps].assign(block=0)
            last, digest, kinds, place = m[-1], d[-1], int(number[-1]) + 1, begun[-1]

    ordered = anchors.repartition("m").sortWithinPartitions("m", "digest", "id", "mark", "lo")
    return ordered.mapInPandas(of, ANCHORS + ", block int")


def _parts(runs: list[tuple[int, int, int, bytes]], length: int, gram: int = GRAM, part: int = PART) -> tuple[np.ndarray, ...]:
    """Arrays ``key, run, lo, hi`` of the parts of ``(m, lo, hi, bytes)``: by how far, in steps of ``part``, their
    strings start before the minimizer, which all of a part have in the same place of their core."""
    m = np.array([r[0] for r in runs], dtype=np.int64).view(U)
    lo, hi = (np.array([r[k] for r in runs], dtype=np.int64) for k in (1, 2))
    data = np.frombuffer(b"".join([r[3] for r in runs]), dtype=np.uint8)
    values = _byte_values()[data]
    sizes = hi - lo + length
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # The minimizer is the first place with its hash in all strings of the run.
    count = lo - hi + length - gram + 1
    run = np.repeat(np.arange(len(runs)), count)
    place = np.arange(len(run)) + np.repeat(starts + hi - lo - (np.cumsum(count) - count), count)
    here = np.nonzero(_gram_hashes(values, gram)[place] == m[run])[0]
    at = np.zeros(len(runs), dtype=np.int64)
    at[run[here][::-1]] = place[here][::-1]
    nearest, furthest = at - (starts + hi - lo), at - starts
    step = nearest // part
    number = furthest // part - step + 1
    run = np.repeat(np.arange(len(runs)), number)
    step = np.arange(len(run)) + np.repeat(step - (np.cumsum(number) - number), number)
    begin = at[run] - step * part
    end = begin + length - part + 1
    room = 1 << int(len(values) + 1).bit_length()
    sums = np.concatenate([[U(0)], np.cumsum(values * _powers(int(BASE), room)[: len(values)], dtype=U)])
    core = (sums[end] - sums[begin]) * _powers(int(INVERSE), room)[begin]
    key = core * U(SLOTS) + step.astype(U)
    first = at[run] - np.minimum(furthest[run], step * part + part - 1)
    last = at[run] - np.maximum(nearest[run], step * part)
    shift = (lo - starts)[run]
    return key, run, first + shift, last + shift


def _regions(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the parts of each wanted run: ``key, id, mark, lo, hi, bytes``."""

    def cut(found: list[tuple], docs: list[tuple]) -> pd.DataFrame:
        key, run, lo, hi = _parts(found, length)
        places = zip(run.tolist(), lo.tolist(), hi.tolist())
        data = [found[k][3][begin - found[k][1] : end - found[k][1] + length] for k, begin, end in places]
        owners = np.array(docs, dtype=np.int64)[run]
        mark = owners[:, 1].astype(np.int32)
        return pd.DataFrame({"key": _signed(key), "id": owners[:, 0], "mark": mark, "lo": lo, "hi": hi, "bytes": data})

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, docs = [], []
        for batch in batches:
            for doc, mark, packed, runs in zip(batch["id"], batch["mark"], batch["packed"], batch["runs"]):
                data = zstandard.ZstdDecompressor().decompress(packed)
                for run in runs:
                    found.append((run["m"], run["lo"], run["hi"], data[run["lo"] : run["hi"] + length]))
                    docs.append((doc, mark))
                    if len(found) == RUNS:
                        yield cut(found, docs)
                        found, docs = [], []
        if found:
            yield cut(found, docs)

    runs = wanted.groupBy("id", "mark").agg(F.collect_list(F.struct("m", "lo", "hi")).alias("runs"))
    return texts.join(runs, ["id", "mark"]).mapInPandas(of, "key long, id long, mark int, lo long, hi long, bytes binary")


def _matched(regions: DataFrame, length: int) -> DataFrame:
    """Spans found by the suffix arrays of the cores; for cores in several blocks also the digests of the strings not found."""

    def block(rows: pd.DataFrame, shared: bool) -> pd.DataFrame:
        rows = rows.drop_duplicates(["key", "id", "mark", "lo"]).sort_values(["id", "mark", "lo"], kind="stable")
        sizes = (rows["hi"] - rows["lo"]).to_numpy(np.int64) + length
        ends = np.cumsum(sizes + 1)
        starts = ends - sizes - 1
        symbols = np.empty(ends[-1], dtype=np.int64)
        inside = np.ones(ends[-1], dtype=bool)
        inside[ends - 1] = False
        symbols[inside] = np.frombuffer(b"".join(rows["bytes"]), dtype=np.uint8)
        symbols[ends - 1] = 256 + np.arange(len(rows))  # an end of its own, equal to no other
        factors = longest_previous_factors(symbols, length)
        counts = sizes - length + 1
        row = np.repeat(np.arange(len(rows)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        doc, mark = rows["id"].to_numpy(np.int64)[row], rows["mark"].to_numpy(np.int32)[row]
        lo = rows["lo"].to_numpy(np.int64)[row] + offset
        found = factors[starts[row] + offset] >= length
        one = np.full(len(found), "", dtype=object)
        if shared:
            data = rows["bytes"].to_numpy()
            for k in np.nonzero(~found)[0]:
                one[k] = hashlib.blake2b(data[row[k]][offset[k] : offset[k] + length], digest_size=16).hexdigest()
        # Neighbouring starts found in one region are one run.
        fresh = np.ones(len(found), dtype=bool)
        fresh[1:] = ~(found[1:] & found[:-1] & (row[1:] == row[:-1]))
        first = np.nonzero(fresh)[0]
        last = np.append(first[1:], len(found)) - 1
        kept = found[first] | shared
        first, last = first[kept], last[kept]
        return pd.DataFrame({"id": doc[first], "mark": mark[first], "lo": lo[first], "hi": lo[last], "string": one[first]})

    def whole(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Cores that are in one block, about a megabyte of their parts at once."""
        rows = rows[rows["key"].duplicated(keep=False)]
        if not len(rows):
            return
        key = rows["key"].to_numpy(np.int64)
        new = np.append(True, key[1:] != key[:-1])
        sizes = (rows["hi"] - rows["lo"]).to_numpy(np.int64) + length
        before = np.cumsum(sizes) - sizes
        turn = np.maximum.accumulate(np.where(new, before, 0)) >> 20
        for _, part in rows.groupby(turn):
            yield block(part, False)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        cut = None  # the core that more than one block holds
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if cut is not None:
                of_cut = (rows["key"] == cut).to_numpy()
                if not of_cut.all():
                    if of_cut.any():
                        yield block(rows[of_cut], True)
                    rows, cut = rows[~of_cut], None
            last = (rows["key"] == rows["key"].iloc[-1]).to_numpy()
            held = rows[last]
            yield from whole(rows[~last])
            while len(held) > BLOCK:
                cut = held["key"].iloc[0]
                yield block(held[:BLOCK], True)
                held = held[BLOCK:]
        if held is not None:
            if cut is not None:
                yield block(held, True)
            else:
                yield from whole(held)

    return (
        regions.repartition("key")
        .sortWithinPartitions("key")
        .mapInPandas(of, SPANS + ", string string")
    )


def _cut(texts: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """Per document the spans it loses and what is left of it."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, packed, runs in zip(batch["doc_id"], batch["packed"], batch["runs"]):
                data = zstandard.ZstdDecompressor().decompress(packed)
                united: list[list[int]] = []
                for run in sorted((r["lo"], r["hi"] + length) for r in runs) if runs is not None else []:
                    if united and run[0] <= united[-1][1]:
                        united[-1][1] = max(united[-1][1], run[1])
                    else:
                        united.append(list(run))
                kept, at = [], 0
                for begin, end in united:
                    kept.append(data[at:begin])
                    at = end
                left = b"".join([*kept, data[at:]])
                rows.append((doc, len(data), len(data) - len(left), len(united), hashlib.sha256(left).hexdigest(), left, united))
            found = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])
            yield found.astype({"doc_id": "Int64"})

    runs = spans.groupBy("id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    joined = texts.join(runs, ["id", "mark"], "left").select("doc_id", "packed", "runs")
    return joined.mapInPandas(
        of,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<long>>",
    )


def remove_repeats(docs: DataFrame, stage: Staging, length: int = LENGTH) -> DataFrame:
    """Cuts from ``docs(doc_id, text)`` each byte of a string of ``length`` bytes that also starts earlier.

    Earlier is a smaller doc_id, or an earlier start in the document. Strings are
    judged on the input. Result: ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, kept`` (bytes) and ``spans``, one row per row of ``docs``.

    A null text is empty. A null doc_id comes before all others. Rows that share a
    doc_id come in the order of a hash of their texts; rows equal in both are one
    document and get the same result. Texts under ``length`` bytes lose nothing. An
    empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.hash("text").alias("mark"), text.alias("text")
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [packer.compress(t.encode("utf-8", "surrogatepass")) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "id": batch["id"], "mark": batch["mark"], "packed": packed})

    # Compressed texts: they are shuffled twice.
    texts = base.mapInPandas(pack, "doc_id long, id long, mark int, packed binary")
    anchors = stage(_anchors(base.where(F.octet_length("text") >= length).drop("doc_id"), length), "anchors")
    compared = stage(_compared(anchors.where("m is not null")), "compared")
    matched = stage(_matched(_regions(texts, compared.where("block = 0"), length), length), "matched")
    open_strings = matched.where("string <> ''")
    first = open_strings.groupBy("string").agg(F.min(F.struct("id", "mark", "lo")).alias("first"))
    across = open_strings.join(first, "string").where(F.struct("id", "mark", "lo") > F.col("first"))
    names = ["id", "mark", "lo", "hi"]
    spans = (
        anchors.where("m is null").select(*names)
        .unionByName(compared.where("block = -1").select(*names))
        .unionByName(matched.where("string = ''").select(*names))
        .unionByName(across.select(*names))
    )
    return _cut(texts, spans, length)
