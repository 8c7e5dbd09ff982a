"""Sampled SentencePiece segmentations without replacement, and decoding.

Every segmentation of a text has a perturbed score: its log-probability plus a
Gumbel variable. The k segmentations with the greatest perturbed scores are k
distinct samples without replacement. They are found best first: a heap holds
disjoint sets of segmentations, each with the greatest perturbed score inside it,
which is again Gumbel distributed around the log of the set's total probability.
That log is known exactly from the backward sums of the lattice, so the search
never expands a set that does not win. The winning set gives the segmentation that
attains its maximum, and what is left of the set goes back onto the heap: all
segmentations that first leave the winner's path somewhere behind the place where
the set begins.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
SAMPLES = 2
RUN_CHARS = 250_000
#: Letters of new segments that are laid out at once; a segment is never cut.
LAID_CHARS = 1 << 16
#: States after which the graph of a task is trimmed; segments that come again before are laid out once.
KEPT_STATES = 500_000
BYTE_COST = 14.0
BUCKET_BITS = 20
SAMPLED = "doc_id long, sample int, ids array<int>, n_ids long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, decoded boolean"
_SAMPLES = pa.schema([
    ("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int64()),
    ("ids_crc32", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()),
    ("decoded", pa.bool_()),
])
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
U = np.uint64
ALL = 2**64 - 1
SPREAD = 0xBF58476D1CE4E5B9


class Pieces:
    """The pieces of a model with a unigram weight each, and a table of their beginnings by hash."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model = model
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        first = int(self.bytes.max()) + 1
        size = model.get_piece_size()
        # The pieces are listed by merit: a Zipf law over their place is the unigram model.
        weights = 1.0 / (np.maximum(np.arange(size) - first, 0) + 1)
        self.weights = weights / weights[first:].sum()
        self.content = [b""] * size
        begins: dict[str, int] = {}
        for number in range(size):
            if model.is_byte(number) or model.is_control(number) or model.is_unknown(number) or model.is_unused(number):
                continue
            piece = model.id_to_piece(number)
            self.content[number] = piece.replace(SPACE, " ").encode()
            begins[piece] = number
            for end in range(1, len(piece)):
                begins.setdefault(piece[:end], -1)
        for value, number in enumerate(self.bytes):
            self.content[number] = bytes([value])
        self.sizes = np.array(list(map(len, self.content)), dtype=np.int32)
        self.content = np.array(self.content, dtype=object)
        self.longest = max(map(len, begins))
        hashes = np.array([self._hash(b) for b in begins], dtype=U) * U(SPREAD)
        order = np.argsort(hashes)
        self.numbers = np.append(np.array(list(begins.values()), dtype=np.int32)[order], np.int32(-1))
        # Keys lie in buckets by their first bits, few in each; the last key is greater than all looked for but itself.
        self.keys = np.append(hashes[order], U(ALL))
        sizes = np.bincount((self.keys[:-1] >> U(64 - BUCKET_BITS)).astype(np.int64), minlength=1 << BUCKET_BITS)
        self.bucket = (np.cumsum(sizes) - sizes).astype(np.int32)

    @staticmethod
    def _hash(text: str) -> int:
        value = 0
        for c in text:
            value = (value * 0x9E3779B97F4A7C15 + ord(c) + 1) & ALL
        return value

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the beginnings with these hashes stand, and which of the hashes are known."""
        spread = hashes * U(SPREAD)
        at = self.bucket[(spread >> U(64 - BUCKET_BITS)).view(np.int64)]
        found = self.keys[at]
        behind = np.nonzero(found < spread)[0]
        while len(behind):
            at[behind] += 1
            found[behind] = self.keys[at[behind]]
            behind = behind[found[behind] < spread[behind]]
        return at, found == spread

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of the ids: the space that encoding puts first is taken off, bytes are read as UTF-8."""
        return self.decode_all(np.asarray(ids, dtype=np.int64), [0, len(ids)])[0]

    def decode_all(self, ids: np.ndarray, cuts: list[int]) -> list[str]:
        """The text of the ids between each two cuts."""
        data = b"".join(self.content[ids].tolist())
        lies = np.append(0, np.cumsum(self.sizes[ids]))[cuts].tolist()
        return [data[a + (data[a : a + 1] == b" " and a < b) : b].decode("utf-8", "replace") for a, b in zip(lies, lies[1:])]


def _cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of the texts as they are encoded, where their segments begin, and how many segments each text has.

    A text that is not empty gets a space first. The segments are those of the pattern.
    """
    codes = np.frombuffer("".join([" " + t if t else "" for t in texts]).encode("utf-32-le", "surrogatepass"), dtype="<i4")
    space, end = (codes == 32) | (codes == ord(SPACE)), codes == 10
    codes = np.where(space, np.int32(ord(SPACE)), codes)
    first = end.copy()
    first[1:] |= end[:-1] | (space[1:] & ~space[:-1])
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    sizes += sizes > 0
    behind = np.cumsum(sizes)
    first[(behind - sizes)[sizes > 0]] = True
    begins = np.nonzero(first)[0].astype(np.int32)
    return codes, begins, np.diff(np.searchsorted(begins, behind), prepend=0)


def _segments(text: str) -> list[str]:
    """The segments of one text."""
    codes, begins, _ = _cut([text])
    letters = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [letters[a:b] for a, b in zip(begins.tolist(), [*begins.tolist()[1:], len(letters)])]


class _Grown:
    """An array that grows at its end."""

    def __init__(self, dtype: type, first: list = ()):
        self.room, self.used = np.empty(1 << 14, dtype=dtype), 0
        self.add(np.array(first, dtype=dtype))

    def add(self, values: np.ndarray) -> np.ndarray:
        """The whole array, with the values behind what it had."""
        end = self.used + len(values)
        if end > len(self.room):
            room = np.empty(max(end, 2 * len(self.room)), dtype=self.room.dtype)
            room[: self.used] = self.room[: self.used]
            self.room = room
        self.room[self.used : end] = values
        self.used = end
        return self.whole

    def set(self, values: np.ndarray) -> np.ndarray:
        self.used = 0
        return self.add(values)

    @property
    def whole(self) -> np.ndarray:
        return self.room[: self.used]


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its size, one range after the other."""
    ends = np.cumsum(sizes, dtype=np.int32)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(begins - (ends - sizes), sizes)


def _digests(codes: np.ndarray, places: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A hash of each segment; ``places`` are those of the letters in their segments."""
    powers = np.cumprod(np.full(int(places.max()) + 1, SPREAD, dtype=U))
    return _mixed(np.add.reduceat((codes.astype(U) + U(1)) * powers[places], begins))


class Lattices:
    """Lattices of all segments of some texts, laid out as one graph.

    No piece of the model goes on past a letter with a space mark, and none has a
    line end, so segments cut there are independent. A state is a place in a segment;
    its arcs are the pieces that begin there, with their shares of all that may
    follow. A character without a piece is one arc with its bytes. Arcs are found and
    summed for all new states at once, longer and longer pieces, and nearer and nearer
    to the begin of their segments.

    ``add`` takes further texts into the graph, and only their new segments are laid
    out. No number of an arc but those of states depends on what else is in the graph.
    """

    def __init__(self, pieces: Pieces, texts: list[str] = ()):
        self.pieces = pieces
        self.digests, self.numbers = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int32)  # of the segments, by digest
        self.all_begins, self.all_sizes, self.all_codes = _Grown(np.int32), _Grown(np.int32), _Grown(np.int32)
        self.all_at, self.all_uses = _Grown(np.int32, [0]), _Grown(np.int32)
        self.all_ids, self.all_to = _Grown(np.int32), _Grown(np.int32)
        self.all_share, self.all_low = _Grown(np.float64), _Grown(np.float64)
        self._lay(*[np.zeros(0, dtype=np.int32)] * 3)
        self.add(texts)

    def add(self, texts: list[str]) -> None:
        """``starts`` are then the first states of the segments of these texts."""
        codes, begins, parts = _cut(texts)
        numbers = self._numbered(codes, begins)
        self.starts = np.split(self.all_begins.whole[numbers], np.cumsum(parts)[:-1]) if texts else []

    def _numbered(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The numbers of the segments that begin there; those not yet in the graph are laid out."""
        if not len(begins):
            return begins
        sizes = np.diff(begins, append=np.int32(len(codes)))
        letters = np.arange(len(codes), dtype=np.int32)
        digests = _digests(codes, letters - np.repeat(begins, sizes), begins)
        order = np.argsort(digests)
        ranked = digests[order]
        first = np.append(True, ranked[1:] != ranked[:-1])
        distinct, of = ranked[first], order[first]
        at = np.searchsorted(self.digests, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = np.nonzero(at < len(self.digests))[0]
        known[inside] = self.digests[at[inside]] == distinct[inside]
        named = np.empty(len(distinct), dtype=np.int32)
        named[known] = self.numbers[at[known]]
        fresh = np.nonzero(~known)[0]
        # In turn, so that what laying out takes for a while is bounded however many segments are new.
        turns = np.nonzero(np.diff((np.cumsum(sizes[of[fresh]]) - 1) // LAID_CHARS))[0] + 1
        for part in np.split(fresh, turns):
            named[part] = self._lay(codes, begins[of[part]], sizes[of[part]])
        self.all_uses.whole[named] += 1
        self.digests, self.numbers = np.insert(self.digests, at[fresh], distinct[fresh]), np.insert(self.numbers, at[fresh], named[fresh])
        numbers = np.empty(len(begins), dtype=np.int32)
        numbers[order] = named[np.cumsum(first) - 1]
        # Segments that only share a digest with the one of that number are laid out by themselves.
        other = self.all_sizes.whole[numbers] != sizes
        lies = letters + np.repeat(self.all_begins.whole[numbers] - begins, sizes)
        other |= np.logical_or.reduceat(self.all_codes.whole[np.minimum(lies, self.all_codes.used - 1)] != codes, begins)
        if other.any():
            numbers[other] = self._lay(codes, begins[other], sizes[other])
        return numbers

    @property
    def logs(self) -> np.ndarray:
        return self.logs_of(slice(None))

    def logs_of(self, arcs: np.ndarray | slice) -> np.ndarray:
        """The log of the share of each of these arcs in all that may follow its state."""
        return np.log(np.maximum(self.share[arcs], 1e-300))

    def rest_of(self, arcs: np.ndarray) -> np.ndarray:
        """The log of what is left of all that may follow the states of these arcs without the arcs."""
        left = 1.0 - self.share[arcs]
        rest = np.log(np.maximum(left, 1e-300))
        rest[left < 1e-15] = -np.inf
        return rest

    def _lay(self, codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Adds these segments to the graph, and gives their numbers."""
        first, arcs = self.all_at.used - 1, self.all_ids.used
        ends = np.cumsum(sizes, dtype=np.int32)
        codes = codes[_ranges(begins, sizes)]
        stop = np.repeat(ends, sizes)
        self.all_begins.add(ends - sizes + np.int32(first))
        self.all_sizes.add(sizes)
        self.all_uses.add(np.zeros(len(sizes), dtype=np.int32))
        self.all_codes.add(codes)
        counts, ids, to, weight = self._arcs(codes, stop)
        share, low = _shares(counts, to, weight, stop)
        self.at = self.all_at.add(np.cumsum(counts, dtype=np.int32) + np.int32(arcs))
        self.ids, self.to = self.all_ids.add(ids), self.all_to.add(np.where(to >= 0, to + np.int32(first), np.int32(-1)))
        self.share, self.low = self.all_share.add(share), self.all_low.add(low)
        return np.arange(self.all_sizes.used - len(sizes), self.all_sizes.used, dtype=np.int32)

    def trim(self, most: int) -> None:
        """Leaves only the segments that more than one ``add`` had, or none if those have more than ``most`` states."""
        kept = np.nonzero(self.all_uses.whole > 1)[0]
        if self.all_sizes.whole[kept].sum() > most:
            kept = kept[:0]
        sizes, begins = self.all_sizes.whole[kept], self.all_begins.whole[kept]
        first, last = self.at[begins], self.at[begins + sizes]
        states, arcs = _ranges(begins, sizes), _ranges(first, last - first)
        moved = np.cumsum(sizes, dtype=np.int32) - sizes
        counts, to = np.diff(self.at)[states], self.to[arcs]
        to = np.where(to >= 0, to + np.repeat(moved - begins, last - first), np.int32(-1))
        place = np.full(self.all_sizes.used, -1, dtype=np.int32)
        place[kept] = np.arange(len(kept), dtype=np.int32)
        numbers = place[self.numbers]
        self.digests, self.numbers = self.digests[numbers >= 0], numbers[numbers >= 0]
        self.all_codes.set(self.all_codes.whole[states])
        self.all_begins.set(moved)
        self.all_sizes.set(sizes)
        # One more use keeps them the next time.
        self.all_uses.set(np.ones(len(kept), dtype=np.int32))
        self.at = self.all_at.set(np.append(np.int32(0), np.cumsum(counts, dtype=np.int32)))
        self.ids, self.to = self.all_ids.set(self.ids[arcs]), self.all_to.set(to)
        self.share, self.low = self.all_share.set(self.share[arcs]), self.all_low.set(self.low[arcs])

    def _arcs(self, codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How many arcs each state has, and what the arcs of one state after the other carry, where they lead, and weigh."""
        pieces, n = self.pieces, len(codes)
        alive = np.arange(n, dtype=np.int32)
        hashes, left = np.zeros(n, dtype=U), stop - alive
        terms = (codes + 1).astype(U)
        found = []
        counts = np.zeros(n, dtype=np.int32)
        for size in range(1, pieces.longest + 1):
            if size > 1:
                inside = np.nonzero(left >= size)[0]
                alive, hashes, left = alive[inside], hashes[inside], left[inside]
            if not len(alive):
                break
            hashes = hashes * U(0x9E3779B97F4A7C15) + (terms[alive + (size - 1)] if size > 1 else terms)
            at, known = pieces.places(hashes)
            known = np.nonzero(known)[0]
            alive, hashes, left = alive[known], hashes[known], left[known]
            numbers = pieces.numbers[at[known]]
            whole = np.nonzero(numbers >= 0)[0]
            begin, ids = alive[whole], numbers[whole]
            if size == 1:
                bare = np.ones(n, dtype=bool)
                bare[begin] = False
                bare = np.nonzero(bare)[0].astype(np.int32)
                begin, ids = np.concatenate([begin, bare]), np.concatenate([ids, -1 - codes[bare]])
            # A state has one arc of a size at most, so its shorter arcs so far say which of its arcs this is.
            found.append((begin, begin + np.int32(size), ids, counts[begin]))
            counts[begin] += 1
        ends = np.cumsum(counts, dtype=np.int32)
        firsts, total = ends - counts, int(counts.sum())
        ids, to = np.empty(total, dtype=np.int32), np.empty(total, dtype=np.int32)
        for begin, end, of, which in found:
            place = firsts[begin] + which
            ids[place], to[place] = of, np.where(end < stop[begin], end, np.int32(-1))
        weight = pieces.weights[np.maximum(ids, 0)]
        bare = np.nonzero(ids < 0)[0]
        lengths = 1 + (ids[bare] < -128) + (ids[bare] < -2048) + (ids[bare] < -65536)
        weight[bare] = np.exp(-BYTE_COST * lengths)
        return counts, ids, to, weight

    @property
    def edges(self) -> np.ndarray:
        """The running share of the arcs of each state, plus the number of the state."""
        up = np.append(self.low[1:], 0.0)
        up[self.at[1:] - 1] = 1.0
        return up + np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def drawn(self, states: np.ndarray, fractions: np.ndarray) -> np.ndarray:
        """The arc of each state whose running share is the first above the fraction."""
        # The longest pieces come last and are the likeliest. The share before a state's first arc is 0.
        low, arcs = self.low, self.at[1:][states] - 1
        behind = np.nonzero(low[arcs] > fractions)[0]
        while len(behind):
            of = arcs[behind] - 1
            arcs[behind] = of
            behind = behind[low[of] > fractions[behind]]
        return arcs

    def ids_of(self, arcs: np.ndarray) -> np.ndarray:
        return self.ids_between(arcs, [0, len(arcs)])[0]

    def ids_between(self, arcs: np.ndarray, cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the arcs, and where they are cut if the arcs are cut there."""
        found = self.ids[arcs]
        bare = np.nonzero(found < 0)[0]
        if not len(bare):
            return found, np.array(cuts)
        codes = -1 - found[bare]
        sizes = np.ones(len(found), dtype=np.int64)
        sizes[bare] += (codes >= 1 << 7).astype(np.int64) + (codes >= 1 << 11) + (codes >= 1 << 16)
        data = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        spread = np.repeat(found, sizes)
        spread[spread < 0] = self.pieces.bytes[np.frombuffer(data, dtype=np.uint8)]
        return spread, np.append(0, np.cumsum(sizes))[cuts]


def _shares(counts: np.ndarray, to: np.ndarray, weight: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The share of each arc in all that may follow its state, and the shares before."""
    n = len(stop)
    if not n:
        return np.zeros(0), np.zeros(0)
    mass = np.zeros(n + 1)  # log of the sum over all that may follow; the last stands for an end
    depth = stop - np.arange(n, dtype=np.int32)
    # Short numbers sort by their digits.
    states = np.argsort(depth.astype(np.uint16) if depth.max() < 1 << 16 else depth, kind="stable").astype(np.int32)
    cuts = np.concatenate([[0], np.cumsum(np.bincount(depth))[1:]])
    begins = np.cumsum(counts, dtype=np.int32) - counts
    sizes = counts[states]
    ends = np.cumsum(sizes, dtype=np.int32)
    firsts = ends - sizes
    order = _ranges(begins[states], sizes)
    to, weight = to[order], weight[order]
    nexts = np.where(depth[states] > 1, states + 1, n)
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if low == high:
            continue
        arcs = slice(firsts[low], ends[high - 1])
        base = mass[nexts[low:high]]
        weight[arcs] *= np.exp(mass[to[arcs]] - np.repeat(base, sizes[low:high]))
        mass[states[low:high]] = base + np.log(np.add.reduceat(weight[arcs], firsts[low:high] - firsts[low]))
    shares = np.empty(len(weight))
    shares[order] = weight
    shares /= np.repeat(np.add.reduceat(shares, begins), counts)
    shares[begins[counts == 1]] = 1.0
    # Summed within each state alone, so that they do not depend on where it lies.
    before = np.zeros(len(shares))
    more = begins[counts > 1]
    many = counts[counts > 1]
    k = 1
    while len(more):
        before[more + k] = before[more + (k - 1)] + shares[more + (k - 1)]
        k += 1
        more, many = more[many > k], many[many > k]
    return shares, np.minimum(before, 1.0, out=before)


@functools.lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> U(30))) * U(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> U(27))) * U(0x94D049BB133111EB)
    return values ^ (values >> U(31))


def _fraction(keys: np.ndarray) -> np.ndarray:
    return ((_mixed(keys) >> U(11)).astype(np.float64) + 0.5) / 2.0**53


def _mixed_one(value: int) -> int:
    """``_mixed`` of one number."""
    value = ((value ^ (value >> 30)) * SPREAD) & ALL
    value = ((value ^ (value >> 27)) * 0x94D049BB133111EB) & ALL
    return value ^ (value >> 31)


def _key(seed: int, draw: int) -> int:
    return _mixed_one((seed + draw * 0x9E3779B97F4A7C15) & ALL)


def uniform(seed: int, draw: int, use: int) -> float:
    """A number in (0, 1) that depends only on the row's seed, the sample and what it is used for."""
    mixed = _mixed_one((_key(seed, draw) + (use + (1 << 40)) * 0x2545F4914F6CDD1D) & ALL)
    return ((mixed >> 11) + 0.5) / 2.0**53


class Path:
    """One segmentation: its arcs in order, their segment, and their log-probabilities."""

    def __init__(self, graph: Lattices, arcs: np.ndarray, places: np.ndarray, since: int = 0):
        self.arcs, self.places, self.since = arcs, places, since
        self.before = np.concatenate([[0.0], np.cumsum(graph.logs_of(arcs))])
        self.total = float(self.before[-1])
        self.banned: dict[int, set[int]] = {}
        # The log of what leaves the path at each arc from the one after those that are given.
        self.chance = self.before[since:-1] + graph.rest_of(arcs[since:])


def walk(graph: Lattices, requests: list[tuple[np.ndarray, np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Draws arcs from each state until its segment ends, for many ``(states, places, key)`` at once.

    The draws of a state depend only on the key and its place, not on what is drawn
    along with it. Returns ``(arcs, places)`` in text order per request.
    """
    to = graph.to
    sizes = np.array([len(r[0]) for r in requests])
    states = np.concatenate([r[0] for r in requests])
    places = np.concatenate([r[1] for r in requests])
    keys = np.repeat(np.array([r[2] for r in requests], dtype=U), sizes) + places.astype(U) * U(0xD1342543DE82EF95)
    keys, of = _mixed(keys), np.arange(len(states), dtype=np.int32)
    drawn, owners, counts = [], [], np.zeros(len(states), dtype=np.int32)
    while len(states):
        arcs = graph.drawn(states, _fraction(keys + U(len(drawn) * 0x2545F4914F6CDD1D & ALL)))
        drawn.append(arcs)
        owners.append(of)
        counts[of] += 1
        states = to[arcs]
        go = np.nonzero(states >= 0)[0]
        states, keys, of = states[go], keys[go], of[go]
    ends = np.cumsum(counts)
    firsts, found = ends - counts, np.empty(int(counts.sum()), dtype=np.int32)
    for step, (arcs, of) in enumerate(zip(drawn, owners)):
        found[firsts[of] + step] = arcs
    lies = np.repeat(places, counts)
    cuts = np.append(0, ends)[np.append(0, np.cumsum(sizes))].tolist()
    return [(found[a:b], lies[a:b]) for a, b in zip(cuts, cuts[1:])]


def sample(graph: Lattices, starts: np.ndarray, seed: int, samples: int):
    """Distinct segmentations by falling perturbed score, and the next score (minus infinity if there is none).

    A generator: it yields the walks it needs, is sent their results, and returns
    the segmentations, so the walks of many texts are drawn together.
    """
    at, to = graph.at, graph.to
    found: list[tuple[Path, float]] = []
    # A set: all completions of a path's first ``since`` arcs but those that begin with a banned arc.
    tie = 0
    heap: list[tuple] = [(math.log(-math.log(uniform(seed, 0, 0))), tie, None, None)]
    while heap:
        key, _, parent, ways = heapq.heappop(heap)
        score, draw = -key, len(found) + 1
        if len(found) == samples:
            return found, score
        if parent is None:
            arcs, places = yield starts, np.arange(len(starts)), _key(seed, draw)
            path = Path(graph, arcs, places)
        else:
            # The place where this sample leaves its parent, by the share of what leaves there.
            running = np.cumsum(ways)
            turn = int(np.searchsorted(running, uniform(seed, draw, 1) * running[-1], side="right"))
            turn = parent.since + min(turn, len(ways) - 1)
            state = bisect.bisect_right(at, parent.arcs[turn]) - 1
            gone = parent.banned.setdefault(turn, {int(parent.arcs[turn])})
            others = [a for a in range(at[state], at[state + 1]) if a not in gone]
            shares = np.exp(graph.logs_of(others))
            running = np.cumsum(shares)
            arc = others[min(int(np.searchsorted(running, uniform(seed, draw, 2) * running[-1], side="right")), len(others) - 1)]
            gone.add(arc)
            left = sum(math.exp(x) for a, x in zip(others, graph.logs_of(others)) if a != arc)
            parent.chance[turn - parent.since] = -math.inf if left < 1e-15 else parent.before[turn] + math.log(left)
            place = int(parent.places[turn])
            here = 1 if to[arc] >= 0 else 0
            states = np.concatenate([np.full(here, to[arc]), starts[place + 1 :]])
            arcs, places = yield states, np.arange(place + 1 - here, len(starts)), _key(seed, draw)
            arcs = np.concatenate([parent.arcs[:turn], [arc], arcs])
            path = Path(graph, arcs, np.concatenate([parent.places[:turn], [place], places]), turn + 1)
        found.append((path, score))
        for of in (path,) if parent is None else (path, parent):
            chance = of.chance
            top = chance.max() if len(chance) else -np.inf
            if top == -np.inf:
                continue
            ways = np.exp(chance - top)
            # The greatest score of what is left, given that it is below the one just found.
            tie += 1
            own = top + math.log(ways.sum()) - math.log(-math.log(uniform(seed, draw, 2 + tie)))
            heapq.heappush(heap, (np.logaddexp(-own, -score), tie, of, ways))
    return found, -math.inf


def sample_all(graph: Lattices, seeds: list[int], samples: int) -> list:
    """``sample`` for all texts of the graph, in step."""
    starts = graph.starts
    results: list = [None] * len(starts)
    runs = {k: sample(graph, s, seed, samples) for k, (s, seed) in enumerate(zip(starts, seeds))}
    answers: dict[int, object] = dict.fromkeys(runs)
    while answers:
        wanted = {}
        for k, answer in answers.items():
            try:
                wanted[k] = runs[k].send(answer)
            except StopIteration as done:
                results[k] = done.value
        answers = dict(zip(wanted, walk(graph, list(wanted.values())))) if wanted else {}
    return results


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """The ids and texts of rows in their order, closed after ``RUN_CHARS`` letters; only one run is held as strings."""
    for batch in batches:
        docs, texts, size = [], [], 0
        for row in range(batch.num_rows):
            docs.append(batch.column(0)[row].as_py())
            texts.append(batch.column(1)[row].as_py() or "")
            size += len(texts[-1])
            if size >= RUN_CHARS:
                yield docs, texts
                docs, texts, size = [], [], 0
        if docs:
            yield docs, texts


def encode_samples(docs: DataFrame, model: str, samples: int = SAMPLES, seed: int = 0) -> DataFrame:
    """Up to ``samples`` distinct segmentations of every whole text of ``docs(doc_id, text)``.

    Result: ``doc_id, sample`` (from 0), ``ids`` (array of int), ``n_ids, ids_crc32``
    (little-endian unsigned 32-bit), ``log_prob``, ``perturbed`` (the score it was
    chosen by), ``log_inclusion`` (log of the probability of being among the samples,
    given the score of the first one left out; 0 if none is left), ``decoded``
    (whether the ids decode to the text exactly).

    All random numbers come from ``seed`` and the row's doc_id, so a repeated task
    gives the same rows; repeated rows get the same samples. A null doc_id draws as
    id -1. A null text is empty; an empty text has one segmentation, without ids. A
    text with fewer segmentations than ``samples`` gives all of them. Texts with the
    space mark U+2581 itself cannot be decoded exactly, and say so. An empty table
    gives no rows. Other columns are ignored.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        graph = Lattices(pieces)
        for docs_of, texts in _runs(batches):
            seeds = [_mixed_one(((-1 if doc is None else doc) ^ seed) & ALL) for doc in docs_of]
            if len(graph.at) > KEPT_STATES:
                graph.trim(KEPT_STATES // 2)
            graph.add(texts)
            found = sample_all(graph, seeds, samples)
            paths = [path for of, _ in found for path, _ in of]
            cuts = np.cumsum([0] + [len(path.arcs) for path in paths])
            ids, cuts = graph.ids_between(np.concatenate([path.arcs for path in paths]), cuts)
            lies, data = cuts.tolist(), ids.astype("<u4").tobytes()
            decoded, rows = iter(pieces.decode_all(ids, lies)), []
            for doc, text, (of, below) in zip(docs_of, texts, found):
                for k, (path, score) in enumerate(of):
                    low, high = lies[len(rows)], lies[len(rows) + 1]
                    gap = path.total - below
                    inclusion = 0.0 if below == -math.inf else (gap if gap < -30 else math.log(-math.expm1(-math.exp(min(gap, 700.0)))))
                    rows.append((doc, k, high - low, zlib.crc32(data[4 * low : 4 * high]), path.total, score, inclusion, next(decoded) == text))
            cells = [pa.array(c, f.type) for c, f in zip(zip(*rows), [f for f in _SAMPLES if f.name != "ids"])]
            cells.insert(_SAMPLES.get_field_index("ids"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays(cells, schema=_SAMPLES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, SAMPLED)


def decode_samples(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, sample, text`` of rows as ``encode_samples`` makes them; null ids give a null text."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(model)
        for batch in batches:
            texts = [None if ids is None else pieces.decode(ids) for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "sample": batch["sample"], "text": texts})

    return encoded.select("doc_id", "sample", "ids").mapInPandas(decode, "doc_id long, sample int, text string")
