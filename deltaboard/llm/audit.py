"""Cheapest repair of the role order of conversations, by a persistent audit DP.

A conversation walks through four states: nothing yet, after a system turn, after
a user turn, after an assistant turn. Every row is kept, re-roled or deleted, and
turns may be inserted before it; an audit is the string of these edits. The DP
keeps the cheapest audit per state. Audits are nodes of a tree that share their
beginnings, with ancestors at powers of two and rolling hashes, so two audits of
the same cost are compared by a search for their longest common prefix; where the
hashes say that two beginnings are equal, the letters are compared as well.

Rows are laid out in order of conversation and turn and cut into runs of ``RUN``
rows. What one conversation has in one run is a segment; a segment is summed up
by the cheapest audit from each state to each state. As every audit of a segment
deals with the same rows and ends with a row's edit, no audit begins with another
whole one, so segments chain by cost and by the rank of their audits. A group of
``RUN`` segments is summed up like a segment, as often as needed: a conversation
of any length is repaired without ever being in one task. Only the two results
that are one value per conversation, its audit and the SHA-256 of its text, need
it in order: the audit is one string, and the text streams through one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaboard.session import Staging

RUN = 1024
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
OPENING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ENDS = (OPENING, ASSISTANT)
#: State after a turn with that role's initial.
AFTER = {OPENING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The only turn that may be inserted or re-roled to, per state.
NEXT = {OPENING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
BLANK, DUPLICATE, TRUNCATED, FINE = "b", "d", "t", "-"
BLANKS = r"\x20\x09-\x0D"

_BASE, _MODULUS = 1_000_003, (1 << 61) - 1


class Tape:
    """A tree of strings that share beginnings. Node 0 is the empty string."""

    def __init__(self, modulus: int = _MODULUS) -> None:
        self.modulus = modulus
        self.letter, self.depth, self.hash = [0], [0], [0]
        self.up: list[tuple[int, ...]] = [()]

    def add(self, node: int, letter: int) -> int:
        """The string of ``node`` with one more letter (a number from 1 on)."""
        ups, k = [node], 0
        while k < len(self.up[ups[k]]):
            ups.append(self.up[ups[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + letter) % self.modulus)
        self.up.append(tuple(ups))
        return len(self.letter) - 1

    def _lifted(self, node: int, depth: int) -> int:
        rest = self.depth[node] - depth
        for k in range(rest.bit_length()):
            if rest >> k & 1:
                node = self.up[node][k]
        return node

    def _apart(self, a: int, b: int) -> tuple[int, int] | None:
        """The first nodes of two equally long strings that differ in their letter, by walking; None if they are equal."""
        first = None
        while a != b:
            if self.letter[a] != self.letter[b]:
                first = a, b
            a, b = self.up[a][0], self.up[b][0]
        return first

    def less(self, a: int, b: int) -> bool:
        """Whether string ``a`` sorts before string ``b``; a beginning sorts before the whole."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self._lifted(a, depth), self._lifted(b, depth)
        if x == y or self.hash[x] == self.hash[y]:
            apart = self._apart(x, y)
            return self.depth[a] < self.depth[b] if apart is None else self.letter[apart[0]] < self.letter[apart[1]]
        for k in reversed(range(depth.bit_length())):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        # Beginnings before x and y have the same hash; a collision shows here.
        apart = self._apart(self.up[x][0], self.up[y][0]) or (x, y)
        return self.letter[apart[0]] < self.letter[apart[1]]

    def letters(self, node: int) -> list[int]:
        found = []
        while node:
            found.append(self.letter[node])
            node = self.up[node][0]
        return found[::-1]


Best = dict[int, tuple[int, int]]


def _offer(tape: Tape, best: Best, state: int, cost: int, node: int, letter: int) -> None:
    """Put ``node`` with ``letter`` into ``best`` if it is cheaper, or as cheap and first."""
    old = best.get(state)
    if old is not None and old[0] < cost:
        return
    made = tape.add(node, letter)
    if old is None or cost < old[0] or tape.less(made, old[1]):
        best[state] = cost, made


def _inserted(tape: Tape, best: Best) -> Best:
    """``best`` after at most two inserts; a third never pays, as the state was reached before."""
    out = dict(best)
    for state, (cost, node) in best.items():
        for _ in range(2):
            state, cost = NEXT[state], cost + COST[INSERT]
            node = tape.add(node, ord(INSERT))
            old = out.get(state)
            if old is None or cost < old[0] or (cost == old[0] and tape.less(node, old[1])):
                out[state] = cost, node
    return out


def _row(tape: Tape, best: Best, initial: str, fault: str) -> Best:
    """``best`` after inserts and the edit of one row."""
    out: Best = {}
    extra = TRUNCATED_COST * (fault == TRUNCATED)
    for state, (cost, node) in _inserted(tape, best).items():
        _offer(tape, out, state, cost + COST[DELETE], node, ord(DELETE))
        if fault not in (BLANK, DUPLICATE):
            if initial in AFTER[state]:
                _offer(tape, out, AFTER[state][initial], cost + COST[KEEP] + extra, node, ord(KEEP))
            _offer(tape, out, NEXT[state], cost + COST[REROLE] + extra, node, ord(REROLE))
    return out


def _text(letters: Iterable[int]) -> str:
    return "".join(map(chr, letters))


def segment_audits(initials: Sequence[str], faults: str, entries: Iterable[int], modulus: int = _MODULUS) -> dict[tuple[int, int], tuple[int, str]]:
    """Cost and audit of the cheapest way from each entry state to each state; every audit ends with a row's edit."""
    found = {}
    for entry in entries:
        tape = Tape(modulus)
        best: Best = {entry: (0, 0)}
        for initial, fault in zip(initials, faults):
            best = _row(tape, best, initial, fault)
        for state, (cost, node) in best.items():
            found[entry, state] = cost, _text(tape.letters(node))
    return found


def chained(parts: Sequence[dict[tuple[int, int], tuple[int, int]]], entries: Iterable[int]) -> dict[tuple[int, int], tuple[int, list[int], list[int]]]:
    """Cost, ranks and states of the cheapest way through ``parts``; a part gives cost and rank of each (from, to)."""
    found = {}
    for entry in entries:
        tape = Tape()
        best, path = {entry: (0, 0)}, {entry: [entry]}
        for part in parts:
            now: Best = {}
            ways: dict[int, list[int]] = {}
            for (here, there), (cost, rank) in sorted(part.items()):
                if here in best:
                    before = now.get(there)
                    _offer(tape, now, there, best[here][0] + cost, best[here][1], rank + 1)
                    if now[there] != before:
                        ways[there] = [*path[here], there]
            best, path = now, ways
        for state, (cost, node) in best.items():
            found[entry, state] = cost, tape.letters(node), path[state]
    return found


def _ranked(found: dict) -> list[dict]:
    """Ways of a segment or group as rows, with the rank of each audit among them."""
    order = {audit: k for k, audit in enumerate(sorted({way[1] if isinstance(way[1], str) else tuple(way[1]) for way in found.values()}))}
    rows = []
    for (here, there), way in found.items():
        text = way[1] if isinstance(way[1], str) else None
        rows.append({"here": here, "there": there, "cost": way[0], "rank": order[text if text is not None else tuple(way[1])], "audit": text})
    return rows


def finished(ways: Iterable[tuple[int, int, list[int]]]) -> tuple[int, int, int]:
    """``(cost, state, inserts)`` of the cheapest end; ``ways`` has state, cost and the order of the audit.

    Two inserts at the end lead back where one could have stopped, or from the
    opening to a turn that nobody asked for, so at most one is made.
    """
    ends = []
    for state, cost, order in ways:
        if state in ENDS:
            ends.append((cost, order, 0, state))
        elif NEXT[state] in ENDS:
            ends.append((cost + COST[INSERT], order, 1, state))
        else:
            ends.append((cost + 2 * COST[INSERT], order, 2, state))
    cost, _, inserts, state = min(ends)
    return cost, state, inserts


# -- rows ------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that crc32 of ``conv_id:turn`` picks; nulls count as one space there.

    Role and text are never null afterwards; a null id or turn stays.
    """
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hurt = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    times = F.when(F.col("_hurt") == 3, 2).otherwise(1)
    return (
        rows.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"), hurt.alias("_hurt"))
        .where("_hurt <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("_hurt") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("_hurt") == 1, "").when(F.col("_hurt") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.sequence(F.lit(1), times)).alias("_copy"),
        )
        .drop("_copy")
    )


def _fault(first: Column) -> Column:
    """First fault of a row: blank, duplicate, truncated, or none."""
    blank = ~F.col("text").rlike(f"[^{BLANKS}]")
    return (
        F.when(blank, BLANK)
        .when(~first, DUPLICATE)
        .when(~F.col("text").rlike(rf"[.!?][{BLANKS}]*\z"), TRUNCATED)
        .otherwise(FINE)
    )


def laid_out(rows: DataFrame, stage: Staging) -> tuple[DataFrame, DataFrame]:
    """The rows with an ``id``, and their order: id, conv_id, turn, initial, fault and place ``at``.

    Rows of a conversation stand by turn, nulls first, then by role and digest of
    the text; rows that are equal in all of it are interchangeable.
    """
    kept = stage(rows.withColumn("id", F.monotonically_increasing_id()), "rows")
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text"), 256)
    slim = kept.select("id", "conv_id", "turn", "role", key.alias("digest"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "id")
    firsts = slim.groupBy("conv_id", "digest").agg(F.min(order).alias("_first")).select(F.col("_first.id").alias("first_id"))
    flagged = (
        kept.join(firsts, kept["id"] == firsts["first_id"], "left")
        .select("id", "conv_id", "turn", "role", F.substring("role", 1, 1).alias("initial"), key.alias("digest"), _fault(F.col("first_id").isNotNull()).alias("fault"))
    )
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "id"]
    placed = flagged.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = placed.select("id", "conv_id", "turn", "initial", "fault", F.monotonically_increasing_id().alias("at"))
    return kept, stage(placed, "order")


# -- segments ----------------------------------------------------------------

_WAY = "array<struct<here:int,there:int,cost:bigint,rank:int,audit:string>>"
_SUM = (
    "conv_id bigint, at bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "low bigint, high bigint, turns bigint, first_turn bigint, last_turn bigint, first_initial string, last_initial string"
)
SEGMENT = f"{_SUM}, initials array<string>, ways {_WAY}"
_PAIRS = ("su", "ua", "au")


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    way = pa.struct([("here", pa.int32()), ("there", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("audit", pa.string())])
    kinds[_WAY] = pa.list_(way)
    fields = re.findall(r"(\w+) (array<struct<[^>]*>>|array<string>|\w+)(?:, |$)", schema)
    return pa.schema([(name, kinds[kind]) for name, kind in fields])


def _joined(parts: Sequence[dict]) -> dict:
    """Counts of neighbouring segments of one conversation."""
    out = {c: sum(p[c] for p in parts) for c in ("n", "blank", "duplicate", "truncated", "illegal", "turns")}
    for x, y in zip(parts, parts[1:]):
        out["illegal"] += x["last_initial"] + y["first_initial"] not in _PAIRS
        out["turns"] -= x["last_turn"] is not None and x["last_turn"] == y["first_turn"]
    low = [p["low"] for p in parts if p["low"] is not None]
    high = [p["high"] for p in parts if p["high"] is not None]
    return out | {
        "conv_id": parts[0]["conv_id"], "at": parts[0]["at"], "low": min(low, default=None), "high": max(high, default=None),
        "first_turn": parts[0]["first_turn"], "last_turn": parts[-1]["last_turn"],
        "first_initial": parts[0]["first_initial"], "last_initial": parts[-1]["last_initial"],
    }


def _segments(run: pa.Table) -> pa.Table:
    """One run of the order cut into segments; only the first may go on from the run before."""
    rows = sorted(run.select(["at", "conv_id", "turn", "initial", "fault"]).to_pylist(), key=lambda r: r["at"])
    out, start = [], 0
    for end in range(1, len(rows) + 1):
        if end < len(rows) and rows[end]["conv_id"] == rows[start]["conv_id"]:
            continue
        part = rows[start:end]
        one = [
            {
                "conv_id": r["conv_id"], "at": r["at"], "n": 1, "blank": r["fault"] == BLANK, "duplicate": r["fault"] == DUPLICATE,
                "truncated": r["fault"] == TRUNCATED, "illegal": 0, "turns": r["turn"] is not None, "low": r["turn"],
                "high": r["turn"], "first_turn": r["turn"], "last_turn": r["turn"], "first_initial": r["initial"],
                "last_initial": r["initial"],
            }
            for r in part
        ]
        initials = [r["initial"] for r in part]
        ways = segment_audits(initials, "".join(r["fault"] for r in part), STATES if start == 0 else [OPENING])
        out.append(_joined(one) | {"initials": initials, "ways": _ranked(ways)})
        start = end
    return pa.Table.from_pylist(out, schema=_arrow(SEGMENT))


def _parts(rows: Sequence[dict]) -> list[dict]:
    return [{(w["here"], w["there"]): (w["cost"], w["rank"]) for w in r["ways"]} for r in rows]


def _folded(group: pa.Table) -> pa.Table:
    """The segments of one conversation in one group, summed up as one."""
    rows = sorted(group.select(_arrow(_SUM).names + ["ways"]).to_pylist(), key=lambda r: r["at"])
    ways = chained(_parts(rows), sorted({w["here"] for w in rows[0]["ways"]}))
    out = _joined(rows) | {"ways": _ranked(ways)}
    return pa.Table.from_pylist([out], schema=_arrow(f"{_SUM}, ways {_WAY}"))


def _unfolded(group: pa.Table) -> pa.Table:
    """The way through each segment of a group whose ends are known."""
    rows = sorted(group.select(["at", "ways", "here", "there"]).to_pylist(), key=lambda r: r["at"])
    _, _, path = chained(_parts(rows), [rows[0]["here"]])[rows[0]["here"], rows[0]["there"]]
    found = [{"of": r["at"], "way_here": x, "way_there": y} for r, x, y in zip(rows, path, path[1:])]
    return pa.Table.from_pylist(found, schema=pa.schema([("of", pa.int64()), ("way_here", pa.int64()), ("way_there", pa.int64())]))


_END = "of bigint, here bigint, there bigint, inserts bigint, cost bigint"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int64()) for n in ("of", "here", "there", "inserts", "cost")])
    for batch in batches:
        out = []
        for at, ways in zip(batch.column("at").to_pylist(), batch.column("ways").to_pylist()):
            cost, state, inserts = finished((w["there"], w["cost"], w["rank"]) for w in ways if w["here"] == OPENING)
            out.append({"of": at, "here": OPENING, "there": state, "inserts": inserts, "cost": cost})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def repaired_roles(audit: str, initials: Sequence[str], entry: int) -> list[tuple[list[str], str | None, bool]]:
    """Per row: roles inserted before it, the role it is given (None: its own), whether it stays.

    Inserts after the last row make an item of their own that has no row.
    """
    out, before, state, rows = [], [], entry, iter(initials)
    for edit in audit:
        if edit == INSERT:
            state = NEXT[state]
            before.append(NAMES[state])
            continue
        initial, role = next(rows), None
        if edit == KEEP:
            state = AFTER[state][initial]
        elif edit == REROLE:
            state = NEXT[state]
            role = NAMES[state]
        out.append((before, role, edit != DELETE))
        before = []
    if before:
        out.append((before, None, False))
    return out


_EDIT = "conv_id bigint, place bigint, before string, new_role string, stays boolean"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What happens at each place; the edit after the last row has the place after it, less a half: places are doubled."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("before", pa.string()), ("new_role", pa.string()), ("stays", pa.bool_())])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            for k, (before, role, stays) in enumerate(repaired_roles(row["audit"], row["initials"], row["here"])):
                place = 2 * (row["at"] + k) - (k == len(row["initials"]))
                text = "\n".join(f"{name}:" for name in before) if before else None
                out.append({"conv_id": row["conv_id"], "place": place, "before": text, "new_role": role, "stays": stays})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each conversation, which come in order; only its state is held."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    of, digest, first = None, None, True
    for batch in batches:
        done = []
        for conv_id, line in zip(batch.column("conv_id").to_pylist(), batch.column("line")):
            if digest is None or conv_id != of:
                if digest is not None:
                    done.append({"conv_id": of, "repaired_sha256": digest.hexdigest()})
                of, digest, first = conv_id, hashlib.sha256(), True
            digest.update((b"" if first else b"\n") + line.as_py().encode())
            first = False
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": of, "repaired_sha256": digest.hexdigest()}], schema=schema)


_NOTHING = hashlib.sha256().hexdigest()


def repair(rows: DataFrame, stage: Staging, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """``(report, lines)`` of conversations ``(conv_id, turn, role, text)`` whose role and text are not null.

    The report has one row per conversation: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256. The lines are the repaired
    conversations: conv_id, place (their order), line (``role:text``; inserted
    turns that stand together are one row of several lines).

    A null conv_id is a conversation of its own. A role that is empty or begins
    with another letter can't be kept. Other columns are not read; repeated rows
    are duplicates of the first.
    """
    kept, order = laid_out(rows, stage)
    cut = order.select((F.floor(F.col("at") / run)).cast("bigint").alias("run"), "at", "conv_id", "turn", "initial", "fault")
    segments = stage(cut.groupBy("run").applyInArrow(_segments, SEGMENT), "segments0")

    # Most conversations are one segment; the others go up and down the groups.
    many = segments.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("many_id"))
    among = F.col("conv_id").eqNullSafe(F.col("many_id"))
    single, names = segments.join(many, among, "left_anti"), _arrow(_SUM).names

    # Up: sum up groups of segments until each conversation has one left.
    levels, width = [stage(segments.join(many, among, "left_semi"), "parts")], run
    while levels[-1].count() > levels[-1].select("conv_id").distinct().count():
        width *= run
        now = levels[-1].select(*names, "ways", F.floor(F.col("at") / width).cast("bigint").alias("group"))
        levels.append(stage(now.groupBy("conv_id", "group").applyInArrow(_folded, f"{_SUM}, ways {_WAY}"), f"segments{len(levels)}"))
        if width > 1 << 62:
            break
    whole = single.select(*names, "ways").unionByName(levels[-1].select(*names, "ways"))
    ends = stage(whole.select("at", "ways").mapInArrow(_ends, _END), "ends")

    # Down: from the ends of a group to the ends of the segments in it.
    ways = ends.select("of", "here", "there")
    for depth in range(len(levels) - 1, 0, -1):
        scale = run ** (depth + 1)
        inside = levels[depth - 1].select("conv_id", "at", "ways", F.floor(F.col("at") / scale).cast("bigint").alias("group"))
        known = levels[depth].select("conv_id", F.floor(F.col("at") / scale).cast("bigint").alias("group"), F.col("at").alias("of")).join(ways, "of")
        known = known.withColumnsRenamed({"conv_id": "known_id", "group": "known_group"}).drop("of")
        same = F.col("conv_id").eqNullSafe(F.col("known_id")) & (F.col("group") == F.col("known_group"))
        met = inside.join(known, same).select("conv_id", "group", "at", "ways", "here", "there")
        ways = met.groupBy("conv_id", "group").applyInArrow(_unfolded, "of bigint, way_here bigint, way_there bigint")
        ways = stage(ways.toDF("of", "here", "there"), f"ways{depth}")

    if len(levels) > 1:
        ways = ways.unionByName(single.select(F.col("at").alias("of")).join(ends.select("of", "here", "there"), "of"))

    # The last segment of a conversation takes the inserts at its end.
    last = segments.groupBy("conv_id").agg(F.max("at").alias("last_at")).withColumnRenamed("conv_id", "last_id")
    tops = whole.select("conv_id", F.col("at").alias("of")).join(ends.select("of", "inserts"), "of")
    tails = tops.join(last, tops["conv_id"].eqNullSafe(last["last_id"])).select("last_at", "inserts")
    chosen = F.filter("ways", lambda w: (w["here"] == F.col("h")) & (w["there"] == F.col("t")))[0]["audit"]
    audits = stage(
        segments.join(ways.toDF("of", "h", "t"), F.col("at") == F.col("of"))
        .join(tails, F.col("at") == F.col("last_at"), "left")
        .select(
            "conv_id", "at", "initials", F.col("h").alias("here"),
            F.concat(chosen, F.repeat(F.lit(INSERT), F.coalesce("inserts", F.lit(0)).cast("int"))).alias("audit"),
        ),
        "audits",
    )

    edits = audits.mapInArrow(_edits, _EDIT)
    texts = order.select("id", (F.col("at") * 2).alias("place")).join(kept.select("id", "role", "text"), "id").drop("id")
    own = F.when(F.col("stays"), F.concat_ws(":", F.coalesce("new_role", "role"), "text"))
    lines = (
        edits.join(texts, "place", "left")
        .select("conv_id", "place", F.when(F.col("before").isNotNull() & own.isNotNull(), F.concat_ws("\n", "before", own)).otherwise(F.coalesce("before", own)).alias("line"))
        .where("line IS NOT NULL")
    )
    lines = stage(lines, "lines")
    hashed = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_hashes, "conv_id bigint, repaired_sha256 string")

    string = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "audit"))), lambda s: s["audit"]), "")
    strings = audits.groupBy("conv_id").agg(string.alias("audit"))
    totals = whole.join(ends.select("of", "cost"), F.col("at") == F.col("of")).select(
        "conv_id", F.coalesce(F.expr("high - low + 1 - turns"), F.lit(0)).cast("bigint").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost",
    )
    return _with(_with(totals, strings), hashed).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(_NOTHING))), lines


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on conv_id that takes null ids for equal."""
    right = right.withColumnRenamed("conv_id", "_id")
    return left.join(right, left["conv_id"].eqNullSafe(right["_id"]), "left").drop("_id")


def repair_damaged(conversations: DataFrame, stage: Staging, run: int = RUN) -> DataFrame:
    """The report of ``repair`` on damaged conversations, with every original conv_id.

    A conversation that lost all its rows has zeros, an empty audit and the hash
    of the empty string. See ``damaged`` and ``repair`` for nulls and odd rows.
    """
    report, _ = repair(damaged(conversations), stage, run)
    ids = conversations.select("conv_id").distinct()
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return (
        _with(ids, report)
        .withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(_NOTHING))})
        .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    )
