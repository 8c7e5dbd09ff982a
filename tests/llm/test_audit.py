"""Conversation repair against plain strings, every possible audit, and a model of the whole query."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from deltaboard.llm import audit, queries
from deltaboard.llm.audit import Tape, repair, repair_damaged, segment_audits

ROWS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 5, 2])
def test_tape_compares_like_strings(modulus):
    """Also where most hashes collide: then the letters decide."""
    draw = random.Random(modulus)
    tape, texts = Tape(modulus), {0: ""}
    for _ in range(600):
        node = draw.choice(list(texts)[-40:] if draw.random() < 0.7 else list(texts))
        letter = draw.choice("DIKR") if draw.random() < 0.4 else "K"
        texts[tape.add(node, ord(letter))] = texts[node] + letter
    nodes = list(texts)
    for _ in range(4000):
        a, b = draw.choice(nodes), draw.choice(nodes)
        assert tape.less(a, b) == (texts[a] < texts[b])
    assert all("".join(map(chr, tape.letters(n))) == t for n, t in texts.items())


def every_audit(initials, faults):
    """(cost, audit) of every audit with at most two inserts in a row."""
    best = None
    for edits in itertools.product("DKR", repeat=len(initials)):
        if any(f in "bd" and e != "D" for e, f in zip(edits, faults)):
            continue
        for gaps in itertools.product(range(3), repeat=len(initials) + 1):
            kept = [i for i, e in enumerate(edits) if e != "D"]
            base = 3 * edits.count("D") + 2 * edits.count("R") + sum(faults[i] == "t" for i in kept) + 2 * sum(gaps)
            text = "".join("I" * g + e for g, e in itertools.zip_longest(gaps, edits, fillvalue=""))
            if best is not None and (base, text) >= best:
                continue
            free = [i for i, c in enumerate(text) if c in "IR"]
            rows = iter(initials)
            shape = []
            for c in text:
                row = next(rows) if c in "DKR" else None
                shape.append("?" if c in "IR" else row if c == "K" else "")
            for given in itertools.product("ua", repeat=len(free)):
                roles = list(shape)
                for i, g in zip(free, given):
                    roles[i] = g
                if LEGAL.fullmatch("".join(roles)):
                    best = base, text
                    break
    return best


def strings(initials, faults):
    """The same DP with whole strings."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    turn = {0: 2, 1: 2, 2: 3, 3: 2}
    grow = lambda best: functools.reduce(
        lambda out, kv: out | {kv[0]: min(out.get(kv[0], kv[1]), kv[1])},
        [(s2, (c + 2 * k, t + "I" * k)) for s, (c, t) in best.items() for k, s2 in ((0, s), (1, turn[s]), (2, turn[turn[s]]))], {},
    )
    best = {0: (0, "")}
    for initial, fault in zip(initials, faults):
        out = {}
        for s, (c, t) in grow(best).items():
            ways = [(s, c + 3, t + "D")]
            if fault not in "bd":
                ways.append((turn[s], c + 2 + (fault == "t"), t + "R"))
                if initial in after[s]:
                    ways.append((after[s][initial], c + (fault == "t"), t + "K"))
            for s2, c2, t2 in ways:
                out[s2] = min(out.get(s2, (c2, t2)), (c2, t2))
        best = out
    return min(v for s, v in grow(best).items() if s in (0, 3))


def shown(initials, faults):
    ways = segment_audits(initials, faults, [0])
    cost, state, inserts = audit.finished((there, c, text) for (_, there), (c, text) in ways.items())
    return cost, ways[0, state][1] + "I" * inserts


def test_against_every_audit():
    for n in range(4):
        for initials in itertools.product("suax", repeat=n):
            for faults in itertools.product("-td", repeat=n):
                assert shown(initials, "".join(faults)) == every_audit(initials, "".join(faults))


def test_long_conversations_against_strings():
    draw = random.Random(1)
    for _ in range(60):
        n = draw.randint(1, 120)
        initials, faults = [draw.choice("suaua ") for _ in range(n)], "".join(draw.choice("---tbd") for _ in range(n))
        assert shown(initials, faults) == strings(initials, faults)


def model(rows):
    """conv_id -> what the contract asks for, from the original rows."""
    out = {}
    for conv_id in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in (r for r in rows if r[0] == conv_id):
            role, text = " " if role is None else role, " " if text is None else text
            hurt = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if hurt:
                role = "user" if hurt == 4 else role
                text = "" if hurt == 1 else re.sub("[.!?]", "", text) if hurt == 2 else text
                kept += [(turn, role, text)] * (2 if hurt == 3 else 1)
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))
        faults, seen = "", set()
        for _, role, text in kept:
            bare = text.strip(BLANK)
            faults += "b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t"
            seen.add((role, text))
        turns = {t for t, _, _ in kept if t is not None}
        initials = [r[1][:1] for r in kept]
        cost, edits = strings(initials, faults)
        state, lines, rest = 0, [], iter(kept)
        for e in edits:
            row = next(rest) if e in "DKR" else None
            if e == "D":
                continue
            state = {"s": 1, "u": 2, "a": 3}[row[1][0]] if e == "K" else 3 if state == 2 else 2
            name = "assistant" if state == 3 else "user"
            lines.append(f"{row[1] if e == 'K' else name}:{row[2] if row else ''}")
        out[conv_id] = (
            conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])), cost, edits,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return sorted(map(str, out.values()))


def random_conversations(seed, conversations):
    draw = random.Random(seed)
    rows = []
    for c in conversations:
        for turn in range(draw.choice([1, 2, 5, 9, 40])):
            if draw.random() < 0.9:
                text = draw.choice(["Hello.", "ok", "", " \t", None, "Why?  \n", "é \U0001f600!", "x" * 3000, "Hello."])
                rows.append((c, draw.choice([turn, turn, turn, None, 3]), draw.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool"]), text))
    return rows + rows[:3]


@pytest.mark.parametrize("run", [2, 7, 1024])
def test_query_against_the_model(spark, stage, run):
    """Runs of two rows, so that conversations span many runs and groups of runs; nulls, ties, repeated rows, other columns."""
    rows = random_conversations(11, [*range(12), None])
    extra = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{ROWS}, at string, id int").select("id", "at", "conv_id", "turn", "role", "text")
    got = repair_damaged(extra, stage, run)
    assert sorted(str(tuple(r)) for r in got.collect()) == model(rows)


def test_lines(spark, stage):
    rows = [(1, 1, "assistant", "Hi."), (1, 2, "user", "Go."), (2, 1, "user", "Q?"), (3, 1, "assistant", "A."), (3, 2, "assistant", "B.")]
    report, lines = repair(spark.createDataFrame(rows, ROWS), stage, 2)
    # Two re-roled rows cost as much as two inserts, which come first.
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in report.collect()} == {1: (4, "IKKI"), 2: (2, "KI"), 3: (2, "RK")}
    got = [(r["conv_id"], r["line"]) for r in lines.orderBy("conv_id", "place").collect()]
    assert got == [
        (1, "user:\nassistant:Hi."), (1, "user:Go."), (1, "assistant:"), (2, "user:Q?"), (2, "assistant:"), (3, "user:A."), (3, "assistant:B."),
    ]


def test_whole_table_against_the_model(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(str(tuple(r)) for r in queries.op12_conversations(spark, folder).collect()) == model(rows)


def test_empty(spark, stage):
    assert repair_damaged(spark.createDataFrame([], ROWS), stage).count() == 0
