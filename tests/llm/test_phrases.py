"""Phrase mining against counting every phrase in a dictionary."""

import collections
import random
import re

import duckdb
import pytest

from deltaboard.llm import oracles, queries
from deltaboard.llm.phrases import collocations, phrase_counts

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", lower)]


def brute(rows, least, top):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, seen in counts.items():
        good = {p: a for p, a in seen.items() if len(p) > 1 and a >= least}
        found = []
        for phrase, a in good.items():
            inside = any(
                len(q) > len(phrase) and 100 * b >= 80 * a and any(q[i : i + len(phrase)] == phrase for i in range(len(q)))
                for q, b in good.items()
            )
            if not inside:
                cuts = [(2_000_000 * a // (seen[phrase[:k]] + seen[phrase[k:]]), k) for k in range(1, len(phrase))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(phrase).encode(), seen[phrase[:k]], seen[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], start=1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def random_rows(seed):
    draw = random.Random(seed)
    words = ["the", "The", "of", "été", "x-1", "漢字", "a", "b", "\x1c", "'"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ".\n", "\r", "\x0b", "!"]
    rows = []
    for _ in range(80):
        n = draw.choice([0, 1, 2, 30, 120])
        rows.append((draw.choice(["en", "de", None, ""]), "".join(draw.choice(words[: draw.choice([3, 10])]) + draw.choice(gaps) for _ in range(n))))
    rows += [("en", None), (None, None), ("en", ""), ("en", " \t\n. "), ("en", "same same same same same " * 40)]
    return rows + [rows[0]] * 3


@pytest.mark.parametrize(("chunk", "limit"), [(100, 0), (300_000, 32 << 20)])
def test_against_brute_force(spark, stage, chunk, limit):
    """Chunks of one document and of all; shuffled and broadcast joins; ties, repeated rows, nulls, other columns."""
    rows = random_rows(3)
    docs = spark.createDataFrame([(i, t, lang, "s", i, 7, 8) for i, (lang, t) in enumerate(rows)], "id long, text string, lang string, source string, local long, a long, b long")
    got = collocations(docs, stage, least=5, top=25, chunk=chunk, broadcast_bytes=limit)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 25)


def test_a_piece_ends_a_phrase(spark, stage):
    docs = spark.createDataFrame([("a b. a b", "en"), ("a b", "en"), ("a", "en"), ("b", "en")], "text string, lang string")
    totals, tables = phrase_counts(docs, stage, least=1)
    assert [tuple(r) for r in totals.collect()] == [("en", 8)]
    assert [t.count() for t in tables] == [2, 1, 0, 0]
    assert tables[1].head()["f"] == 3


def test_empty(spark, stage):
    assert collocations(spark.createDataFrame([], "text string, lang string"), stage).count() == 0
    assert collocations(spark.createDataFrame([(None, None)], "text string, lang string"), stage, least=1).count() == 0


def test_twin(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    twin = con.execute(oracles.all_sql()["op13_phrases"]).fetchall()
    got = queries.op13_phrases(spark, folder)
    assert sorted(tuple(r) for r in got.collect()) == sorted(twin)


class _Keeps:
    """A stage that drops nothing and knows its tables by name."""

    def __init__(self, stage):
        self.stage, self.tables = stage, {}

    def __call__(self, df, name, **options):
        self.tables[name] = self.stage(df, name, **options)
        return self.tables[name]

    def drop(self, name):
        pass


def test_a_row_holds_one_phrase(spark, stage):
    """However many phrases a chunk has, no reader or writer holds them at once; more rows than one batch."""
    n, made = 70_000, _Keeps(stage)
    words = [f"w{i}" for i in range(n)]
    docs = spark.createDataFrame([(" ".join(words), "en"), ("w0 w1. w0", "en")], "text string, lang string").coalesce(1)
    totals, tables = phrase_counts(docs, made, least=1, longest=3)
    assert [t.count() for t in tables] == [n, n - 1, n - 2]
    for length in (1, 2, 3):
        relation = made.tables.get(f"occurrences{length}")
        assert [k for k, kind in relation.dtypes if kind.startswith("array")] == ["items"]
        rows = relation.where("items IS NULL").selectExpr("block * 256 + place AS local", "c").collect()
        assert sorted(r["local"] for r in rows) == list(range(n - length + 1))
        items = relation.where("items IS NOT NULL").head()["items"]
        assert collections.Counter(x for x in items if x >= 0) == {r["local"]: r["c"] for r in rows}
        assert relation.where("items IS NOT NULL").count() == 1
