"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import heapq
import html
import io
import itertools
import math
import os
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest

from deltaboard.llm import containment, maintext, oracles, pieces, queries, repeats, secrets, sharding, simhash, token_files

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_queries_with_a_twin(spark):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    for name, sql in oracles.all_sql().items():
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        twin = sorted(map(str, found.fetchall()))
        assert sorted(str(tuple(r)) for r in queries.all_queries()[name](spark, FOLDER).select(*names).collect()) == twin


def test_token_file_reads_single_documents():
    class Source:
        def __init__(self, data):
            self.data = data

        def size(self):
            return len(self.data)

        def read_at(self, n, at):
            return self.data[at : at + n]

    rng, out = np.random.default_rng(0), io.BytesIO()
    docs = [rng.integers(0, 50_000, n).astype("<u4").tobytes() for n in (3, 0, 40, 1000, 7)]
    writer = token_files.FileWriter(out, frame_ids=16)
    for k, ids in enumerate(docs):
        writer.add(k, ids)
    writer.close()
    reader = token_files.FileReader(Source(out.getvalue()))
    assert [b"".join(reader.document(k)) for k in (4, 3, 2, 1, 0)] == docs[::-1]
    damaged = bytearray(out.getvalue())
    damaged[6] ^= 255
    with pytest.raises(Exception):
        list(token_files.FileReader(Source(bytes(damaged))).document(0))


def test_token_ids_are_the_library_s(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    own = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    many = [*list(texts.values())[:60], "a  b\n\nc <|endoftext|> 'll  x", " ", "\n a", "a \n b", "it's  12's\t\tx!?'s"]
    assert [np.frombuffer(i, "<u4").tolist() for i in own.encode(many)] == [library.encode(t, add_special_tokens=False).ids for t in many]


def test_language_on_held_out_rows(spark):
    got = queries.op2_language(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id")
    rows = got.where("held_out").select("lang", "lang_pred").collect()
    assert sum(r[0] == r[1] for r in rows) >= 0.95 * len(rows) > 0


def test_containment_against_every_window(texts):
    items = [(k, containment._words(t)[: 12 + k]) for k, t in enumerate(list(texts.values())[:30]) if len(t) > 300]
    index = containment.ItemIndex(items, 5, 48)
    docs = list(texts.values())
    got = {(d, i) for d, i, _, _ in index.search(docs, 5, 0.8)}
    grams = lambda w: set(zip(*(w[k:] for k in range(5))))
    for d, text in enumerate(docs):
        words = containment._words(text)
        for i, item in items:
            wanted, size = grams(item), len(item)
            best = max((len(wanted & grams(words[a : a + size])) for a in range(max(1, len(words) - size + 1))), default=0)
            assert best < 0.8 * len(wanted) or (d, i) in got


def test_longest_first_is_the_heap_schedule():
    units = [(k, (k * 7919) % 101) for k in range(200)]
    loads, placed = [(0, s) for s in range(5)], {}
    for unit, size in sorted(units, key=lambda u: (-u[1], u[0])):
        load, shard = heapq.heappop(loads)
        placed[unit] = shard
        heapq.heappush(loads, (load + size, shard))
    assert sharding.longest_first(units, 5) == placed


def test_shards(spark, texts):
    rows = queries.op4_sharding(spark, FOLDER).collect()
    home = collections.defaultdict(set)
    slots = collections.defaultdict(list)
    for r in rows:
        home[texts[r["doc_id"]]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in home.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_secrets_of_known_places(spark, texts):
    got = {(r["doc_id"], r["start"], r["end"]) for r in queries.op5_secrets(spark, FOLDER).collect()}
    planted = {(d, m.start(1), m.end(1)) for d, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    assert planted == got


def test_samples_follow_gumbel_top_k():
    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model.weights = np.full_like(model.weights, 0.3)
    n = 20_000
    graph = pieces.Lattices(model, ["of a"] * n)
    found = pieces.sample_all(graph, list(range(n)), 2)
    name = lambda p: tuple(graph.ids_of(p.arcs).tolist())
    first = collections.Counter(name(f[0][0]) for f, _ in found)
    pairs = collections.Counter((name(f[0][0]), name(f[1][0])) for f, _ in found)

    def ways(state):
        if state < 0:
            return [((), 0.0)]
        arcs = range(graph.at[state], graph.at[state + 1])
        return [(tuple(graph.ids_of(np.array([a])).tolist()) + rest, log + graph.logs[a]) for a in arcs for rest, log in ways(graph.to[a])]

    exact = {}
    for combo in itertools.product(*(ways(int(s)) for s in graph.starts[0])):
        exact[sum((c[0] for c in combo), ())] = math.exp(sum(c[1] for c in combo))
    assert abs(sum(exact.values()) - 1) < 1e-9
    assert all(abs(first[k] / n - p) < 0.02 for k, p in exact.items())
    assert all(a != b and abs(c / n - exact[a] * exact[b] / (1 - exact[a])) < 0.02 for (a, b), c in pairs.items())


def test_factors_and_removed_bytes(spark, texts):
    rng = np.random.default_rng(1)
    for _ in range(40):
        n, limit = int(rng.integers(1, 50)), int(rng.integers(1, 12))
        s = rng.integers(0, int(rng.integers(1, 4)), n)
        same = lambda i, j: next((k for k in range(min(limit, n - i)) if s[j + k] != s[i + k]), min(limit, n - i))
        assert repeats.longest_previous_factors(s, limit).tolist() == [max([0] + [same(i, j) for j in range(i)]) for i in range(n)]
    seen, wanted = set(), {}
    for doc, text in sorted(texts.items()):
        data = text.encode()
        gone = np.zeros(len(data), dtype=bool)
        for at in range(len(data) - 99):
            if data[at : at + 100] in seen:
                gone[at : at + 100] = True
            seen.add(data[at : at + 100])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = bytes(np.frombuffer(data, np.uint8)[~gone])
        wanted[doc] = (len(data), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())
    rows = queries.op8_suffix_array(spark, FOLDER).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == wanted


@pytest.mark.parametrize("bucket", [4096, 8])
def test_near_copies(spark, stage, texts, bucket):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_copies(docs, stage, bucket=bucket).collect()}
    label = {d: d for d in got}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(got, 2):
            if label[a] != label[b] and (got[a][0] ^ got[b][0]).bit_count() <= 3:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert {d: c for d, (_, c) in got.items()} == label
    assert all(simhash.fingerprint(texts[d]) == f for d, (f, _) in got.items())


def test_articles():
    con = duckdb.connect()
    for page, in con.execute(f"SELECT html FROM '{FOLDER}/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
        parts = [re.sub(r"<br>", " ", re.sub(r"</?b>", "", p)) for p in re.split(r"</?(?:h1|p)>", article)]
        blocks = [" ".join(html.unescape(p).split()) for p in parts]
        assert maintext.main_text(page) == "\n\n".join(b for b in blocks if b)
