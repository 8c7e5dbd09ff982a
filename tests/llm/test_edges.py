"""Every operator and stage on odd rows and on empty tables."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from deltaboard.llm import queries
from deltaboard.llm.containment import contained_items
from deltaboard.llm.language import predict_language, word_counts
from deltaboard.llm.maintext import extract_pages
from deltaboard.llm.pieces import decode_samples, encode_samples
from deltaboard.llm.quality import quality_rules
from deltaboard.llm.repeats import remove_repeats
from deltaboard.llm.secrets import scan_secrets
from deltaboard.llm.sharding import balanced_shards
from deltaboard.llm.simhash import near_copies
from deltaboard.llm.token_files import token_round_trip

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")

PER_ROW = {
    "token_files": lambda d, s: token_round_trip(d, BPE, public_tokenizers.PATTERN, s),
    "language": lambda d, s: predict_language(d, word_counts(d)),
    "sharding": lambda d, s: balanced_shards(d, s),
    "quality": quality_rules,
    "repeats": remove_repeats,
    "simhash": near_copies,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_each(odd_docs, stage, name):
    got = PER_ROW[name](odd_docs, stage).select("doc_id").collect()
    assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in odd_docs.select("doc_id").collect())


@pytest.mark.parametrize("name", PER_ROW)
def test_empty(odd_docs, stage, name):
    assert PER_ROW[name](odd_docs.limit(0), stage).count() == 0


def test_samples(odd_docs):
    got = encode_samples(odd_docs, MODEL)
    rows = got.collect()
    assert all(r["decoded"] for r in rows)
    assert sum(r["sample"] == 0 for r in rows) == odd_docs.count()
    texts = {(r["doc_id"], r["text"]) for r in decode_samples(got, MODEL).collect()}
    assert texts == {(r["doc_id"], r["text"] or "") for r in odd_docs.collect()}
    assert encode_samples(odd_docs.limit(0), MODEL).count() == 0


def test_searches(spark, odd_docs, stage):
    items = spark.createDataFrame(
        [(1, "passage that several documents share a"), (2, ""), (3, None), (None, "a passage"), (4, "漢字"), (4, "x")],
        "item_id long, text string",
    )
    got = {(r["doc_id"], r["item_id"]) for r in contained_items(odd_docs, items).collect()}
    assert got == {(1, 1), (2, 1), (None, 1), (9, 1), (8, 4)}
    assert contained_items(odd_docs.limit(0), items).count() == 0
    assert contained_items(odd_docs, items.limit(0)).count() == 0
    assert scan_secrets(odd_docs, stage).count() >= 0
    assert scan_secrets(odd_docs.limit(0), stage).count() == 0


def test_pages(spark):
    html = "<nav>menu</nav><article><h1>A &amp; B</h1><p>One<b> two</b><p>three.</article><div class='ad'>buy</div>"
    rows = [(1, "u", html), (None, None, None), (2, "u", ""), (3, None, "<p"), (1, "u", html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in extract_pages(pages).collect()]
    article = "A & B\n\nOne two\n\nthree."
    assert [g for g in got if g[1]] == [(1, article, len(article))] * 2
    assert extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, odd_docs, stage, k, tmp_path):
    bench = spark.createDataFrame([(1, "nothing like this is in any text")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/sf/benchmark.parquet")
    docs = odd_docs.withColumn("extra", F.lit(1))
    stages = corpus_pipeline.STAGES
    got = stages[k][1](spark, docs, f"{tmp_path}/sf")
    assert got.count() >= 0
    if k < 4:
        assert got.columns == corpus_pipeline.COLUMNS
    if k in (2, 3):
        assert got.count() == docs.count()
    assert stages[k][1](spark, docs.limit(0), f"{tmp_path}/sf").count() == 0


def test_every_text_of_an_item_is_looked_for(spark):
    words = [f"w{i}" for i in range(40)]
    short, long_ = " ".join(words[:12]), " ".join(words[20:40])
    docs = spark.createDataFrame([(1, f"before {short} after"), (2, f"x {long_} y"), (3, "nothing here at all"), (4, "ab ab ab")], "doc_id long, text string")
    items = spark.createDataFrame([(7, short, 1), (7, long_, 2), (7, long_, 2), (8, "ab", 3)], "item_id long, text string, doc_id long")
    got = sorted((r["doc_id"], r["item_id"]) for r in contained_items(docs, items).collect())
    assert got == [(1, 7), (2, 7), (4, 8)]


STAGE_ROWS = "doc_id long, text string, lang string, source string, n_chars long, row long, label int"
SECRET = "password = 'Zx81qP0sVt93LmQ7'"


@pytest.fixture
def stage_docs(spark, tmp_path):
    """Rows without an id, rows that share one, equal rows, secrets and benchmark text in each of them."""
    prose = [" ".join(f"{w}{i}" for w in "alpha beta gamma delta epsilon zeta eta theta".split() for i in range(k, k + 4)) for k in range(0, 60, 5)]
    item = " ".join(f"question{i}" for i in range(30))
    rows = [
        (None, f"{prose[0]} {SECRET} end"), (None, f"{prose[1]} {SECRET} end"), (1, f"{prose[2]} {SECRET}"), (1, prose[3]),
        (2, f"{prose[4]} {item} {prose[5]}"), (2, prose[6]), (None, f"{item} {prose[7]}"), (None, prose[8]), (3, prose[9]), (3, prose[9]),
        (None, prose[10]), (None, prose[10]), (4, None), (None, None), (5, ""),
    ]
    folder = str(tmp_path / "tables")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame([(*r, "en", "h", 1, 9, 0) for r in rows], STAGE_ROWS)
    return docs, folder, prose, item


def test_stages_go_by_row(spark, stage_docs):
    """Nothing is lost by an id that another row has, and nothing stays for want of one."""
    docs, folder, prose, item = stage_docs
    texts = lambda df: sorted(r["text"] or "" for r in df.collect())

    one_each = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert one_each.columns == corpus_pipeline.COLUMNS
    assert texts(one_each) == sorted({r["text"] or "" for r in docs.collect()})

    clean = corpus_pipeline.decontamination(spark, docs, folder)
    assert clean.columns == corpus_pipeline.COLUMNS
    assert texts(clean) == sorted((r["text"] or "") for r in docs.collect() if item not in (r["text"] or ""))

    hidden = corpus_pipeline.secrets(spark, docs, folder)
    assert hidden.columns == corpus_pipeline.COLUMNS and hidden.count() == docs.count()
    assert not any("Zx81qP0sVt93LmQ7" in t for t in texts(hidden))
    assert sum("[secret]" in t for t in texts(hidden)) == 3
    plain = {r["text"] for r in docs.collect() if r["text"] and SECRET not in r["text"]}
    assert plain <= set(texts(hidden))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, stage_docs, name):
    docs, folder, *_ = stage_docs
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), folder).count() == 0


def test_numerals_are_no_letters(spark):
    learned = [(k, t, lang, "s") for k in range(0, 40, 2) for t, lang in (("the house of the river", "en"), ("das haus am fluss", "de"))]
    docs = spark.createDataFrame(learned, "doc_id long, text string, lang string, source string")
    odd = spark.createDataFrame([(1, "² ½ ① Ⅷ"), (2, "12 _ ³"), (3, "haus² das"), (4, "das haus")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict_language(odd, word_counts(docs)).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3] == got[4] and got[3][0] == "de"


def test_candidates_of_very_long_texts_in_linear_time():
    """Names that never end and keys that never close."""
    import time

    from deltaboard.llm.secrets import candidates

    begin = time.perf_counter()
    assert not [c for c in candidates("token" * 40_000) if c[2] == "named"]
    assert not [c for c in candidates("-----BEGIN RSA PRIVATE KEY-----\nabc\n" * 6_000) if c[2] == "private_key"]
    closed = "-----BEGIN PRIVATE KEY-----\n" * 3 + "abc\n-----END PRIVATE KEY-----"
    assert [closed[a:b].count("BEGIN") for a, b, kind in candidates(closed) if kind == "private_key"] == [1]
    assert [t[a:b] for t in ["my_token_of_the_app = 'abc123xyz'"] for a, b, kind in candidates(t) if kind == "named"] == ["abc123xyz"]
    assert time.perf_counter() - begin < 10


def test_sampled_segmentations_are_returned(spark, tmp_path):
    texts = {1: "a text to cut into pieces", 2: "été – 漢字 \U0001f600", 3: None, 4: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_sentencepiece(spark, str(tmp_path))
    rows = got.collect()
    for r in rows:
        assert len(r["ids"]) == r["n_ids"]
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
    assert collections.Counter(r["doc_id"] for r in rows) == {1: 2, 2: 2, 3: 1, 4: 1}
    assert all(r["text"] == (texts[r["doc_id"]] or "") for r in decode_samples(got, MODEL).collect())
