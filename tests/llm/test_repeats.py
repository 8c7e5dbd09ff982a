"""Regions that meet by their cores: few rows, and no string lost where a core is in several blocks."""

import hashlib
import random

import pytest

from deltaboard.llm import repeats
from deltaboard.llm.repeats import remove_repeats

LETTERS = "abcdefghijklmnopqrstuvwxyz     "


def noise(rng, size):
    return "".join(rng.choice(LETTERS) for _ in range(size))


def brute(texts):
    seen, found = set(), {}
    for doc, text in texts:
        data = text.encode()
        gone = [False] * len(data)
        for at in range(len(data) - 99):
            string = data[at : at + 100]
            if string in seen:
                gone[at : at + 100] = [True] * 100
            seen.add(string)
        found[doc] = (sum(gone), hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return found


def test_a_common_phrase_in_other_places_gives_no_rows(spark, stage):
    rng = random.Random(2)
    phrase = "a phrase of less than seventy bytes which all of the texts here share"
    texts = [(k, noise(rng, 200) + phrase + noise(rng, 200)) for k in range(1000)]
    rows = remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), stage).collect()
    assert sum(r["n_removed"] for r in rows) == 0
    assert spark.read.parquet(stage.paths["matched"]).count() == 0


@pytest.mark.parametrize("block", [4, 8192])
def test_cores_in_several_blocks(spark, stage, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    rng = random.Random(3)
    passage = noise(rng, 140)
    texts = []
    for k in range(90):
        begin, end = rng.randint(0, 30), rng.randint(110, 140)
        texts.append((k, noise(rng, rng.randint(0, 60)) + passage[begin:end] + noise(rng, rng.randint(0, 60))))
    rows = remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), stage).collect()
    assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in rows} == brute(texts)
