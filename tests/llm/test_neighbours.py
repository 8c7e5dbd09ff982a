"""Nearest neighbours against brute force."""

import random

import numpy as np
import pytest

from deltaboard.llm import queries
from deltaboard.llm.neighbours import nearest_rows

ROWS = "vec_id long, embedding array<float>"


def brute(rows, top=20, every=20):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    out = []
    for i, key in enumerate(ids):
        if key is not None and key % every == 0:
            scores = x @ x[i]
            order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-scores[j], ids[j] is None, ids[j] or 0))
            out.append((key, [(ids[j], scores[j]) for j in order[:top]]))
    return out


def test_recall_on_a_whole_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {}
    for r in queries.op11_neighbours(spark, folder).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    vectors = {k: np.array(v, np.float64) for k, v in rows}
    expected = brute(rows)
    assert set(got) == {k for k, _ in expected}
    for key, near in expected:
        found = got[key]
        assert sorted(found) == list(range(1, 21)) and key not in {v for v, _ in found.values()}
        assert all(abs(vectors[key] @ vectors[v] - s) < 1e-12 for v, s in found.values())
        order = [(-found[k][1], found[k][0]) for k in range(1, 21)]
        assert order == sorted(order)
        hits, total = hits + len({v for v, _ in near} & {v for v, _ in found.values()}), total + 20
    assert hits / total >= 0.9


def test_odd_rows_of_a_small_table(spark, stage):
    """Few vectors: the result is exact. Equal vectors, ties, null and repeated ids, unusable vectors, clashing columns."""
    draw = random.Random(2)
    fine = [(i, [float(draw.randint(-3, 3)), float(draw.randint(-3, 3)), 1.0]) for i in range(60)]
    fine += [(100 + i, [2.0, 2.0, 1.0]) for i in range(45)] + [(120, [5.0, 0.5, 1.0]), (None, [1.0, 2.0, 1.0]), (140, [2.0, 2.0, 1.0]), (160, [0.0, -9.0, 1.0])]
    bad = [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 1.0]), (260, [float("nan"), 1.0, 1.0]), (280, [float("inf"), 1.0, 1.0]), (300, [1.0, 1.0]), (320, [])]
    rows = spark.createDataFrame([(*r, "a", 1, 0.5) for r in fine + bad], f"{ROWS}, node string, q int, sim double")
    got = {}
    for r in nearest_rows(rows, stage).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = {}
    for key, near in brute(fine):
        want.setdefault(key, []).extend(near)
    order = lambda near: sorted(near, key=lambda p: (-p[1], p[0] is None, p[0] or 0))
    assert {k: order(v) for k, v in got.items()} == {k: order(v) for k, v in want.items()}


@pytest.mark.parametrize("rows", [[], [(0, [0.0, 0.0])], [(0, None)], [(0, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_find(spark, stage, rows):
    assert nearest_rows(spark.createDataFrame(rows, ROWS), stage).count() == 0
