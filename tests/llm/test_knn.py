import math
import random

import numpy as np
import pytest

from mnemora.llm import knn


def brute(rows, asked, k):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, []).append([math.floor(256 * x) for x in v])
    out = []
    for q in asked:
        for v in whole.get(q, []):
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, ws in whole.items() if i != q for w in ws)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("chunk,block", [(4096, 8192), (20, 3)])
def test_against_brute_force(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(knn, "GROUP", 2 if chunk == 20 else knn.GROUP)
    monkeypatch.setattr(knn, "CHUNK", chunk)
    monkeypatch.setattr(knn, "BLOCK", block)
    rng = random.Random(chunk)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in centres[i % 4]]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)]  # many copies: ties
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2050, [float("inf")] * 6), (2003, [0.0] * 6), (2004, [1.0, 1.0]), (None, [1.0] * 6), (2100, [])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, cell string, v string")
    got = knn.top_k(df, df.filter("vec_id % 50 = 0"), 5)
    asked = [i for i, _ in rows if i is not None and i % 50 == 0]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute(rows, asked, 5)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [0.5]), (50, [-0.5]), (3, [1e6])], "vec_id long, embedding array<float>")
    got = knn.top_k(df, df.filter("vec_id % 50 = 0"), 5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute([(0, [0.5]), (50, [-0.5]), (3, [1e6])], [0, 50], 5)
    assert knn.top_k(df.limit(0), df.limit(0), 5).collect() == []


def test_large_components_are_exact(spark):
    rows = [(0, [3e6, 1.0]), (1, [3e6, 7.0]), (2, [3e6, -7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.top_k(df, df.filter("vec_id = 0"), 2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, [0], 2)


def test_bounds_keep_every_row_that_counts():
    """For cells and groups of random vectors: a row that a query scores at its bound or above is never left out."""
    rng = np.random.RandomState(3)
    centres = rng.normal(0, 400, (6, 5))
    rows = np.floor(centres[rng.randint(0, 6, 400)] + rng.normal(0, 20, (400, 5)))
    asked = np.concatenate([rows[::20], np.floor(rng.normal(0, 300, (10, 5)))])
    cells = knn.Cells(rows[::13])
    cell, far = cells.assign(rows)
    radius = np.zeros(len(cells.pivots))
    np.maximum.at(radius, cell, far)
    size = np.bincount(cell, minlength=len(radius))
    group = cells.groups(7)[cells.assign(asked)[0]]
    reach, least = np.zeros(7), np.full(7, np.inf)
    np.maximum.at(reach, group, cells.far(asked, group))
    best = np.sort(asked @ rows.T, 1)[:, -5]
    np.minimum.at(least, group, best)
    groups = knn.Groups(cells, radius, np.arange(7), reach, least)
    kept = groups.of_rows(rows, cell)
    needed = asked @ rows.T >= best[:, None]
    assert all(kept[needed[i], g].all() for i, g in enumerate(group))
    own = np.unique(group)
    assert kept[:, own].mean() < 0.8 and (kept.sum(0) <= groups.candidates(size)).all()


def test_copies_of_one_id_are_dealt_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(knn, "CHUNK", 10)
    rows = [(0, [1.0, 0.5])] + [(7, [1.0, 0.25])] * 60 + [(i, [0.5, 0.1 * i]) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.top_k(df, df.filter("vec_id = 0"), 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, [0], 5)
