import itertools
import random

import numpy as np

from mnemora.llm import crf
from tests.llm.edge import documents


def table(spark, n=160):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        lines = [" ".join(rng.choices("the of river house and stone was long".split(), k=9)).capitalize() + "." for _ in range(rng.randint(1, 6))]
        if not good:
            lines = [lines[0]] + [" ".join(w.upper() + "$$$" for w in x.split()) for x in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_marginals_equal_enumeration():
    rng = np.random.RandomState(0)
    chain = crf.Chain(rng.randn(crf.N_FEATURES, 2), rng.randn(2, 2))
    n_lines = np.array([3, 1, 4])
    x = rng.randn(8, crf.N_FEATURES)
    got = chain.good(x, n_lines)
    at = 0
    for n in n_lines:
        score = x[at : at + n] @ chain.weights
        mass, ones = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(score[i, y] for i, y in enumerate(path)) + sum(chain.moves[a, b] for a, b in zip(path, path[1:])))
            mass += w
            ones += w * np.array(path)
        assert np.allclose(got[at : at + n], ones / mass)
        at += n


def test_held_out_accuracy(spark):
    docs, labels, truth = table(spark)
    got = crf.score(docs, crf.learn(docs, labels)).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)


def test_edges(spark):
    docs, labels, _ = table(spark)
    chain = crf.learn(docs, labels)
    rows = documents(spark)
    got = crf.score(rows, chain).collect()
    assert len(got) == rows.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[4] == by[5]
    assert crf.score(rows.limit(0), chain).collect() == []
    assert {r.score for r in crf.score(docs, crf.learn(docs.limit(0), labels)).collect()} == {0.5}
    assert {r.score for r in crf.score(docs, crf.learn(docs, labels.filter("quality = 1"))).collect()} == {1.0}
    doubled = crf.learn(docs.unionByName(docs), labels)
    assert np.isfinite(doubled.weights).all()


def test_fit_climbs_to_the_top_of_the_likelihood():
    """No small step from the learnt weights raises the penalized likelihood by much; the gradient is right."""
    rng = np.random.RandomState(2)
    texts = [b"good words are here\nand more of them." if i % 3 else b"### $$$\nbuy NOW !!!\n1 2 3" for i in range(60)]
    texts = [t + b"\n" + bytes(rng.choice(list(b"abc #1"), 8).tolist()) for t in texts]
    label = np.array([int(i % 3 > 0) for i in range(60)])
    x, _, n_lines = crf.line_features(texts)
    x = x.astype(np.float64)
    line_label = np.repeat(label, n_lines)
    starts = np.cumsum(n_lines) - n_lines

    def objective(w, m):
        score, _, _, total = crf.Chain(w, m).sums(x, n_lines)
        gold = score[np.arange(len(x)), line_label]
        steps = np.zeros(len(x))
        later = np.setdiff1d(np.arange(len(x)), starts)
        steps[later] = m[line_label[later - 1], line_label[later]]
        return (((np.add.reduceat(gold + steps, starts) - total) / n_lines).mean() - 5e-4 * (w * w).sum() - 5e-4 * (m * m).sum())

    chain = crf.fit(x, n_lines, label, rounds=600)
    best = objective(chain.weights, chain.moves)
    assert best > objective(np.zeros_like(chain.weights), np.zeros_like(chain.moves)) + 0.1
    for _ in range(30):
        step = rng.normal(0, 0.02, chain.weights.shape)
        assert objective(chain.weights + step, chain.moves + rng.normal(0, 0.02, (2, 2))) < best + 1e-3
