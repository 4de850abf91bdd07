import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mnemora.llm import spelling
from tests.llm.edge import documents


def edits(word):
    """What is left of a word without each of its letters, and with each letter open."""
    for i in range(len(word)):
        yield word[:i] + word[i + 1 :]


def brute_near(words):
    near = {w: set() for w in words}
    by = {}
    for w in words:
        for i in range(len(w)):
            by.setdefault((i, w[:i], w[i + 1 :]), set()).add(w)
        for e in edits(w):
            if e in near:
                near[w].add(e)
                near[e].add(w)
    for own in by.values():
        for a in own:
            near[a] |= own - {a}
    return near


def brute(counts, ratio=5):
    near, form = brute_near(counts), {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def brute_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def random_words(rng, letters, n):
    out = set()
    while len(out) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 11)))
        out.add(w)
        at = rng.randint(0, len(w) - 1)
        out.add(rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]]))
    return {w: rng.choice([1, 2, 5, 25, 25, 700]) for w in out if len(w) >= 6}


def collected(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("bucket", [20_000, 30, 2])
def test_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    rng = random.Random(bucket)
    counts = random_words(rng, "abé", 900) | {"a" * 3000: 9, "a" * 2999: 80, "a" * 3001: 3, "b" + "a" * 2999: 1, "zwölfte": 7, "zwolfte": 50, "\U0001f642" * 6: 5, "\U0001f642" * 7: 50}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert collected(spelling.variants(df)) == brute(counts)


def test_wavelet_tree():
    rng = np.random.RandomState(2)
    for n in (1, 2, 3, 100):
        values = rng.permutation(n)
        a, b, c, d = (np.sort(rng.randint(0, n + 1, (4, 60)).reshape(2, 2, 60), axis=1)[i // 2, i % 2] for i in range(4))
        query, value = spelling.WaveletTree(values).report(a, b, c, d)
        want = {(q, v) for q in range(60) for v in values[a[q] : b[q]].tolist() if c[q] <= v < d[q]}
        assert set(zip(query.tolist(), value.tolist())) == want and len(query) == len(want)


def test_chains_are_followed(spark):
    chain = {"aaaaaa" + "b" * k: 5 * 6**k for k in range(12)}
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert all(r.root == "aaaaaa" + "b" * 11 for r in got.values())
    assert collected(spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long"))) == brute(chain)


def test_words_of_edge_texts(spark):
    docs = documents(spark)
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    extra = [(100 + i, "ÉCOLE École école STRASSE straße ×÷ naïveté NAÏVETÉ " * 3) for i in range(400)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    counts = brute_words(texts + extra)
    assert {r.word: r.n for r in spelling.words(docs.repartition(5)).collect()} == counts
    assert collected(spelling.variant_groups(docs)) == brute(counts)
    assert spelling.variant_groups(docs.limit(0)).collect() == []


def test_held_words_are_passed_on(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    docs = spark.createDataFrame([(i, "several plain words again " * 2) for i in range(30)], "doc_id long, text string")
    assert {r.word: r.n for r in spelling.words(docs).collect()} == brute_words([(i, "several plain words again " * 2) for i in range(30)])
