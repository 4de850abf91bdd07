import random

import numpy as np
import pytest

from mnemora.llm import neardup
from tests.llm.edge import documents


def brute(rows, k, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if both and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(spark, k):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(25):
        base = rng.choices(words, k=rng.randint(1, 120))
        for _ in range(rng.choice([1, 2, 3, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) * 3, " ".join(text)))
    # a chain: each is near the next only
    chain = [f"c{i}" for i in range(160)]
    rows += [(1000 + i, " ".join(chain[4 * i : 4 * i + 80])) for i in range(15)]
    # many short texts around one, not near each other
    base = [f"s{i}" for i in range(40)]
    rows += [(2000, " ".join(base))] + [(2001 + i, " ".join(base[:i] + ["z"] + base[i + 1 :])) for i in range(0, 40, 2)]
    rows += [(3000, None), (3001, ""), (3002, "w1"), (3003, "W1 "), (3004, "w1 w2")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, 80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == brute(rows, k, 80)


def test_edges(spark):
    df = documents(spark)
    got = neardup.near_duplicates(df, 2, 80).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 1 and not by[2].kept and by[1].kept
    assert all(by[i].n_shingles == 0 and by[i].component_id == i for i in (4, 5, 6))
    assert by[None].component_id is None and by[None].kept
    assert by[8].component_id == 8 and by[8].kept
    assert neardup.near_duplicates(df.limit(0)).collect() == []


def test_estimate_is_near_the_similarity():
    rng = np.random.RandomState(0)
    for n in (1, 5, 40, 4000):
        both = rng.randint(0, 1 << 62, n).astype(np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.randint(0, 1 << 62, n // 8).astype(np.uint64)]) * np.uint64(4)) for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        found = neardup.estimate(neardup.registers(neardup._mix(a) if False else np.sort(neardup._mix(a)))[None], neardup.registers(np.sort(neardup._mix(b)))[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(found - true) < 0.2


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    found = {r.node: r.root for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)}


def crowded(rng):
    """Texts of which many share bands and few are near: all replace some words of one of three texts."""
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(24)]
        for _ in range(40):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                text[rng.randrange(24)] = rng.choice("xyz")
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_and_parts_of_a_few_members(spark, monkeypatch, seed):
    monkeypatch.setattr(neardup, "BLOCK_X", 4)
    monkeypatch.setattr(neardup, "BLOCK_Y", 4)
    monkeypatch.setattr(neardup, "STAR_PART", 3)
    rows = crowded(random.Random(seed))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80)
    want = brute(rows, 2, 80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == want
    assert 3 < len({r[2] for r in want}) < len(rows)


def test_ids_of_other_types(spark):
    rows = crowded(random.Random(3))[:60]
    want = {(i, c) for i, _, c, _ in brute([(i - 2**63, t) for i, t in rows], 2, 80)}
    least = neardup.near_duplicates(spark.createDataFrame([(i - 2**63, t) for i, t in rows], "doc_id long, text string"), 2, 80)
    assert {(r.doc_id, r.component_id) for r in least.collect()} == want
    names = neardup.near_duplicates(spark.createDataFrame([(f"d{i:03}", t) for i, t in rows], "doc_id string, text string"), 2, 80)
    assert {(r.doc_id, r.component_id) for r in names.collect()} == {(f"d{i + 2**63:03}", f"d{c + 2**63:03}") for i, c in want}


def test_rows_that_share_an_id_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (5, None), (6, a + " c"), (7, b + " c"), (8, "c d e")]
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert {(6, 5), (7, 5), (8, 8)} <= got


def test_nothing_is_left_but_what_the_result_reads(spark):
    from mnemora import session

    session.clean(spark)
    got = neardup.near_duplicates(spark.createDataFrame(crowded(random.Random(4)), "doc_id long, text string"), 2, 80)
    assert got.count() == 120 and len(session._written) <= 4
    session.clean(spark)
