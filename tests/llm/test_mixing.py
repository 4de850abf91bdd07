import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mnemora.llm import mixing
from tests.llm.edge import documents


def share(children, total):
    """(name, cap, weight) to tokens, by filling rounds in whole numbers at the end."""
    full, open_ = {}, [c for c in children if c[2] > 0]
    while open_:
        rest, weights = total - sum(full.values()), sum(c[2] for c in open_)
        over = [c for c in open_ if c[1] * weights <= rest * c[2]]
        if not over:
            return full | {n: min(cap, rest * w // weights) for n, cap, w in open_}
        full |= {n: cap for n, cap, _ in over}
        open_ = [c for c in open_ if c not in over]
    return full


def brute(rows, weights, budget, epochs, seed):
    leaves = defaultdict(list)
    for i, a, b, n in rows:
        leaves[a, b].append((i, n))
    cap = {k: epochs * sum(n for _, n in v) for k, v in leaves.items()}
    total = min(budget, sum(cap.values()))
    first = share([(a, sum(c for k, c in cap.items() if k[0] == a), weights[0].get(a, 1)) for a in sorted({k[0] for k in cap})], total)
    given = {}
    for a, t in first.items():
        given |= {(a, b): x for b, x in share([(k[1], c, weights[1].get(k[1], 1)) for k, c in sorted(cap.items()) if k[0] == a], t).items()}
    out = []
    for k, docs in leaves.items():
        t, have = given.get(k, 0), sum(n for _, n in docs)
        e = t // have if have else 0
        rest, upto = t - e * have, 0
        key = lambda i: int(hashlib.md5(f"{seed}-{e + 1}-{i}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        for i, n in sorted(docs, key=lambda d: (key(d[0]), d)):
            upto += n
            out.append((i, *k, n, e + (upto <= rest) if t > 0 else 0))
    return sorted(out)


@pytest.mark.parametrize("budget,epochs", [(500, 1), (4000, 3), (10**9, 2), (0, 1), (7, 1)])
def test_against_brute_force(spark, monkeypatch, budget, epochs):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    monkeypatch.setattr(mixing, "FAN_BITS", 2)
    rng = random.Random(budget)
    rows = [(i, rng.choice("aaab"), rng.choice("xxxxxyz"), rng.choice([0, 1, 5, 9, 30])) for i in range(300)]
    weights = [{"a": 2, "b": 3}, {"x": 1, "y": 50, "z": 0}]
    df = spark.createDataFrame(rows, "doc_id long, p string, q string, n long").withColumn("text", F.lit(""))
    got = mixing.mix(df, {"p": F.col("p"), "q": F.col("q")}, weights, F.lit(budget), epochs, 3, F.col("n"))
    found = sorted((r.doc_id, r.p, r.q, r.tokens, r.copies) for r in got.collect())
    assert found == brute(rows, weights, budget, epochs, 3)
    assert sum(r[3] * r[4] for r in found) <= budget


def test_shortage_goes_to_siblings_first(spark):
    rows = [(i, a, b, 10) for i, (a, b) in enumerate([("a", "x")] * 2 + [("a", "y")] * 50 + [("b", "x")] * 50)]
    df = spark.createDataFrame(rows, "doc_id long, p string, q string, n long").withColumn("text", F.lit(""))
    got = mixing.mix(df, {"p": F.col("p"), "q": F.col("q")}, [{}, {}], F.lit(400), 1, 0, F.col("n")).filter("copies > 0")
    assert {(r.p, r.q): r.n for r in got.groupBy("p", "q").agg(F.sum("tokens").alias("n")).collect()} == {("a", "x"): 20, ("a", "y"): 180, ("b", "x"): 200}


def test_edges(spark):
    df = documents(spark)
    levels = {"domain": F.lit("all"), "lang": F.col("lang"), "source": F.col("source")}
    got = mixing.mix(df, levels, [{}, {}, {}], F.sum("tokens"), 1, 1).collect()
    assert len(got) == df.count() and all(r.copies == 1 for r in got if r.tokens)
    assert mixing.mix(df.limit(0), levels, [{}, {}, {}], F.sum("tokens"), 1, 1).collect() == []


def test_children_by_true_ratio(spark):
    """Caps and weights whose ratios differ only far behind the point, against fractions."""
    rng = random.Random(5)
    rows, weights = [], {}
    for i in range(40):
        weights[f"s{i:02}"] = w = rng.randint(900_000_000, 999_999_999)
        rows.append((i, f"s{i:02}", w // 1_000_003 + rng.randint(0, 1)))
    df = spark.createDataFrame(rows, "doc_id long, p string, n long").withColumn("text", F.lit(""))
    for budget in (sum(r[2] for r in rows) * 99 // 100, sum(r[2] for r in rows) - 7):
        leaves = df.groupBy("p").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows"))
        got = {r.p: r.total for r in mixing.leaf_budgets(leaves, ["p"], [weights], F.lit(budget), 1).collect()}
        assert got == share([(p, n, weights[p]) for _, p, n in sorted(rows, key=lambda r: r[1])], budget)
    with pytest.raises(ValueError):
        mixing.leaf_budgets(leaves, ["p"], [{"s00": 10**9}], F.lit(1), 1)
