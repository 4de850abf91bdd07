import datetime
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from mnemora.llm import pareto


def brute_layers(points, most=12):
    """Layer of each point by the definition; lower is better."""
    left, out = set(points), {}
    for layer in range(1, most + 1):
        front = {a for a in left if not any(b != a and all(x <= y for x, y in zip(b, a)) for b in left)}
        out |= dict.fromkeys(front, layer)
        left -= front
    return out | dict.fromkeys(left, 0)


@pytest.mark.parametrize("n,values,d", [(0, 5, 4), (1, 5, 4), (300, 4, 4), (900, 12, 4), (400, 200, 2), (200, 9, 1)])
def test_peel(n, values, d):
    rng = np.random.RandomState(n)
    points = np.unique(rng.randint(0, values, (n, d)), axis=0)
    want = brute_layers([tuple(p) for p in points.tolist()])
    assert pareto.peel(points).tolist() == [want[tuple(p)] for p in points.tolist()]


def test_peel_with_least_layers():
    points = np.array([[0, 0], [1, 1], [2, 2], [0, 3]])
    assert pareto.peel(points, np.array([4, 1, 1, 1])).tolist() == [4, 5, 6, 5]
    assert pareto.peel(points, np.array([1, 1, 1, 9]), 8).tolist() == [1, 2, 3, 0]


def test_deepest():
    rng = np.random.RandomState(1)
    points, layer, asked = rng.randint(0, 9, (300, 3)), rng.randint(1, 9, 300), rng.randint(0, 12, (200, 3))
    want = [max([0, *(int(v) for p, v in zip(points, layer) if (p <= x).all() and (p < x).any())]) for x in asked]
    assert pareto.deepest(points, layer, asked).tolist() == want


@pytest.mark.parametrize("block,most_blocks,chunk", [(50_000, 64, 200_000), (40, 5, 60), (7, 64, 20)])
def test_layers_over_blocks(spark, monkeypatch, block, most_blocks, chunk):
    for name, value in (("BLOCK", block), ("MOST_BLOCKS", most_blocks), ("CHUNK", chunk)):
        monkeypatch.setattr(pareto, name, value)
    rng = random.Random(block)
    points = {g: {tuple(rng.randint(0, 7) for _ in range(4)) for _ in range(n)} for g, n in (("", 500), ("a", 200), ("b", 3))}
    points["chain"] = {(k, k, k, k) for k in range(60)}
    df = spark.createDataFrame([(g, *p) for g, own in points.items() for p in own], "g string, c0 long, c1 long, c2 long, c3 long")
    got = defaultdict(dict)
    for r in pareto.layers(df, "g", pareto.COSTS).collect():
        got[r.g][tuple(r[1:5])] = r.layer
    for g, own in points.items():
        assert got[g] == {p: layer for p, layer in brute_layers(own).items() if layer}, g


def brute_offers(lines, items, sales):
    price, kind, sold = {}, {}, {}
    for i, p, k in items:
        price[i] = min(x for x in (price.get(i), p) if x is not None) if (price.get(i), p) != (None, None) else None
        kind[i] = min(x for x in (kind.get(i), k) if x is not None) if (kind.get(i), k) != (None, None) else None
    for s, t in sales:
        if s is not None and t is not None:
            sold[s] = min(sold.get(s, t), t)
    cents = lambda x: None if x is None or not math.isfinite(x) else math.floor(100 * x + 0.5)
    own = defaultdict(list)
    for s, i, v, q, a, d, t in lines:
        if i is not None and v is not None:
            own[i, v].append((s, q, cents(a), cents(d), t))
    out = {}
    for (i, v), rows in own.items():
        p, whole = cents(price.get(i)), [(q, c, d) for _, q, c, d, _ in rows if None not in (q, c, d)]
        n = sum(q for q, _, _ in whole)
        d = [x[3] for x in rows if x[3] is not None]
        late = [(t.date() - sold[s].date()).days for s, _, _, _, t in rows if t is not None and s in sold]
        q = [x[1] for x in rows if x[1] is not None]
        cost = math.floor(Fraction(sum(c * (100 - d) for _, c, d in whole), p * n)) if whole and p is not None and p >= 1 and n else None
        mean = lambda x: math.floor(Fraction(sum(x), len(x))) if x else None
        out[i, v] = (kind.get(i), cost, mean(d), mean(late), max(q) if q else None)
    return out


def tables(spark, lines, items, sales):
    return (
        spark.createDataFrame([(*r, "x") for r in lines], "sale_id long, item_id long, vendor_id long, quantity int, amount double, discount double, shipped_at timestamp_ntz, kind string"),
        spark.createDataFrame([(*r, 7) for r in items], "item_id long, price double, kind string, quantity int"),
        spark.createDataFrame([(*r, 1.0) for r in sales], "sale_id long, sold_at timestamp_ntz, price double"),
    )


def test_offers_against_brute_force(spark):
    rng = random.Random(5)
    day = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randint(0, 2000))
    some = lambda x: None if rng.random() < 0.1 else x
    sales = [(s, some(day())) for s in range(80)] + [(3, day()), (None, day())]
    items = [(i, some(rng.choice([0.004, 1.5, 20.0, 333.33])), some(rng.choice("ab"))) for i in range(30)] + [(2, 7.0, "c"), (None, 1.0, "a"), (29, None, None)]
    lines = [
        (some(0 if rng.random() < 0.4 else rng.randint(0, 90)), some(0 if rng.random() < 0.4 else rng.randint(0, 33)), some(rng.randint(0, 3)), some(rng.randint(-1, 9)), some(rng.choice([rng.uniform(-5, 900), math.nan, math.inf])), some(rng.choice([0.05, 0.1, 1.7])), some(day()))
        for _ in range(900)
    ]
    lines += lines[:40]
    want = brute_offers(lines, items, sales)
    layer = {g: brute_layers({c for k, c in own}) for g, own in _costs(want).items()}
    whole = brute_layers({c for own in _costs(want).values() for _, c in own})
    count = defaultdict(int)
    for x in want.values():
        count[x[1:]] += 1
    got = {(r.item_id, r.vendor_id): tuple(r)[2:] for r in pareto.layered_offers(*tables(spark, lines, items, sales)).collect()}
    assert got == {k: (*x, layer[x[0]][_cost(x)], whole[_cost(x)], count[x[1:]]) for k, x in want.items()}


def _cost(x):
    a = [v if v is not None else None for v in x[1:]]
    sign = (1, -1, 1, -1)
    return tuple(10**9 if v is None else s * v for v, s in zip(a, sign))


def _costs(offers):
    out = defaultdict(list)
    for k, x in offers.items():
        out[x[0]].append((k, _cost(x)))
    return out


def test_empty_tables(spark):
    lines, items, sales = tables(spark, [(1, 1, 1, 2, 3.0, 0.1, None)], [(1, 2.0, "a")], [])
    assert pareto.layered_offers(lines.limit(0), items, sales).collect() == []
    # 300 * 90 over 200 * 2; no sale, so no delay
    assert [tuple(r) for r in pareto.layered_offers(lines, items.limit(0), sales).collect()] == [(1, 1, None, None, 10, None, 2, 1, 1, 1)]
    assert [tuple(r) for r in pareto.layered_offers(lines, items, sales).collect()] == [(1, 1, "a", 67, 10, None, 2, 1, 1, 1)]
