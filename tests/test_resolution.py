"""Reviewed merges in rounds, and pairs of people without a cap on blocks, against plain loops."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.operators import people as P


def follow(people, rows):
    into, mail = {}, dict(people)
    for _, a, b in sorted(rows):
        if a == b or a not in mail or b not in mail or a in into or b in into:
            continue
        keep, lose = (a, b) if (not mail[a], a) < (not mail[b], b) else (b, a)
        into[lose] = keep

    def last(x):
        while x in into:
            x = into[x]
        return x

    return {x: last(x) for x in into}


def merged(spark, people, rows):
    who = spark.createDataFrame([(i, "n", "m@x" if mail else None) for i, mail in people], "id long, name string, email string")
    df = spark.createDataFrame([(n, a, b, "merge") for n, a, b in rows], "n long, id_a long, id_b long, decision string")
    return {r.loser: r.survivor for r in P.reviewed_merges(who, df).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_rounds_equal_following_the_file(spark, seed):
    rng = random.Random(seed)
    people = [(i, rng.random() < 0.3) for i in range(40)]
    rows = [(n, rng.randint(0, 41), rng.choice([3, rng.randint(0, 41)])) for n in range(120)]
    assert merged(spark, people, rows) == follow(people, rows)


@pytest.mark.parametrize("shape", ["chain", "star"])
def test_long_chains_and_stars(spark, shape):
    n = 100_000
    people = spark.range(n + 1).select("id", F.lit("x").alias("name"), F.lit(None).cast("string").alias("email"))
    other = F.col("id") if shape == "chain" else F.lit(0).cast("long")
    rows = spark.range(n).select(F.col("id").alias("n"), other.alias("id_a"), (F.col("id") + 1).alias("id_b"), F.lit("merge").alias("decision"))
    got = P.reviewed_merges(people, rows)
    if shape == "star":
        assert got.filter("survivor = 0").count() == n == got.count()
    else:  # every second decision finds its first person gone
        assert got.filter("loser = survivor + 1 and survivor % 2 = 0").count() == n // 2 == got.count()


@pytest.mark.parametrize("threshold", [0.82, 0.6])
def test_pairs_without_a_cap_equal_all_pairs(spark, threshold):
    rng = random.Random(2)
    firsts = ["nikos", "nikolas", "nick", "maria", "marios", "mario", "", "zoe", "anna maria", "jo"]
    names = [f"{rng.choice(firsts)}{rng.choice(['', 'x', ' k'])} {rng.choice(['papadopoulos', 'papadopoulou', 'li'])}".strip() for _ in range(160)]
    people = spark.createDataFrame([(i, n, rng.choice([None, None, f"a{i % 5}@x"])) for i, n in enumerate(names)], "id long, name string, email string")
    known = people.select("id", "email", T.canonical_tokens(F.col("name")).alias("t"), T.surname_key(T.canonical_tokens(F.col("name"))).alias("s")).collect()
    want, compared = {}, 0
    for a in known:
        for b in known:
            if a.id < b.id and a.s and a.s == b.s and a.t != b.t and (a.email is None or b.email is None or a.email == b.email):
                compared += 1
                inside = set(a.t) <= set(b.t) or set(b.t) <= set(a.t)
                score = 0.9 if inside else difflib.SequenceMatcher(None, " ".join(a.t), " ".join(b.t)).ratio()
                if score >= threshold:
                    want[a.id, b.id] = score
    got = {(r.id_a, r.id_b): r.score for r in P.fuzzy_pairs(people, threshold, None, None).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 0.0005001 for k in want)
    named = people.select("id", T.canonical_tokens(F.col("name")).alias("tokens")).withColumn("surname", T.surname_key(F.col("tokens"))).withColumn("canon", F.array_join("tokens", " "))
    assert P._alike(named, 0.9).count() < compared / 2  # difflib sees these only


def test_pairs_of_large_blocks_are_all_found_in_tiles(spark):
    """A block of more than 60 people and more than 1,000 pairs, by the defaults, and dealt to tiles of a few rows."""
    rng = random.Random(3)
    names = [rng.choice(["Nikos", "Nikolas", "Nick", "Maria", "Marios", ""]) + rng.choice(["", "", " K.", " jo"]) + " Papadopoulos" for _ in range(130)]
    people = spark.createDataFrame([(i, n, rng.choice([None, None, f"a{i % 5}@x"])) for i, n in enumerate(names)], "id long, name string, email string")
    known = people.select("id", "email", T.canonical_tokens(F.col("name")).alias("t")).collect()
    want = {}
    for a in known:
        for b in known:
            if a.id < b.id and a.t != b.t and (a.email is None or b.email is None or a.email == b.email):
                inside = set(a.t) <= set(b.t) or set(b.t) <= set(a.t)
                score = 0.9 if inside else difflib.SequenceMatcher(None, " ".join(a.t), " ".join(b.t)).ratio()
                if score >= 0.82:
                    want[a.id, b.id] = score
    assert len(want) > 1000
    for tile in {}, {"tile": 7}:
        got = P.fuzzy_pairs(people, **tile)
        assert "Limit" not in got._jdf.queryExecution().optimizedPlan().toString()
        rows = [(r.id_a, r.id_b) for r in got.collect()]
        assert len(rows) == len(want) and set(rows) == set(want)
