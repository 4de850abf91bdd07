import math

import pytest
from pyspark.sql import functions as F

from mnemora.operators import search, vectors


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_bm25_formula_and_and(spark):
    texts = ["quokka " * 5, "a quokka in a long long text about other things", "nothing here", "Été quokka été", None]
    got = {r.id: r.score for r in search.bm25(docs(spark, texts), "id", ["text"], "quokka", 10).collect()}
    lengths = [5, 9, 2, 3, 0]
    average = sum(lengths) / 5
    idf = max(1e-6, math.log((5 - 3 + 0.5) / (3 + 0.5)))
    for i, tf in ((0, 5), (1, 1), (3, 1)):
        assert got[i] == pytest.approx(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[i] / average)), abs=1e-6)
    assert [r.id for r in search.bm25(docs(spark, texts), "id", ["text"], "ETE Quokka", 10).collect()] == [3]
    assert search.bm25(docs(spark, texts), "id", ["text"], '" - *', 10).collect() == []


def test_a_part_of_several_tokens_is_a_phrase(spark):
    df = docs(spark, ["report Q1-2026 final", "2026 report q1", "q1 2026"])
    assert {r.id for r in search.bm25(df, "id", ["text"], "Q1-2026", 10).collect()} == {0, 2}
    assert {r.id for r in search.bm25(df, "id", ["text"], "q1 2026 final", 10, phrase=True).collect()} == {0}


def test_waterfall_takes_only_places_left(spark):
    one = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    two = spark.createDataFrame([(2, 1), (1, 2), (9, 3), (8, 4)], "id long, rank int")
    got = search.waterfall([("a", one), ("b", two)], "id", 4)
    # two places are left, both go to rows that are known already, so fewer than four come back
    assert sorted((r.place, r.id, r.source) for r in got.collect()) == [(1, 1, "a"), (2, 2, "a")]
    got = search.waterfall([("a", one), ("b", two)], "id", 6)
    assert sorted((r.place, r.id, r.source) for r in got.collect()) == [(1, 1, "a"), (2, 2, "a"), (3, 9, "b"), (4, 8, "b")]


def test_snippet(spark):
    text = " ".join(f"w{i}" for i in range(50)) + " needle " + " ".join(f"x{i}" for i in range(50))
    s = docs(spark, [text]).select(search.snippet(F.col("text"), "needle", "[", "]", 9).alias("s")).first().s
    assert "[needle]" in s and s.startswith("...") and s.endswith("...") and len(s.split()) == 9


def test_rrf(spark):
    lists = {"a": ["x", "y", "z"], "b": ["y", "x", "x", "w"]}
    rows = [(n, i, r) for n, ids in lists.items() for r, i in enumerate(ids, 1)]
    got = [(r.id, r.score) for r in vectors.rrf(spark.createDataFrame(rows, "list string, id string, rank int")).collect()]
    assert [i for i, _ in got] == ["x", "y", "z", "w"] and got[0][1] == pytest.approx(1 / 61 + 1 / 62) and got[3][1] == pytest.approx(1 / 64)
    swapped = [({"a": "b", "b": "a"}[n], i, r) for n, i, r in rows]
    assert [(r.id, r.score) for r in vectors.rrf(spark.createDataFrame(swapped, "list string, id string, rank int")).collect()] == got


def test_hybrid_falls_back_to_keywords(spark):
    kw = spark.createDataFrame([(5, 1), (3, 2)], "id long, rank int")
    assert [(r.id, r.source) for r in vectors.hybrid(kw, None, 5).orderBy("place").collect()] == [(5, "keyword"), (3, "keyword")]
    sem = spark.createDataFrame([(9, 1), (5, 2)], "id long, rank int")
    assert [(r.id, r.source) for r in vectors.hybrid(kw, sem, 5).orderBy("place").collect()] == [(5, "keyword"), (9, "semantic"), (3, "keyword")]


def test_cosine_and_namespaces(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None)], "id long, v array<float>")
    got = [(r.id, r.similarity) for r in vectors.cosine_top_k(df, "id", "v", [2.0, 0.0], 2).collect()]
    assert got == [(1, 1.0), (3, pytest.approx(0.70711))]
    hits = spark.createDataFrame([("email", 10, 0.5), ("attachment", 7, 0.9), ("attachment", 8, 0.8), ("thread", 1, 1.0)], "kind string, entity long, similarity double")
    parents = spark.createDataFrame([(7, 10)], "attachment_id long, email_id long")
    assert [(r.email_id, r.similarity) for r in vectors.fold_to_emails(hits, parents).collect()] == [(10, 0.9)]
    ids = spark.createDataFrame([("email", 5), ("thread", 9), ("conversation", 4), ("attachment", 7)], "kind string, entity long")
    back = ids.withColumn("x", vectors.decode_vector_id(vectors.encode_vector_id(F.col("kind"), F.col("entity")))).filter("x.kind <> kind or x.entity <> entity")
    assert back.collect() == []
