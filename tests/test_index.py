"""The full-text index against search over the texts themselves, through puts, replacements, removals and merging."""

import os
import random
import re

import pytest
from mnemora.operators import search
from mnemora.operators.index import TextIndex

SCHEMA = "id long, title string, body string"


def rows(rng, ids):
    words = ["alpha", "beta", "Gamma", "été", "q1", "2026", "the", "the", "of"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "-", "."]) for _ in range(rng.randint(0, n)))
    return {i: (text(4) if rng.random() < 0.9 else None, text(40)) for i in ids}


def frame(spark, store):
    return spark.createDataFrame([(i, *v) for i, v in store.items()], SCHEMA)


def check(spark, index, store):
    df = frame(spark, store)
    for query, phrase, columns in [("alpha beta", False, ["body"]), ("the of", True, ["body"]), ("Q1-2026 ETE", False, ["body"]), ("the the", True, ["title"]), ("gamma", False, ["title", "body"]), ("nowhere", False, ["body"]), ("--", False, ["body"])]:
        got = [(r.id, r.score) for r in index.bm25(query, 15, phrase, columns).collect()]
        want = [(r.id, r.score) for r in search.bm25(df, "id", columns, query, 15, phrase).collect()]
        assert got == want, (query, phrase, columns)


def test_index_equals_search_over_texts(spark, tmp_path):
    rng = random.Random(3)
    store = rows(rng, range(120))
    index = TextIndex(spark, f"{tmp_path}/ix", "id", ["title", "body"], buckets=5)
    assert index.bm25("alpha").collect() == []
    index.put(frame(spark, store))
    check(spark, index, store)
    again = rows(rng, range(100, 140))
    index.put(frame(spark, again))
    store |= again
    check(spark, index, store)
    index.remove(spark.createDataFrame([(5,), (110,), (999,)], "id long"))
    for i in (5, 110):
        del store[i]
    check(spark, index, store)
    back = rows(rng, [5])
    index.put(frame(spark, back))
    check(spark, index, store | back)
    whole = index.merged(f"{tmp_path}/merged")
    check(spark, whole, store | back)
    assert whole._segments() == [1] and len(index._segments()) == 4


def test_a_crashed_put_counts_for_nothing(spark, tmp_path):
    store = rows(random.Random(4), range(30))
    index = TextIndex(spark, f"{tmp_path}/ix", "id", ["title", "body"]).put(frame(spark, store))
    index.put(frame(spark, rows(random.Random(5), range(20, 40))))
    os.rename(f"{tmp_path}/ix/segment-2/totals/_SUCCESS", f"{tmp_path}/lost")
    check(spark, index, store)
    index.put(frame(spark, {50: ("alpha", "beta")}))
    check(spark, index, store | {50: ("alpha", "beta")})


def test_edges(spark, tmp_path):
    store = {1: (None, None), 2: ("", " -- "), None: ("alpha", "alpha")}
    index = TextIndex(spark, f"{tmp_path}/ix", "id", ["title", "body"]).put(frame(spark, store))
    assert index.bm25("alpha").collect() == []
    with pytest.raises(ValueError, match="repeats"):
        index.put(spark.createDataFrame([(7, "a", "b"), (7, "c", "d")], SCHEMA))
    names = TextIndex(spark, f"{tmp_path}/names", "name", ["t"]).put(spark.createDataFrame([("x", "one two"), ("y", "two")], "name string, t string"))
    assert [r.name for r in names.bm25("one").collect()] == ["x"]


def test_a_search_reads_no_text(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/ix", "id", ["title", "body"]).put(frame(spark, rows(random.Random(6), range(50))))
    plan = index.bm25("the of", 5, True)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    # two scans (frequencies, hits), each of the terms' folders and row groups and of no text
    assert len(scans) == 2 and all("PartitionFilters: [bucket" in x and "PushedFilters: [In(term" in x for x in scans)
    assert all(set(re.findall(r"(\w+)#", x.split("[")[1])) <= {"key", "field", "term", "positions", "lengths", "bucket"} for x in scans)


def test_queries_with_operators(spark, tmp_path):
    rng = random.Random(8)
    store = rows(rng, range(150))
    index = TextIndex(spark, f"{tmp_path}/ix", "id", ["title", "body"]).put(frame(spark, store))
    words = {i: [re.findall(r"[a-z0-9]+", (t or "").lower().replace("é", "e")) for t in v] for i, v in store.items()}
    has = lambda i, w: any(w in f for f in words[i])
    near = lambda i, *p: any(tuple(f[k : k + len(p)]) == p for f in words[i] for k in range(len(f)))
    pre = lambda i, p: any(w.startswith(p) for f in words[i] for w in f)
    cases = {
        "alpha": lambda i: has(i, "alpha"),
        "alpha NOT beta": lambda i: has(i, "alpha") and not has(i, "beta"),
        "Alpha AND beta OR ÉTÉ NOT gamma": lambda i: (has(i, "alpha") and has(i, "beta")) or (has(i, "ete") and not has(i, "gamma")),
        'alpha ("the of" OR q1-2026)': lambda i: has(i, "alpha") and (near(i, "the", "of") or near(i, "q1", "2026")),
        "ga* bet*": lambda i: pre(i, "ga") and pre(i, "bet"),
        "(alpha OR beta) NOT (gamma OR the)": lambda i: (has(i, "alpha") or has(i, "beta")) and not (has(i, "gamma") or has(i, "the")),
    }
    for query, want in cases.items():
        assert {r.id for r in index.matching(query).collect()} == {i for i in store if want(i)}, query
    for wrong in ("", "AND a", "a OR", "(a", "a)", '"a', "a NOT", "--", "*"):
        with pytest.raises(ValueError):
            index.matching(wrong)


def test_an_index_of_the_queries_outlives_intermediate_tables(spark):
    from mnemora import session
    from mnemora.plans.views import Views
    from tests.compare import SF_DIR

    first = Views(spark, SF_DIR).item_index()
    session.clean(spark)
    again = Views(spark, SF_DIR).item_index()
    assert again is first and again.bm25("the", 3).count() == 3


def test_a_stream_keeps_the_index_equal_to_a_rebuild(spark, tmp_path):
    from mnemora.streaming import incremental

    rng, store = random.Random(8), {}
    index = TextIndex(spark, f"{tmp_path}/ix", "id", ["title", "body"], buckets=3)
    for k in range(5):
        batch = rows(rng, rng.sample(range(60), 25))
        gone = rng.sample(sorted(store), min(4, len(store)))
        store = {i: v for i, v in store.items() if i not in gone} | {i: v for i, v in batch.items() if i not in gone}
        arrived = [(i, *v) for i, v in batch.items() if i not in gone] + [(i, None, None) for i in gone]
        spark.createDataFrame(arrived, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        incremental.index_stream(incremental.stream_files(spark, f"{tmp_path}/in", SCHEMA, "parquet"), index, f"{tmp_path}/cp").awaitTermination()
    check(spark, index, store)
    assert len(index._segments()) <= 4
    index.forget()
    check(spark, index, store)
    assert len([n for n in os.listdir(f"{tmp_path}/ix") if n.startswith("segment")]) == len(index._segments())


def test_a_merge_that_crashed_counts_for_nothing(spark, tmp_path):
    store = rows(random.Random(4), range(30))
    index = TextIndex(spark, f"{tmp_path}/ix", "id", ["title", "body"]).put(frame(spark, store))
    more = rows(random.Random(5), range(20, 40))
    index.put(frame(spark, more)).tidy()
    assert index._segments() == [3]
    check(spark, index, store | more)
    os.rename(f"{tmp_path}/ix/segment-3/totals/_SUCCESS", f"{tmp_path}/lost")
    assert index._segments() == [1, 2]
    check(spark, index, store | more)


def test_postings_are_made_within_rows_and_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """Tasks that sort postings are as many as the postings need, and rows without a token are there too."""
    from mnemora.operators import index as I

    monkeypatch.setattr(I, "SORTED", 20)
    rows = [(i, None if i == 7 else f"w{i % 5} the x{i} the", "" if i % 2 else "the head") for i in range(60)]
    made = I.TextIndex(spark, str(tmp_path / "i"), "id", ["a", "b"], buckets=2).put(spark.createDataFrame(rows, "id long, a string, b string"))
    assert made._table(1, "rows").count() == 60 and {tuple(r.lengths) for r in made._table(1, "rows").filter("key in (7, 8)").collect()} == {(0, 0), (4, 2)}
    files = [n for n in (tmp_path / "i/segment-1/postings").rglob("*.parquet")]
    assert len(files) > 8
    got = {(r.key, r.field, r.term): r.positions for r in made._table(1, "postings").collect()}
    want = {}
    for i, a, b in rows:
        for f, text in (("a", a), ("b", b)):
            for at, w in enumerate((text or "").split()):
                want.setdefault((i, f, w), []).append(at)
    assert got == want
