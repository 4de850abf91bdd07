"""What a crash, a retry or a repeated batch must not lose."""

import json
import os

import pytest
from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.operators import people as P
from mnemora.operators.snapshots import SnapshotTable
from mnemora.sources import readers
from mnemora.streaming import incremental


def test_only_an_absent_table_is_empty(spark, tmp_path):
    assert readers.table(spark, f"{tmp_path}/none", "id long").collect() == []
    with pytest.raises(Exception):  # noqa: B017
        readers.table(spark, f"{tmp_path}/none")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_text("not parquet")
    with pytest.raises(Exception):  # noqa: B017
        readers.table(spark, f"{tmp_path}/broken", "id long").collect()


def test_a_parent_that_lost_all_children(spark, tmp_path):
    src, target = tmp_path / "in", f"{tmp_path}/out"
    src.mkdir()
    children = {1: ["a", "b"], 2: ["c"]}

    def whole(batch):
        rows = [(p, c) for p in {r.parent for r in batch.collect()} for c in children[p]]
        return batch.sparkSession.createDataFrame(rows, "parent long, child string")

    for k, parents in enumerate([[1, 2], [1]]):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"parent": p}) for p in parents))
        stream = incremental.stream_files(spark, str(src), "parent long")
        incremental.replace_stream(stream, target, "parent", whole, f"{tmp_path}/cp").awaitTermination()
        got = {(r.parent, r.child) for r in SnapshotTable(spark, target, ["parent"]).read().collect()}
        assert got == ({(1, "a"), (1, "b"), (2, "c")} if k == 0 else {(2, "c")})
        children[1] = []


def test_reviewed_merges_in_order(spark):
    people = spark.createDataFrame([(i, f"p{i}", "e@x" if i == 5 else " " if i == 6 else None) for i in range(1, 9)], "id long, name string, email string")
    rows = lambda *r: spark.createDataFrame([(n, a, b, d) for n, (a, b, d) in enumerate(r)], "n long, id_a long, id_b long, decision string")
    merged = lambda *r: {m.loser: m.survivor for m in P.reviewed_merges(people, rows(*r)).collect()}
    assert merged((1, 2, "merge"), (2, 3, "merge")) == {2: 1}  # 2 is gone when the second is looked at
    assert merged((2, 3, "merge"), (1, 2, "Merge ")) == {3: 1, 2: 1}  # what was merged into 2 follows it
    assert merged((1, 5, "merge"), (1, 6, "merge"), (6, 7, "merge"), (3, 99, "merge"), (3, 4, "no"), (3, 3, "merge"), (8, 7, None)) == {1: 5, 7: 6}
    assert merged() == {}


def test_review_file(spark, tmp_path):
    people = spark.createDataFrame([(1, "Nikos Papadopoulos", "a@x"), (2, "Papadopoulos", None), (3, "Nikolas Papadopoulos", None)], "id long, name string, email string")
    rows = P.review_rows(people, P.fuzzy_pairs(people, 0.1))
    P.write_review(rows, f"{tmp_path}/review")
    (file,) = [f for f in os.listdir(tmp_path / "review") if f.endswith(".json")]
    lines = [json.loads(x) for x in (tmp_path / "review" / file).read_text().splitlines()]
    assert len(lines) == rows.count() > 1 and all(x["decision"] == "" and {"name_a", "email_a", "name_b", "email_b"} <= set(x) for x in lines)
    assert [x["score"] for x in lines] == sorted((x["score"] for x in lines), reverse=True)
    for x in lines:
        x["decision"] = "MERGE"
    (tmp_path / "done.jsonl").write_text("\n".join([*map(json.dumps, lines), "", "not json"]))
    back = P.read_review(spark, f"{tmp_path}/done.jsonl")
    assert [(r.id_a, r.id_b) for r in back.orderBy("n").collect()] == [(x["id_a"], x["id_b"]) for x in lines]
    assert {m.survivor for m in P.reviewed_merges(people, back).collect()} <= {1, 2}


def test_ids_with_ties_and_forced_coalescing(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
        fresh = spark.range(20_000).select((F.col("id") % 300).alias("n"), F.concat(F.lit("x"), "id").alias("name"))
        got = P.with_ids(fresh, spark.createDataFrame([(41,)], "id long"), "n").orderBy("id").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r.id for r in got] == list(range(42, 20_042))
    assert [(r.n, r.name) for r in got] == sorted((r.n, r.name) for r in got)


def test_marks_of_all_scripts(spark):
    texts = ["Ång ς ά ё", "ḗ", "क़ि", "שָׁלוֹם", "مُحَمَّد", "ガ", "plain", None, "한글 ㄱ", "ẹ́"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in rows.select("t", T.strip_accents(F.col("t")).alias("fast"), T.strip_accents_all(F.col("t")).alias("whole")).collect():
        assert r.fast == r.whole, r.t


def test_session_files(spark, tmp_path):
    for folder, name, at in (("-home-me-Alpha", "a.jsonl", 100), ("-home-me-Alpha", "b.jsonl", 90), ("-home-me-beta", "c.jsonl", 95), ("-home-me-beta", "d.txt", 99), (".", "e.jsonl", 99), ("-home-me-beta/deep", "f.jsonl", 99)):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text("{}")
        os.utime(tmp_path / folder / name, (at * 86400, at * 86400))
    names = lambda **k: [r.path.rsplit("/", 1)[1] for r in readers.session_files(spark, str(tmp_path), "1970-04-11 12:00:00", **k).collect()]
    assert names() == ["a.jsonl", "c.jsonl", "b.jsonl"]
    assert names(days=6) == ["a.jsonl", "c.jsonl"] and names(workspace="alpha") == ["a.jsonl", "b.jsonl"]
    assert readers.session_files(spark, "/no/such", "1970-01-01").collect() == []
