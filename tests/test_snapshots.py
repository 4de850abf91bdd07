"""Tables with versions: what readers see while others write, what a crash leaves, and what a batch costs."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from mnemora.operators import snapshots
from mnemora.operators.snapshots import Conflict, SnapshotTable
from mnemora.sources import readers
from mnemora.streaming import incremental

SCHEMA = "id long, v string, n long"


def rows(spark, *found):
    return spark.createDataFrame(list(found), SCHEMA)


def held(table):
    return {r.id: r.v for r in table.read().collect()}


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["_segment", "_publish", "_name"])
@pytest.mark.parametrize("after", [False, True])
def test_a_crash_at_any_step(spark, tmp_path, monkeypatch, step, after):
    t = SnapshotTable(spark, f"{tmp_path}/t", ["id"], "n")
    t.put(rows(spark, (1, "a", 1), (2, "b", 1)))
    seen = t.read()
    whole = getattr(SnapshotTable, step)

    def broken(self, *a):
        if after:
            whole(self, *a)
        raise Crash

    monkeypatch.setattr(SnapshotTable, step, broken)
    with pytest.raises(Crash):
        t.put(rows(spark, (1, "c", 2), (3, "d", 2)))
    monkeypatch.undo()
    old, new = {1: "a", 2: "b"}, {1: "c", 2: "b", 3: "d"}
    assert held(t) == (new if after and step != "_segment" else old)
    assert {r.id: r.v for r in seen.collect()} == old
    t.put(rows(spark, (1, "c", 2), (3, "d", 2)))  # the batch comes again
    assert held(t) == new
    t.expire(keep=1, hours=0)
    assert held(t) == new and len(os.listdir(tmp_path / "t" / "versions")) == 1
    assert len(os.listdir(tmp_path / "t" / "data")) == len(t.manifest()["segments"])


def test_a_reader_at_every_step_sees_old_or_new(spark, tmp_path, monkeypatch):
    t = SnapshotTable(spark, f"{tmp_path}/t", ["id"])
    t.put(rows(spark, *((i, "old", 1) for i in range(20))))
    seen = []

    def look(f):
        def run(self, *a):
            seen.append(held(SnapshotTable(spark, f"{tmp_path}/t", ["id"])))
            out = f(self, *a)
            seen.append(held(SnapshotTable(spark, f"{tmp_path}/t", ["id"])))
            return out

        return run

    for step in ("_segment", "_publish", "_name"):
        monkeypatch.setattr(SnapshotTable, step, look(getattr(SnapshotTable, step)))
    t.put(rows(spark, *((i, "new", 2) for i in range(25))))
    old, new = dict.fromkeys(range(20), "old"), dict.fromkeys(range(25), "new")
    assert len(seen) == 6 and seen[0] == old and seen[-1] == new and all(x in (old, new) for x in seen)


def test_writers_at_once_lose_nothing(spark, tmp_path):
    errors = []

    def write(w):
        try:
            t = SnapshotTable(spark, f"{tmp_path}/t", ["id"], "n", SCHEMA)
            for k in range(4):
                t.put(rows(spark, (w * 10 + k, f"{w}", 1), (999, f"{w}-{k}", w * 10 + k)))
                t.merge()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not errors
    t = SnapshotTable(spark, f"{tmp_path}/t", ["id"], "n")
    assert held(t) == {w * 10 + k: f"{w}" for w in range(4) for k in range(4)} | {999: "3-3"}


def test_a_rewrite_starts_again_from_what_others_wrote(spark, tmp_path):
    t = SnapshotTable(spark, f"{tmp_path}/t", ["id"])
    t.put(rows(spark, (1, "a", 1)))
    calls = []

    def change(old):
        if not calls:
            SnapshotTable(spark, f"{tmp_path}/t", ["id"]).put(rows(spark, (2, "b", 1)))
        calls.append(1)
        return old.withColumn("v", F.upper("v"))

    t.rewrite(change)
    assert len(calls) == 2 and held(t) == {1: "A", 2: "B"}


def test_too_many_conflicts_are_an_error(spark, tmp_path, monkeypatch):
    t = SnapshotTable(spark, f"{tmp_path}/t", ["id"])
    monkeypatch.setattr(snapshots, "TRIES", 2)
    monkeypatch.setattr(SnapshotTable, "_publish", lambda self, m: False)
    with pytest.raises(Conflict):
        t.put(rows(spark, (1, "a", 1)))


def test_one_percent_of_the_keys(spark, tmp_path):
    t = SnapshotTable(spark, f"{tmp_path}/t", ["id"], "n")
    t.put(spark.range(50_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(1).cast("long").alias("n")))
    before = {s["id"]: s["bytes"] for s in t.manifest()["segments"]}
    t.put(spark.range(500).select((F.col("id") * 100).alias("id"), F.lit("new").alias("v"), F.lit(2).cast("long").alias("n")))
    t.merge()
    after = {s["id"]: s["bytes"] for s in t.manifest()["segments"]}
    assert set(before) < set(after) and sum(after.values()) - sum(before.values()) < 0.1 * sum(before.values())
    assert t.read().filter("v = 'new'").count() == 500 and t.read().count() == 50_000


@pytest.mark.parametrize("order", [None, "n"])
def test_against_a_dict(spark, tmp_path, order):
    rng, t, want = random.Random(4), SnapshotTable(spark, f"{tmp_path}/t", ["id"], order, SCHEMA), {}
    assert t.read().collect() == []
    written, stamp = 0, 0
    for k in range(12):
        batch = [(rng.randint(0, 30) if rng.random() < 0.9 else None, f"{k}", rng.choice([None, *range(5)])) for _ in range(rng.choice([1, 3, 20]))]
        if order:
            batch = [*{r[0]: r for r in batch}.values()]
            for r in batch:
                was = want.get(r[0])
                if was is None or (r[2] is not None and (was[2] is None or r[2] >= was[2])) or (r[2] is None and was[2] is None):
                    want[r[0]] = r
            t.put(rows(spark, *batch))
        else:
            gone = [(rng.randint(0, 30),) for _ in range(2)]
            touched = {r[0] for r in batch} | {g[0] for g in gone}
            want = {i: x for i, x in want.items() if i not in touched}
            for r in batch:
                want.setdefault(r[0], []).append(r)
            t.put(rows(spark, *batch), touched=spark.createDataFrame([(i,) for i in touched], "id int"))
        if k % 3:
            t.merge()
        got = sorted(map(tuple, t.read().collect()), key=repr)
        assert got == sorted(want.values() if order else [r for own in want.values() for r in own], key=repr)
    assert len(t.manifest()["segments"]) <= 6


def test_a_pinned_version_stays(spark, tmp_path):
    t = SnapshotTable(spark, f"{tmp_path}/t", ["id"])
    first = t.put(rows(spark, (1, "a", 1)))
    t.put(rows(spark, (1, "b", 2)))
    t.merge()
    assert [r.v for r in t.read(first).collect()] == ["a"] and held(t) == {1: "b"}
    assert {r.id: r.v for r in readers.table(spark, f"{tmp_path}/t", key=["id"]).collect()} == {1: "b"}
    with pytest.raises(FileNotFoundError):
        SnapshotTable(spark, f"{tmp_path}/none", ["id"]).read()


def test_a_batch_that_was_committed_is_not_written_again(spark, tmp_path):
    t = SnapshotTable(spark, f"{tmp_path}/t", ["id"])
    t.put(rows(spark, (1, "a", 1)), tag=("s", 3))
    assert t.put(rows(spark, (1, "b", 1)), tag=("s", 3)) == 1 == t.put(rows(spark, (1, "b", 1)), tag=("s", 2))
    assert held(t) == {1: "a"}
    t.put(rows(spark, (1, "c", 1)), tag=("s", 4))
    assert held(t) == {1: "c"}


def test_a_reader_during_a_stream_loses_no_batch(spark, tmp_path, monkeypatch):
    """What a reader does must not make a writer's batch vanish."""
    src, target = f"{tmp_path}/in", f"{tmp_path}/out"
    whole = SnapshotTable._publish

    def read_between(self, manifest):
        readers.table(spark, target, SCHEMA, ["id"], "n").count()
        done = whole(self, manifest)
        readers.table(spark, target, SCHEMA, ["id"], "n").count()
        return done

    monkeypatch.setattr(SnapshotTable, "_publish", read_between)
    for k in range(3):
        rows(spark, *((i, f"{k}", k) for i in range(k, 5))).write.mode("append").json(src)
        incremental.upsert_stream(incremental.stream_files(spark, src, SCHEMA), target, "id", "n", f"{tmp_path}/cp").awaitTermination()
    assert {r.id: r.v for r in readers.table(spark, target, SCHEMA, ["id"], "n").collect()} == {0: "0", 1: "1", 2: "2", 3: "2", 4: "2"}
