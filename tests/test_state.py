"""Streams with state by key, and the source that goes by a mark."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from mnemora.operators.snapshots import SnapshotTable
from mnemora.session import reachable
from mnemora.sources.cursor import cursor_stream
from mnemora.streaming import incremental, state

HOUR = 3_600_000_000


def brute(rows):
    out = {}
    for key, at, who in sorted(rows, key=lambda r: (r[0], r[1])):
        own = out.setdefault(key, [])
        if not own or at - own[-1][1] > 8 * HOUR:
            own.append([at, at, 0, set()])
        own[-1][1], own[-1][2] = at, own[-1][2] + 1
        own[-1][3].add(who)
    return sorted((k, s[0], s[1], s[2], ",".join(sorted(s[3]))) for k, own in out.items() for s in own)


def test_live_sessions_equal_a_batch_after_every_run(spark, tmp_path):
    reachable(spark)
    rng, seen, schema = random.Random(1), [], "chat long, ts timestamp, who string"
    for k in range(4):
        # a hot chat, gaps that later rows close, equal times
        batch = [(0 if rng.random() < 0.4 else rng.randint(1, 3), (rng.randint(0, 300) + 400) * HOUR, rng.choice("abc")) for _ in range(25)]
        seen += batch
        spark.createDataFrame(batch, "chat long, at long, who string").select("chat", F.timestamp_micros("at").alias("ts"), "who").write.mode("append").parquet(f"{tmp_path}/in")
        source = incremental.stream_files(spark, f"{tmp_path}/in", schema, "parquet")
        state.live_sessions(source, "chat", "ts", "who", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        assert sorted(tuple(r) for r in state.read_sessions(spark, f"{tmp_path}/out").collect()) == brute(seen), k


def test_live_sessions_hand_state_over_in_batches(spark, tmp_path):
    """Keys that are null, or not to be told apart as floats; what nothing reaches any more is forgotten, and late rows stay out."""
    reachable(spark)
    big, seen, schema = 1 << 60, [], "chat long, ts timestamp, who string"
    batches = [[(big + 1, 1000, "a"), (big, 1000, None), (None, 1000, "b")], [(None, 1004, "c"), (big, 1010, "d")], [(7, 1100, "x")], [(big, 1009, "z"), (7, 1101, "y")], [(7, 1120, "x")]]
    for batch in batches:
        spark.createDataFrame([(c, t * HOUR, w) for c, t, w in batch], "chat long, at long, who string").select("chat", F.timestamp_micros("at").alias("ts"), "who").write.mode("append").parquet(f"{tmp_path}/in")
        q = state.live_sessions(incremental.stream_files(spark, f"{tmp_path}/in", schema, "parquet"), "chat", "ts", "who", f"{tmp_path}/out", f"{tmp_path}/cp", keep="24 hours")
        q.awaitTermination()
        seen.append(q.lastProgress["stateOperators"][0])
    assert seen[0]["operatorName"] == "applyInPandasWithState"
    assert [s["numRowsTotal"] for s in seen][-1] == 1
    got = sorted(((c or 0, a // HOUR, b // HOUR, n, w) for c, a, b, n, w in (tuple(r) for r in state.read_sessions(spark, f"{tmp_path}/out").collect())), key=repr)
    want = [(0, 1000, 1004, 2, "b,c"), (7, 1100, 1101, 2, "x,y"), (7, 1120, 1120, 1, "x"), (big, 1000, 1000, 1, ""), (big, 1010, 1010, 1, "d"), (big + 1, 1000, 1000, 1, "a")]
    assert got == sorted(want, key=repr)


def test_only_grown_sessions_are_reloaded(spark, tmp_path):
    reachable(spark)
    loads = []

    def whole(due):
        loads.append(sorted((r.s, r.lines) for r in due.collect()))
        return spark.read.schema("s long, n long").parquet(f"{tmp_path}/in").join(due, "s", "left_semi").groupBy("s").agg(F.count("*").alias("n"))

    for many, few in ((49, 10), (1, 45), (49, 10), (60, 0)):
        spark.createDataFrame([(1, i) for i in range(many)] + [(2, i) for i in range(few)], "s long, n long").write.mode("append").parquet(f"{tmp_path}/in")
        source = incremental.stream_files(spark, f"{tmp_path}/in", "s long, n long", "parquet")
        state.reloaded_sessions(source, "s", whole, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert [x for x in loads if x] == [[(1, 50), (2, 55)], [(1, 159)]]
    assert sorted(tuple(r) for r in SnapshotTable(spark, f"{tmp_path}/out", ["s"]).read().collect()) == [(1, 159), (2, 55)]


def pull(spark, tmp_path, cap, bootstrap=True):
    source = cursor_stream(spark, f"file://{tmp_path}/in", "at", "id long, at long", cap, bootstrap)
    incremental.upsert_stream(source, f"{tmp_path}/out", "id", "at", f"{tmp_path}/cp").awaitTermination()


def test_a_mark_moves_only_over_whole_windows(spark, tmp_path):
    reachable(spark)
    held = lambda: sorted(r.id for r in SnapshotTable(spark, f"{tmp_path}/out", ["id"], "at", "id long, at long").read().collect())
    put = lambda *rows: spark.createDataFrame(list(rows), "id long, at long").write.mode("append").parquet(f"{tmp_path}/in")
    put((0, None))
    with pytest.raises(StreamingQueryException, match="BootstrapRequired"):
        pull(spark, tmp_path, 5, bootstrap=False)
    pull(spark, tmp_path, 5)  # sees nothing, and leaves no mark
    assert held() == []
    put((1, 10), (2, 11), (3, None))
    pull(spark, tmp_path, 5)
    assert held() == [1, 2]
    put((4, 11), (5, 12))  # one more at the mark itself
    pull(spark, tmp_path, 5, bootstrap=False)
    assert held() == [1, 2, 4, 5]
    put(*((10 + i, 20 + i) for i in range(5)))
    with pytest.raises(StreamingQueryException, match="Truncated"):
        pull(spark, tmp_path, 5)
    assert held() == [1, 2, 4, 5]
    pull(spark, tmp_path, 50)  # the same window again
    assert held() == [1, 2, 4, 5, *range(10, 15)]
