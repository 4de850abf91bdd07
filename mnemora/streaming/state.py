"""Streams that keep state by key: sessions that go out while they are open, and sessions that are reloaded when they grew.

Both keep small summaries by key and never rows, so a key that holds much of a stream costs a task no more memory
than its sessions (and those of its bucket's other keys). State lies in the checkpoint, so a stream that is started again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mnemora.functions.fixed import SESSION_GAP_HOURS
from mnemora.operators.snapshots import SnapshotTable

#: State on disk, of which a batch adds a log of its changes to the checkpoint and no copy of the store's files.
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


#: Keys are dealt to so many buckets, whose state goes to Python and back as a whole. A stream that goes on keeps their number.
BUCKETS = 4096
_SESSIONS = "name array<string>, started array<long>, ended array<long>, n array<long>, who array<array<string>>"


def _session_lists(gap: int, keep: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The sessions of a bucket's keys: a row goes into the one that it is near, opens one, or joins two.

    A call for each key would cost more than its rows, so one takes a bucket of keys.
    """

    def step(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [[*s[:4], set(s[4])] for s in zip(*state.get)] if state.exists else []
        before = {(s[0], s[1]): (s[2], s[3]) for s in held}
        # after a timeout there are no rows
        for part in () if state.hasTimedOut else parts:
            held += [[name, at, at, 1, set() if who is None else {who}] for name, at, who in zip(part["name"].tolist(), part["at"].tolist(), part["who"].tolist())]
            held.sort(key=lambda s: (s[0], s[1]))
            whole = held[:1]
            for s in held[1:]:
                last = whole[-1]
                if s[0] != last[0] or s[1] - last[2] > gap:
                    whole.append(s)
                else:
                    last[2:] = [max(last[2], s[2]), last[3] + s[3], last[4] | s[4]]
            held = whole
        now = {(s[0], s[1]) for s in held}
        out = [(*start, 0, 0, None, True) for start in before if start not in now]
        out += [(*s[:4], ",".join(sorted(s[4])), False) for s in held if before.get((s[0], s[1])) != (s[2], s[3])]
        # what nothing can reach any more is forgotten; it went out before
        left = [s for s in held if s[2] + gap + keep > state.getCurrentWatermarkMs() * 1000]
        if left:
            state.update(tuple(map(list, zip(*[(*s[:4], sorted(s[4])) for s in left]))))
            state.setTimeoutTimestamp((max(s[2] for s in left) + gap + keep) // 1000 + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(dict(zip(("name", "started", "ended", "n", "who", "gone"), map(list, zip(*out)))))

    return step


def _with_rocks(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Starts a query whose state needs this store; other queries of the session keep theirs."""
    old = {name: spark.conf.get(name, None) for name in _ROCKS}
    for name, value in _ROCKS.items():
        spark.conf.set(name, value)
    try:
        return start()
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def live_sessions(source: DataFrame, by: str, ts: str, who: str, target: str, checkpoint: str, hours: int = SESSION_GAP_HOURS, keep: str = "30 days") -> StreamingQuery:
    """Keeps the table of sessions at target: a session is there once it opens, grows, and is joined by late rows.

    Rows that come later than `keep` after the newest one are left out, and sessions are forgotten as long after their
    end. `read_sessions` reads the table. Rows without a time are in no session.
    """
    kind, at = dict(source.dtypes)[by], F.col(ts).cast("timestamp")
    # names of keys are never null, as pandas would make numbers with nulls floats
    name = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    rows = source.filter(F.col(ts).isNotNull()).select(F.pmod(F.xxhash64(name), F.lit(BUCKETS)).alias("bucket"), name.alias("name"), at.alias("ts"), F.unix_micros(at).alias("at"), F.col(who).cast("string").alias("who"))
    key = F.when(F.col("name") != "", F.substr("name", F.lit(2)).cast(kind)).alias("key")
    days = source.sparkSession.sql(f"select interval {keep}").first()[0]
    lists = _session_lists(hours * 3_600_000_000, int(days.total_seconds() * 1_000_000))
    schema = "name string, started long, ended long, n long, who string, gone boolean"

    def store(batch: DataFrame, number: int) -> None:
        held = SnapshotTable(batch.sparkSession, target, ["key", "started"])
        found = batch.persist()
        held.put(found.filter("not gone").drop("gone"), touched=found, tag=(checkpoint, number))
        found.unpersist()
        held.merge()

    changed = rows.withWatermark("ts", keep).groupBy("bucket").applyInPandasWithState(lists, schema, _SESSIONS, "update", "EventTimeTimeout").select(key, "started", "ended", "n", "who", "gone")
    return _with_rocks(source.sparkSession, lambda: changed.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_sessions(spark: SparkSession, target: str) -> DataFrame:
    """key, started, ended (microseconds), n, who of the sessions at target."""
    return SnapshotTable(spark, target, ["key", "started"]).read()


class LineCounts(StatefulProcessor):
    """The lines of each session that were seen, and how many there were when it was last loaded."""

    def __init__(self, least_new: int):
        self.least_new = least_new

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "seen long, loaded long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        seen, loaded = self.counts.get() if self.counts.exists() else (0, 0)
        seen += sum(1 for _ in rows)
        due = seen - loaded >= self.least_new
        self.counts.update((seen, seen if due else loaded))
        if due:
            yield Row(key=key[0], lines=seen)

    def close(self) -> None:
        pass


def reloaded_sessions(lines: DataFrame, by: str, whole: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, least_new: int = 50) -> StreamingQuery:
    """Loads a session again, whole, each time it has least_new lines more than when it was loaded.

    whole: from sessions (a column named as `by`, and lines) to all rows of each of them; these replace what the table
    at target has of the session.
    """
    kind = dict(lines.dtypes)[by]
    due = lines.select(F.col(by).alias("key")).filter("key is not null").groupBy("key").transformWithState(LineCounts(least_new), f"key {kind}, lines long", "Update", "None")

    def store(batch: DataFrame, number: int) -> None:
        held = SnapshotTable(batch.sparkSession, target, [by])
        found = batch.withColumnRenamed("key", by).persist()
        held.put(whole(found), touched=found, tag=(checkpoint, number))
        found.unpersist()
        held.merge()

    return _with_rocks(lines.sparkSession, lambda: due.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
