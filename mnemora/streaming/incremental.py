"""Incremental ingest with Structured Streaming: file sources, keyed upserts, sessions over arrivals.

A checkpoint takes the place of hand-kept cursors: a batch counts only when it is committed, and a restart
repeats it. Sinks are idempotent by key, so a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemora.functions.fixed import SESSION_GAP_HOURS
from mnemora.operators.index import TextIndex
from mnemora.operators.snapshots import SnapshotTable


def stream_files(spark: SparkSession, path: str, schema: str, fmt: str = "json", per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(fmt).load(path)


def upsert_stream(source: DataFrame, target: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Each batch's rows replace those of the same key in the table at target, the last by order.

    A batch writes its own rows; `SnapshotTable(target, [key], order)` reads the result.
    """
    schema = source.schema

    def store(batch: DataFrame, number: int) -> None:
        held = SnapshotTable(batch.sparkSession, target, [key], order, schema)
        held.put(batch, tag=(checkpoint, number))
        held.merge()

    return source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_stream(source: DataFrame, target: str, parent: str, whole: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Each batch names parents that changed; whole(batch) gives all of their children, which replace the old.

    A parent that a batch names and that has no children any more loses its old ones. A batch writes these
    children; `SnapshotTable(target, [parent])` reads the result.
    """

    def store(batch: DataFrame, number: int) -> None:
        held = SnapshotTable(batch.sparkSession, target, [parent])
        held.put(whole(batch), touched=batch, tag=(checkpoint, number))
        held.merge()

    return source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(source: DataFrame, index: TextIndex, checkpoint: str) -> StreamingQuery:
    """Keeps a full-text index up: each batch's rows (its key and fields) replace those of the same key.

    A row whose fields are all null takes its key out. Of rows that share a key in a batch one counts; give them in
    batches of their own if the order matters. A repeated batch changes nothing.
    """

    def store(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates([index.key]).persist()
        some = F.coalesce(*(F.col(f) for f in index.fields)).isNotNull()
        index.put(rows.filter(some))
        index.remove(rows.filter(~some))
        rows.unpersist()
        index.tidy()

    return source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_arrivals(source: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """Arrivals without repeats of a key within the delay; state older than that is dropped."""
    return source.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def session_stream(source: DataFrame, by: str, ts: str, who: str, hours: int = SESSION_GAP_HOURS, delay: str = "1 hour") -> DataFrame:
    """Sessions of a stream: a message continues a session if it comes within hours, also across batches.

    A session goes out once the watermark has passed its end, so one that is still open is held back.
    """
    window = F.session_window(F.col(ts), f"{hours} hours")
    return source.withWatermark(ts, delay).groupBy(by, window.alias("w")).agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count(F.lit(1)).alias("messages"), F.array_join(F.array_sort(F.collect_set(who)), ",").alias("participants")
    ).drop("w")


def sessions_to_reload(lines: DataFrame, loaded: DataFrame, least_new: int = 50) -> DataFrame:
    """Sessions with least_new lines or more since they were last loaded (session_id, lines)."""
    now = lines.groupBy("session_id").agg(F.count(F.lit(1)).alias("now"))
    old = loaded.select("session_id", F.col("lines").alias("before"))
    return now.join(old, "session_id", "left").filter(F.col("now") - F.coalesce("before", F.lit(0)) >= least_new).select("session_id", "now")


def dirty_threads(threads: DataFrame, arrivals: DataFrame) -> DataFrame:
    """threads with those that got messages set to pending again."""
    touched = arrivals.select("thread_id", F.lit(True).alias("__hit")).distinct()
    return threads.join(touched, threads["id"] == touched["thread_id"], "left").withColumn("extraction_status", F.when(F.col("__hit"), "pending").otherwise(F.col("extraction_status"))).select(threads.columns)


def cursor_moves(seen: Column, cap: int, known_before: Column) -> Column:
    """guard_cursor for a table of pulls."""
    return (seen < cap) & (known_before | (seen > 0))


def guard_cursor(seen: int, cap: int, known_before: bool) -> bool:
    """Whether a cursor may move: not if a pull was cut off at its cap, nor on a first run that saw nothing."""
    return seen < cap and (known_before or seen > 0)
