"""Queries of streams: the driver's events arrive as files, in several batches, and what the sinks hold is the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemora.plans.catalog import query
from mnemora.session import fresh_path
from mnemora.sources import readers
from mnemora.sources.cursor import cursor_stream
from mnemora.streaming import incremental as I
from mnemora.streaming import state as S


def _in_parts(v, rows: DataFrame, parts: int, start: Callable[[DataFrame], StreamingQuery], told: list[str] | None = None) -> None:
    """rows arrive as files, a part of the event_ids after the other; after each part the stream runs again.

    told gets the folder of the files.
    """
    folder = fresh_path(v.spark, "arrivals")
    if told is not None:
        told.append(folder)
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    last = rows.agg(F.max("event_id")).first()[0] or 0
    for k in range(parts):
        rows.filter(F.expr(f"event_id * {parts} div {last + 1} = {k}")).write.mode("append").parquet(folder)
        start(I.stream_files(v.spark, folder, schema, "parquet")).awaitTermination()


def _written(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _table(v, path: str, schema: str, key: str, order: str | None = None):
    return readers.table(v.spark, path, schema, [key], order)


@query("stream_upserts", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1")
def stream_upserts(v):
    """The last event of each user, kept up over micro-batches; the first of them arrive twice."""
    rows = v.table("events").select("user_id", "event_id", "event_type")
    target = fresh_path(v.spark, "latest")
    for part, parts in ((rows, 4), (rows.filter("event_id < 1000"), 2)):
        checkpoint = fresh_path(v.spark, "checkpoint")
        _in_parts(v, part, parts, lambda source: I.upsert_stream(source, target, "user_id", "event_id", checkpoint))  # noqa: B023
    return _table(v, target, "user_id long, event_id long, event_type string", "user_id", "event_id")


@query("stream_children", """
select user_id, event_type, count(*) as n from events where event_type <> 'error' group by all
""")
def stream_children(v):
    """Users' counts by type, counted anew from the store for the users of each batch."""
    events = v.table("events")
    target = fresh_path(v.spark, "children")

    def whole(batch):
        mine = events.join(batch.select("user_id").distinct(), "user_id", "left_semi")
        return mine.filter("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))

    checkpoint = fresh_path(v.spark, "checkpoint")
    _in_parts(v, events.select("user_id", "event_id"), 3, lambda source: I.replace_stream(source, target, "user_id", whole, checkpoint))
    return _table(v, target, "user_id long, event_type string, n long", "user_id")


@query("stream_distinct", "select user_id, min(event_type) as event_type from (select user_id, event_type, row_number() over (partition by user_id order by event_id) as r from events) where r = 1 group by 1")
def stream_distinct(v):
    """The first arrival of each user, however often one comes; the watermark lags by more than all events span."""
    rows = v.table("events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    folder, checkpoint = fresh_path(v.spark, "distinct"), fresh_path(v.spark, "checkpoint")
    # within a batch any of a user's arrivals may be the first: so the first one of all comes in a run before the others
    firsts = rows.join(rows.groupBy("user_id").agg(F.min("event_id").alias("event_id")), ["user_id", "event_id"]).select(rows.columns)
    again = rows.join(firsts.select("event_id"), "event_id", "left_anti").select(rows.columns)
    files = fresh_path(v.spark, "arrivals")
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    for part in (firsts, again):
        part.write.mode("append").parquet(files)
        one = I.distinct_arrivals(I.stream_files(v.spark, files, schema, "parquet"), "user_id", "ts", "400 days")
        _written(one, folder, checkpoint).awaitTermination()
    return v.spark.read.parquet(folder).select("user_id", "event_type")


@query("stream_sessions", """
with e as (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from events),
n as (select *, sum(case when before is null or ts - before > interval 8 hour then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from e),
a as (select user_id, min(ts) as a, max(ts) as b, count(*) as messages, string_agg(distinct event_type, ',' order by event_type) as participants from n group by user_id, s)
select user_id, epoch_us(a) as started, epoch_us(b) as ended, messages, participants from a where b + interval 8 hour < (select max(ts) from events) - interval 1 hour
""")
def stream_sessions(v):
    """Sessions that the watermark has closed, over four micro-batches."""
    rows = v.table("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    folder, checkpoint = fresh_path(v.spark, "sessions"), fresh_path(v.spark, "checkpoint")
    _in_parts(v, rows, 4, lambda source: _written(I.session_stream(source, "user_id", "ts", "event_type"), folder, checkpoint))
    schema = "user_id long, started_at timestamp, ended_at timestamp, messages long, participants string"
    return v.spark.read.schema(schema).parquet(folder).select("user_id", F.unix_micros("started_at").alias("started"), F.unix_micros("ended_at").alias("ended"), "messages", "participants")


@query("late_threads", """
with t as (select distinct user_id as id from events)
select id, case when id in (select user_id from events where event_type = 'error') then 'pending' else 'extracted' end as extraction_status from t
""")
def late_threads(v):
    e = v.table("events")
    threads = e.select(F.col("user_id").alias("id")).distinct().withColumn("extraction_status", F.lit("extracted"))
    return I.dirty_threads(threads, e.filter("event_type = 'error'").select(F.col("user_id").alias("thread_id")))


@query("sessions_to_reload", "select user_id as session_id, count(*) as now from events group by 1 having count(*) - count(*) filter (where event_id % 3 = 0) * (user_id % 2) >= 50")
def sessions_to_reload(v):
    """Users as sessions and events as lines: of every second user a third of the lines has been loaded."""
    lines = v.table("events").select(F.col("user_id").alias("session_id"), "event_id")
    loaded = lines.filter("session_id % 2 = 1 and event_id % 3 = 0").groupBy("session_id").agg(F.count(F.lit(1)).alias("lines"))
    return I.sessions_to_reload(lines, loaded, 50)


@query("cursor_moves", "select user_id, count(*) filter (where event_type <> 'view') < 100 and (user_id % 2 = 0 or count(*) filter (where event_type <> 'view') > 0) as moves from events group by 1")
def cursor_moves(v):
    pulls = v.table("events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "view").alias("seen"))
    return pulls.select("user_id", I.cursor_moves(F.col("seen"), 100, F.col("user_id") % 2 == 0).alias("moves"))


def _parts(column: str, table: str, parts: int) -> str:
    return f"{column} * {parts} // (select max({column}) + 1 from {table})"


@query("stream_live_sessions", """
with e as (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from events where ts is not null),
n as (select *, sum(case when before is null or ts - before > interval 8 hour then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from e)
select user_id, epoch_us(min(ts)) as started, epoch_us(max(ts)) as ended, count(*) as messages, string_agg(distinct event_type, ',' order by event_type) as participants from n group by user_id, s
""")
def stream_live_sessions(v):
    """All sessions, open ones included, after four runs over parts in no order of time: late rows join what they lie between."""
    rows = v.table("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    last = rows.agg(F.max("event_id")).first()[0] or 0
    rows = rows.withColumn("event_id", F.expr(f"(event_id * 7919) % {last + 1}"))
    target, checkpoint = fresh_path(v.spark, "sessions"), fresh_path(v.spark, "checkpoint")
    _in_parts(v, rows, 4, lambda source: S.live_sessions(source, "user_id", "ts", "event_type", target, checkpoint, keep="400 days"))
    return S.read_sessions(v.spark, target).select(F.col("key").alias("user_id"), "started", "ended", F.col("n").alias("messages"), F.col("who").alias("participants"))


@query("stream_reloads", f"""
with p as (select *, {_parts("event_id", "events", 4)} as part from events), u as (select distinct user_id from p),
c as (select u.user_id, count(*) filter (where part = 0) as n0, count(*) filter (where part <= 1) as n1, count(*) filter (where part <= 2) as n2, count(*) as n3 from u join p using (user_id) group by 1),
l0 as (select *, case when n0 >= 50 then n0 else 0 end as a0 from c), l1 as (select *, case when n1 - a0 >= 50 then n1 else a0 end as a1 from l0),
l2 as (select *, case when n2 - a1 >= 50 then n2 else a1 end as a2 from l1), l3 as (select *, case when n3 - a2 >= 50 then n3 else a2 end as a3 from l2),
w as (select *, case a3 when n0 then 0 when n1 then 1 when n2 then 2 else 3 end as upto from l3 where a3 > 0)
select w.user_id, event_type, count(*) as n, max(event_id) as last from w join p using (user_id) where part <= upto group by 1, 2
""")
def stream_reloads(v):
    """Users as sessions and events as lines: one with 50 new lines is loaded whole, as it is then."""
    rows = v.table("events").select("event_id", "user_id", "event_type")
    target, checkpoint = fresh_path(v.spark, "reloaded"), fresh_path(v.spark, "checkpoint")
    folder: list[str] = []

    def start(source):
        def whole(due):
            seen = v.spark.read.schema(rows.schema).parquet(folder[0])
            return seen.join(due, "user_id", "left_semi").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))

        return S.reloaded_sessions(source, "user_id", whole, target, checkpoint)

    _in_parts(v, rows, 4, start, folder)
    return _table(v, target, "user_id long, event_type string, n long, last long", "user_id")


@query("stream_cursor", """
with l as (select * from clicks where arrived_at is not null and click_id is not null qualify row_number() over (partition by click_id order by arrived_at desc) = 1)
select client_id, count(*) as n, min(click_id) as first, epoch_us(max(arrived_at)) as mark from l group by client_id
""")
def stream_cursor(v):
    """Clicks pulled by a mark of their arrival in three runs; what lies at a mark comes twice and counts once."""
    rows = v.table("clicks").filter("click_id is not null").select("click_id", "client_id", F.unix_micros(F.col("arrived_at").cast("timestamp")).alias("arrived"))
    low, high = rows.agg(F.min("arrived"), F.max("arrived")).first()
    folder, target, checkpoint = fresh_path(v.spark, "arrivals"), fresh_path(v.spark, "pulled"), fresh_path(v.spark, "checkpoint")
    schema = "click_id long, client_id long, arrived long"
    for k in range(3):
        part = rows.filter(F.coalesce(F.expr(f"(arrived - {low}) * 3 div {high - low + 1} = {k}"), F.lit(k == 0)))
        part.write.mode("append").parquet(folder)
        pulled = cursor_stream(v.spark, folder, "arrived", schema, 1 << 40, bootstrap=True)
        I.upsert_stream(pulled, target, "click_id", "arrived", checkpoint).awaitTermination()
    held = _table(v, target, schema, "click_id", "arrived")
    return held.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"), F.min("click_id").alias("first"), F.max("arrived").alias("mark"))
