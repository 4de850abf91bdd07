"""Queries of sessions, threads, islands, versions and retention."""

from pyspark.sql import functions as F

from mnemora.operators import windows as W
from mnemora.plans.catalog import query
from mnemora.plans.views import with_views

_SESSIONS = with_views("messages") + """,
g as (select *, case when composed_at - lag(composed_at) over w <= interval 8 hour then 0 else 1 end as new from messages window w as (partition by chat_id order by composed_at, event_id)),
s as (select *, sum(new) over (partition by chat_id order by composed_at, event_id rows unbounded preceding)::bigint as session from g)
"""


@query("sessions", _SESSIONS + " select event_id, chat_id, session from s")
def sessions(v):
    return W.sessions(v.messages(), "chat_id", "composed_at", ["event_id"]).select("event_id", "chat_id", "session")


@query("sessions_split", _SESSIONS + " select event_id, chat_id, session from s")
def sessions_split(v):
    return W.sessions_split(v.messages(), "chat_id", "composed_at", ["event_id"]).select("event_id", "chat_id", "session")


@query("session_summary", _SESSIONS + " select chat_id, session, min(composed_at) as started_at, max(composed_at) as ended_at, count(*) as messages, string_agg(distinct sender, ',' order by sender) as participants from s group by chat_id, session")
def session_summary(v):
    return W.session_summary(W.sessions(v.messages(), "chat_id", "composed_at", ["event_id"]), "chat_id", "composed_at", "sender")


@query("reply_threads", """
select user_id as chat_id, coalesce(case when event_id % 4 <> 0 then (event_id // 4 * 4)::varchar end, event_id::varchar) as anchor, count(*) as messages, min(ts) as started_at from events group by all
""")
def reply_threads(v):
    m = v.messages().withColumn("message_id", F.concat("chat_id", F.lit("::"), "event_id")).withColumn("parent", F.when(F.col("event_id") % 4 != 0, F.expr("event_id div 4 * 4").cast("string")))
    return m.groupBy("chat_id", W.reply_anchor(F.col("parent"), F.col("message_id")).alias("anchor")).agg(F.count(F.lit(1)).alias("messages"), F.min("composed_at").alias("started_at"))


@query("speaker_turns", """
with r as (select conv_id, turn, case when turn % 3 = 1 then 'user' else role end as who, text from conversations where role <> 'system'),
c as (select *, case when who = lag(who) over (partition by conv_id order by turn) then 0 else 1 end as ch from r),
n as (select *, sum(ch) over (partition by conv_id order by turn rows unbounded preceding) as run from c)
select conv_id, (run - 1)::bigint as turn_index, min(who) as speaker, min(turn) as first, count(*) as parts, left(string_agg(text, chr(10) order by turn), 50000) as content from n group by conv_id, run
""")
def speaker_turns(v):
    said = v.table("conversations").filter("role <> 'system'").withColumn("speaker", F.when(F.col("turn") % 3 == 1, "user").otherwise(F.col("role")))  # roles alternate, speakers repeat
    return W.collapse(said, "conv_id", "turn", "speaker", "text")


@query("latest_versions", """
with f as (select doc_id, source as folder, case when doc_id % 2 = 0 then strftime(timestamp '2020-01-01' + interval 1 hour * (doc_id % 7), '%Y%m%d%H%M') || '_' else '' end || 'File' || (doc_id % 11) || '.PDF' as name, timestamp '2020-01-01' + interval 1 day * (doc_id % 13) as modified from documents),
k as (select *, lower(regexp_replace(name, '^[0-9]{12}_', '')) as logical, coalesce(nullif(regexp_extract(name, '^([0-9]{12})_', 1), ''), strftime(modified, '%Y%m%d%H%M')) as version from f)
select folder, logical, name, version from k qualify row_number() over (partition by folder, logical order by version desc, name, doc_id) = 1
""")
def latest_versions(v):
    base = F.lit("2020-01-01").cast("timestamp")
    hour = lambda n: base + F.make_interval(hours=n.cast("int"))
    day = lambda n: base + F.make_interval(days=n.cast("int"))
    stamp = F.when(F.col("doc_id") % 2 == 0, F.concat(F.date_format(hour(F.col("doc_id") % 7), "yyyyMMddHHmm"), F.lit("_"))).otherwise("")
    files = v.table("documents").select("doc_id", F.col("source").alias("folder"), F.concat(stamp, F.lit("File"), F.col("doc_id") % 11, F.lit(".PDF")).alias("name"), day(F.col("doc_id") % 13).alias("modified"))
    return W.latest_versions(files).select("folder", "logical", "name", "version")


@query("keep_generations", """
with d as (select distinct user_id % 5 as grp, ts::date as day from events),
w as (select *, strftime(day, '%G-W%V') as week from d),
r as (select *, row_number() over (partition by grp order by day desc) as d, row_number() over (partition by grp, week order by day desc) as w1, dense_rank() over (partition by grp order by week desc) as wn from w)
select grp, day, week, d <= 5 or (w1 = 1 and wn <= 3) as kept from r
""")
def keep_generations(v):
    days = v.table("events").select((F.col("user_id") % 5).alias("grp"), F.to_date("ts").alias("day")).distinct()
    return W.keep_generations(days, "grp", "day", 5, 3)


@query("keep_rolling", "select grp, name, row_number() over (partition by grp order by name desc) <= 7 as kept from (select distinct user_id % 5 as grp, 'snap-' || ts::date as name from events)")
def keep_rolling(v):
    names = v.table("events").select((F.col("user_id") % 5).alias("grp"), F.concat(F.lit("snap-"), F.to_date("ts")).alias("name")).distinct()
    return W.keep_rolling(names, "grp", "name", 7)


@query("month_chunks", """
with o as (select o_custkey, min(o_orderdate)::date as since, max(o_orderdate)::date as until from orders group by 1 having min(o_orderdate)::date < max(o_orderdate)::date),
m as (select *, unnest(generate_series(date_trunc('month', since), date_trunc('month', until - 1), interval 1 month))::date as m from o)
select o_custkey, greatest(m, since) as start, least((m + interval 1 month)::date, until) as stop from m
""")
def month_chunks(v):
    spans = v.table("orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("since"), F.to_date(F.max("o_orderdate")).alias("until")).filter("since < until")
    return spans.select("o_custkey", F.explode(W.month_chunks(F.col("since"), F.col("until"))).alias("c")).select("o_custkey", "c.start", "c.stop")


@query("latest_with_ties", "select user_id, event_type, count(*) as n, max(ts) as at from (select *, rank() over (partition by user_id, event_type order by date_trunc('day', ts) desc) as r from events) where r = 1 group by all")
def latest_with_ties(v):
    rows = v.table("events").withColumn("day", F.date_trunc("day", "ts"))
    return W.latest_with_ties(rows, ["user_id", "event_type"], "day").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("at"))


@query("substance", """
select conv_id, count(*) filter (where length(text) > 200) as long_messages, sum(length(text))::bigint as characters from conversations where role <> 'system' group by 1 having count(*) filter (where length(text) > 200) > 0 and sum(length(text)) >= 1500
""")
def substance(v):
    rows = v.table("conversations").withColumn("is_system", F.col("role") == "system")
    return W.has_substance(rows, ["conv_id"], "text", 200, 1500)


@query("chat_summary", _SESSIONS + """,
t as (select 'sessions' as section, session::varchar as key, count(*)::varchar as value, row_number() over (order by max(composed_at) desc)::bigint as rank from s where chat_id = 8 group by session),
l as (select 'last_messages' as section, event_id::varchar as key, sender as value, row_number() over (order by composed_at desc, event_id)::bigint as rank from s where chat_id = 8),
w as (select 'senders' as section, sender as key, count(*)::varchar as value, row_number() over (order by count(*) desc, sender)::bigint as rank from s where chat_id = 8 and composed_at >= timestamp '2024-01-15' group by sender)
select * from t where rank <= 20 union all select * from l where rank <= 10 union all select * from w where rank <= 10
""")
def chat_summary(v):
    from mnemora.operators.dossier import section, union

    rows = W.sessions(v.messages().filter("chat_id = 8"), "chat_id", "composed_at", ["event_id"])
    threads = rows.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.max("composed_at").alias("ended"))
    senders = rows.filter("composed_at >= timestamp '2024-01-15'").groupBy("sender").agg(F.count(F.lit(1)).alias("n"))
    return union([
        section(threads, "sessions", F.col("session"), F.col("n"), F.desc("ended"), limit=20),
        section(rows, "last_messages", F.col("event_id"), F.col("sender"), F.desc("composed_at"), F.col("event_id"), limit=10),
        section(senders, "senders", F.col("sender"), F.col("n"), F.desc("n"), F.col("sender"), limit=10),
    ])


@query("chat_stats", "select count(*) as messages, count(distinct user_id) as chats, min(ts) as first, max(ts) as last, count(*) filter (where event_type = 'error') as failed from events")
def chat_stats(v):
    return v.table("events").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("user_id").alias("chats"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query("session_context", """
select conv_id, turn, role, length(text)::bigint as content_length, contains(text, '```') as has_code from conversations where conv_id = 12 union all
select conv_id, -1, 'turns', count(*), false from conversations where conv_id = 12 group by conv_id
""")
def session_context(v):
    turns = v.table("conversations").filter("conv_id = 12")
    rows = turns.select("conv_id", "turn", "role", F.length("text").cast("long").alias("content_length"), F.col("text").contains("```").alias("has_code"))
    total = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("content_length")).select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("turns").alias("role"), "content_length", F.lit(False).alias("has_code"))
    return rows.unionByName(total)
