"""Queries of plain relational operators: predicates, joins, aggregates, sets, writes."""

from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.operators import writes
from mnemora.plans.catalog import query
from mnemora.plans.views import with_views


@query("predicates", """
select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'pending') as status, case when o_totalprice > 200000 then 'high' when o_totalprice is null then 'none' else 'low' end as level
from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus not in ('F') and o_orderdate >= timestamp '1996-06-01' and regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '^199[0-9]-0[1-6]')
""")
def predicates(v):
    o = v.table("orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("F") & (F.col("o_orderdate") >= F.lit("1996-06-01").cast("timestamp")))
    o = o.filter(F.date_format("o_orderdate", "yyyy-MM-dd").rlike("^199[0-9]-0[1-6]"))
    level = F.when(F.col("o_totalprice") > 200000, "high").when(F.col("o_totalprice").isNull(), "none").otherwise("low")
    return o.select("o_orderkey", F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("pending")).alias("status"), level.alias("level"))


@query("like_any_case", "select p_partkey from part where lower(p_name) like '%ring%' or lower(p_name) like '%50\\%%' escape '\\'")
def like_any_case(v):
    return v.table("part").filter(T.like(F.col("p_name"), "RING") | T.like(F.col("p_name"), "50%")).select("p_partkey")


@query("join_kinds", """
select n_name, count(distinct c_custkey) as customers, count(distinct s_suppkey) as suppliers, max(r_name) as region from nation join region on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey left join supplier on s_nationkey = n_nationkey group by n_name
""")
def join_kinds(v):
    # counted before the join, so customers and suppliers of a nation don't multiply
    c = v.table("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_distinct("c_custkey").alias("customers"))
    s = v.table("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_distinct("s_suppkey").alias("suppliers"))
    n = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return n.groupBy("n_name").agg(F.coalesce(F.max("customers"), F.lit(0)).alias("customers"), F.coalesce(F.max("suppliers"), F.lit(0)).alias("suppliers"), F.max("r_name").alias("region"))


@query("semi_nested", with_views("mail_topics") + """
select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderkey in (select email_id from mail_topics where topic = 'Brand#7'))
""")
def semi_nested(v):
    ids = v.mail_topics().filter("topic = 'Brand#7'").select(F.col("email_id").alias("o_orderkey"))
    orders = v.table("orders").join(ids, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return v.table("customer").join(orders, "c_custkey", "left_semi").select("c_custkey")


@query("backlog_anti", "select doc_id, source from documents where doc_id not in (select doc_id from labels) and n_chars >= 500")
def backlog_anti(v):
    return v.table("documents").filter("n_chars >= 500").join(v.table("labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("last_row_of", "select conv_id, max_by(turn, turn) as last_turn, max_by(role, turn) as last_role, min_by(length(text), turn)::bigint as first_length from conversations group by conv_id")
def last_row_of(v):
    return v.table("conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.min_by(F.length("text"), "turn").cast("long").alias("first_length"))


@query("scalar_subquery", "select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as orders, (select string_agg(distinct o_orderstatus, ',' order by o_orderstatus) from orders where o_custkey = c_custkey) as statuses from customer")
def scalar_subquery(v):
    o = v.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"))
    return v.table("customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), "statuses")


@query("value_tally", "select coalesce(nullif(quality::varchar, ''), 'unknown') as quality, count(*) as n, count(distinct source) as sources, round(avg(n_chars), 3) as mean from documents left join labels using (doc_id) group by 1")
def value_tally(v):
    return v.attachments().groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("quality")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.round(F.avg("n_chars"), 3).alias("mean"))


@query("top_senders", with_views("mails") + " select sender_id, count(*) as n, min(date_received) as first, max(date_received) as last from mails group by 1 order by n desc, sender_id limit 15")
def top_senders(v):
    return v.mails().groupBy("sender_id").agg(F.count(F.lit(1)).alias("n"), F.min("date_received").alias("first"), F.max("date_received").alias("last")).orderBy(F.desc("n"), "sender_id").limit(15)


@query("group_list", with_views("mail_topics") + " select email_id, string_agg(topic, ', ' order by topic) as topics, count(*) as n from mail_topics group by 1 having count(*) >= 3")
def group_list(v):
    return v.mail_topics().groupBy("email_id").agg(F.array_join(F.array_sort(F.collect_list("topic")), ", ").alias("topics"), F.count(F.lit(1)).alias("n")).filter("n >= 3")


@query("share_of_total", "select user_id, event_type, count(*) as n, round(count(*) / sum(count(*)) over (partition by user_id), 6) as share from events group by 1, 2")
def share_of_total(v):
    n = v.table("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("user_id").agg(F.sum("n").alias("total"))
    return n.join(total, "user_id").select("user_id", "event_type", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("rate_per_week", "select o_custkey, count(*) as n, round_even(count(*) / greatest(floor(date_diff('second', min(o_orderdate), max(o_orderdate)) / 86400) / 7, 1.0), 1)::decimal(18,1) as per_week from orders group by 1")
def rate_per_week(v):
    weeks = F.greatest(F.floor((F.unix_seconds(F.max("o_orderdate").cast("timestamp")) - F.unix_seconds(F.min("o_orderdate").cast("timestamp"))) / 86400) / 7, F.lit(1.0))
    return v.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.bround(F.count(F.lit(1)) / weeks, 1).cast("decimal(18,1)").alias("per_week"))


@query("set_algebra", """
select 'union' as op, count(*) as n from (select doc_id from documents union select vec_id from embeddings) union all select 'except', count(*) from (select doc_id from documents except select doc_id from labels)
union all select 'intersect', count(*) from (select doc_id from documents intersect select vec_id from embeddings)
""")
def set_algebra(v):
    d, l, e = v.table("documents").select("doc_id"), v.table("labels").select("doc_id"), v.table("embeddings").select(F.col("vec_id").alias("doc_id"))
    n = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    return n("union", d.unionByName(e).distinct()).unionByName(n("except", d.distinct().join(l, "doc_id", "left_anti"))).unionByName(n("intersect", d.distinct().join(e, "doc_id", "left_semi")))


@query("order_nulls", "select doc_id, quality from documents left join labels using (doc_id) order by quality asc nulls last, doc_id desc")
def order_nulls(v):
    return v.attachments().orderBy(F.asc_nulls_last("quality"), F.desc("doc_id")).select("doc_id", "quality")


@query("insert_absent", "select doc_id as id, case when doc_id % 3 = 0 then 'old' else 'new' end as origin from documents where doc_id % 3 = 0 or doc_id % 5 <> 0")
def insert_absent(v):
    d = v.table("documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("message_id"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")).otherwise(0).alias("mail_key"))
    old, new = d.filter("id % 3 = 0").withColumn("origin", F.lit("old")), d.withColumn("origin", F.lit("new"))
    return writes.insert_absent(old, new, ["message_id", "mail_key"], "id").select("id", "origin")


@query("insert_links", with_views("mail_topics") + " select topic, count(*) as n from (select email_id, topic from mail_topics union select doc_id, 'Brand#1' from documents) group by 1")
def insert_links(v):
    links = v.mail_topics()
    new = v.table("documents").select(F.col("doc_id").alias("email_id"), F.lit("Brand#1").alias("topic"))
    return writes.insert_links(links, new.unionByName(new), ["email_id", "topic"]).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("upsert_latest", "select event_id % 500 as id, max_by(event_type, event_id) as event_type, max(event_id) as seq from events group by 1")
def upsert_latest(v):
    e = v.table("events").select((F.col("event_id") % 500).alias("id"), "event_type", F.col("event_id").alias("seq"))
    return writes.upsert(e.filter("seq < 6000"), e.filter("seq >= 6000"), "id", "seq")


@query("replace_children", "select conv_id, turn, case when conv_id % 4 = 0 then 'new' else role end as role from conversations where conv_id % 4 <> 0 or turn = 0")
def replace_children(v):
    c = v.table("conversations").select("conv_id", "turn", "role")
    return writes.replace_children(c, c.filter("conv_id % 4 = 0 and turn = 0").withColumn("role", F.lit("new")), "conv_id")


@query("attempt_counter", """
with l as (select user_id, event_id, event_type = 'purchase' as ok, event_type from events), m as (select user_id, max(event_id) filter (where ok) as last_ok, max(event_id) as last, max_by(event_type, event_id) as last_status from l group by 1)
select user_id, last_status, last as last_attempt_at, count(*) filter (where last_ok is null or event_id > last_ok) as attempts from l join m using (user_id) group by all
""")
def attempt_counter(v):
    log = v.table("events").select("user_id", "event_id", F.col("event_type").alias("status"))
    return writes.attempts(log, "user_id", "event_id", F.col("status") == "purchase")


@query("loaded_batches", "select source as batch, count(*) as messages, count(l.doc_id) as loaded from documents d left join (select distinct doc_id from labels union select doc_id from documents where doc_id % 20 < 12) l on l.doc_id = d.doc_id group by 1 having count(*) = count(l.doc_id)")
def loaded_batches(v):
    d = v.table("documents").select(F.col("source").alias("batch"), F.col("doc_id").alias("message_id"))
    done = v.table("labels").select(F.col("doc_id").alias("message_id")).unionByName(d.filter("message_id % 20 < 12").select("message_id"))
    return writes.fully_loaded(d, done)


@query("register_files", "select count(*) filter (where doc_id < 700) as registered, count(*) filter (where doc_id >= 700) as deferred from documents where doc_id not in (select doc_id from labels)")
def register_files(v):
    files = v.table("documents").select(F.col("doc_id").alias("message_id"), F.col("source").alias("filename"))
    known = v.table("labels").join(files, F.col("doc_id") == F.col("message_id")).select("message_id", "filename")
    now, later = writes.register_files(files, known, files.filter("message_id < 700").select("message_id", F.col("message_id").alias("id")))
    return now.agg(F.count(F.lit(1)).alias("registered")).join(later.agg(F.count(F.lit(1)).alias("deferred")))


@query("inbox_moves", "select case when doc_id % 2 = 0 and doc_id not in (select doc_id from labels) and doc_id % 7 <> 0 then 'Archive' when doc_id % 2 = 0 then 'Inbox' else 'Sent' end as mailbox_name, count(*) as n from documents group by 1")
def inbox_moves(v):
    mails = v.table("documents").select(F.col("doc_id").alias("message_id"), (F.col("doc_id") + 0).alias("internet_message_id"), F.when(F.col("doc_id") % 2 == 0, "Inbox").otherwise("Sent").alias("mailbox_name"))
    live = v.table("labels").select(F.col("doc_id").alias("message_id"))
    provider = mails.filter("message_id % 7 = 0").select("internet_message_id")
    return writes.moved_from_inbox(mails, live, provider).groupBy("mailbox_name").agg(F.count(F.lit(1)).alias("n"))
