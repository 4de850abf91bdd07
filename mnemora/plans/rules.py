"""Queries of rules, selections and freshness checks."""

from pyspark.sql import functions as F

from mnemora.operators import health as H
from mnemora.operators import selection as S
from mnemora.plans.catalog import query
from mnemora.plans.views import EVENTS_AS_OF

_SHARES = """p as (select user_id, event_type, count(*) as n from events group by 1, 2), t as (select user_id, count(distinct event_id) as total from events group by 1), sh as (select p.*, total, n / total as f from p join t using (user_id))"""


def _occurrences(v):
    return v.table("events").select(F.col("user_id").alias("sender_email"), F.col("event_type").alias("sha256"), F.col("event_id").alias("message_id"))


@query("signature_shares", f"with {_SHARES} select user_id as sender_email, event_type as sha256, n as occurrence_count, total as sender_total, round(f, 9) as frequency from sh")
def signature_shares(v):
    return S.signature_shares(_occurrences(v)).withColumn("frequency", F.round("frequency", 9))


@query("image_cascade", f"""
with {_SHARES}, e as (select event_id, user_id, event_type, event_id % 11 * 40 as w, event_id % 7 * 60 as h, (value * 1000)::bigint as b from events)
select event_id, case when event_id % 13 = 0 then 'content' when w = 0 then 'noise' when w < 100 or h < 100 then 'noise' when b < 5000 then 'noise' when f >= 0.25 then 'signature' else 'unclassified' end as classification,
  case when event_id % 13 = 0 then 'kept' when w = 0 then 'decode_failed' when w < 100 or h < 100 then 'dimensions' when b < 5000 then 'byte_size' when f >= 0.25 then 'frequency' else 'stage1_passed' end as method
from e join sh using (user_id, event_type)
""")
def image_cascade(v):
    e = v.table("events")
    w = F.col("event_id") % 11 * 40
    images = e.select("event_id", F.col("user_id").alias("sender_email"), F.col("event_type").alias("sha256"), F.when(w > 0, w).alias("width"), (F.col("event_id") % 7 * 60).alias("height"), F.round(F.col("value") * 1000).cast("long").alias("bytes"), F.when(F.col("event_id") % 13 == 0, "content").alias("classification"), F.lit(None).cast("boolean").alias("user_overridden"))
    return S.classify_images(images, S.signature_shares(_occurrences(v)), 0.25).select("event_id", "classification", "method")


@query("image_backlog", "select doc_id as message_id from documents where doc_id not in (select doc_id from labels) and n_chars >= 300 order by n_chars desc, doc_id limit 200")
def image_backlog(v):
    mails = v.table("documents").select(F.col("doc_id").alias("message_id"), F.col("n_chars").alias("date_received"))
    return S.image_backlog(mails, v.table("labels").select(F.col("doc_id").alias("message_id")), F.lit(300), 200).select("message_id")


@query("link_retry", """
with l as (select event_id as id, case event_id % 4 when 0 then null else ts end as fetched_at, case event_id % 5 when 0 then 'ok' when 1 then 'stale' when 2 then 'unsupported-host' when 3 then null else 'http-error' end as last_status, ts as last_attempt_at, event_id % 8 as attempts from events)
select id from l where (fetched_at is null or coalesce(last_status, '') = 'stale') and coalesce(last_status, '') <> 'unsupported-host'
  and (attempts < 5 or (last_attempt_at < timestamp '2024-01-20' - interval 7 day and not (fetched_at is null and coalesce(last_status, '') = 'stale')))
""")
def link_retry(v):
    i = F.col("event_id")
    status = F.when(i % 5 == 0, "ok").when(i % 5 == 1, "stale").when(i % 5 == 2, "unsupported-host").when(i % 5 == 4, "http-error")
    links = v.table("events").select(i.alias("id"), F.when(i % 4 != 0, F.col("ts")).alias("fetched_at"), status.alias("last_status"), F.col("ts").alias("last_attempt_at"), (i % 8).alias("attempts"))
    return S.links_to_retry(links, F.lit("2024-01-20").cast("timestamp")).select("id")


@query("attachment_skips", "select event_id, value < 1 or event_type = 'view' and value < 10 or event_id % 9 = 0 as skip from events")
def attachment_skips(v):
    size = F.when(F.col("value") < 1, 0).otherwise(F.col("value") * 5120)
    mime = F.when(F.col("event_type") == "view", "image/png").otherwise("application/pdf")
    name = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("Image00"), F.col("event_id"), F.lit(".png"))).otherwise("report.pdf")
    return v.table("events").select("event_id", S.skip_attachment(name, mime, size).alias("skip"))


@query("systemic_failures", "select count(*) as attempted, count(*) filter (where event_type = 'error') as permanent, count(*) filter (where event_type = 'error') > greatest(3.0, 0.25 * count(*)) as systemic from events")
def systemic_failures(v):
    return S.systemic_failure(v.table("events"), F.col("event_type") == "error")


@query("resolve_queue", """
with k as (select user_id, case user_id % 4 when 0 then 'resolved' when 1 then 'failed' when 2 then 'pending' end as status, max(ts) as tried from events where user_id % 4 <> 3 group by 1)
select '8:' || u.user_id as mri from (select distinct user_id from events where user_id % 7 <> 0) u left join k using (user_id) where status is null or status <> 'resolved' order by tried nulls first, mri limit 50
""")
def resolve_queue(v):
    e = v.table("events")
    mri = F.concat(F.when(F.col("user_id") % 7 == 0, "28:").otherwise("8:"), F.col("user_id")).alias("mri")
    status = F.when(F.col("user_id") % 4 == 0, "resolved").when(F.col("user_id") % 4 == 1, "failed").otherwise("pending")
    known = e.filter("user_id % 4 <> 3").groupBy(mri, status.alias("status")).agg(F.max("ts").alias("last_attempt_at"))
    return S.to_resolve(e.select(mri), known).select("mri")


@query("article_dates", "select event_id, case when event_id % 3 = 0 or ts + interval 1 day * (event_id % 5 - 2) > ts then ts else ts + interval 1 day * (event_id % 5 - 2) end as dated from events")
def article_dates(v):
    ts, i = F.col("ts"), F.col("event_id")
    published = F.when(i % 3 != 0, ts + F.make_interval(days=(i % 5 - 2).cast("int")))
    return v.table("events").select("event_id", S.article_date(published, ts).alias("dated"))


@query("changed_events", "select event_id from events where event_id % 3 = 0 or event_id % 5 = 0 or event_id % 7 = 0")
def changed_events(v):
    i = F.col("event_id")
    fetched = v.table("events").select(i.alias("outlook_event_id"), F.col("ts").alias("modified_at"))
    known = v.table("events").filter("event_id % 3 <> 0").select(i.alias("outlook_event_id"), F.when(i % 5 == 0, F.col("ts") - F.make_interval(days=F.lit(1))).otherwise(F.col("ts")).alias("modified_at"), F.when(i % 7 == 0, "pending").otherwise("extracted").alias("llm_status"))
    return S.changed_events(fetched, known).select(F.col("outlook_event_id").alias("event_id"))


@query("curation", """
with a as (select doc_id as id, lower(source || '-' || doc_id % 40) as base from documents left join labels using (doc_id) where quality is null and n_chars >= 500 and length(text) >= 200 and not contains(lower(source), 'src3') and doc_id % 2 = 0)
select base, max(id) as id from a group by 1 order by id desc limit 100
""")
def curation(v):
    i = F.col("doc_id")
    name = F.concat(F.col("source"), F.lit("-"), i % 40, F.when(i % 4 == 0, " (2)").otherwise(" final"), F.lit(".pdf"))
    files = v.table("documents").select(i.alias("id"), name.alias("filename"), F.col("source").alias("subject"), F.when(i % 2 == 0, "application/pdf").otherwise("text/plain").alias("mime_type"), (F.col("n_chars") * 20).alias("file_size"), F.col("text").alias("extracted_text"))
    return S.curation_candidates(files, v.table("labels").select(i.alias("id")), ["SRC3"], ["application/pdf"], 100).select("base", "id")


@query("recoverable", "select doc_id as message_id from documents where doc_id % 2 = 0 and doc_id not in (select doc_id from labels) and doc_id % 10 <> 0")
def recoverable(v):
    d = v.table("documents").select(F.col("doc_id").alias("message_id"), (F.col("doc_id") + 1_000_000).alias("internet_message_id"))
    loaded = v.table("labels").select(F.col("doc_id").alias("message_id"), F.lit(None).cast("long").alias("internet_message_id")).unionByName(d.filter("message_id % 10 = 0").select((-F.col("message_id") - 1).alias("message_id"), "internet_message_id"))
    return S.recoverable(d.filter("message_id % 2 = 0").select("message_id"), d, loaded).select("message_id")


@query("freshness", f"""
select 'events' as source, count(*) as rows, max(ts) as latest, count(*) filter (where ts > timestamp '{EVENTS_AS_OF}' - interval 1 day) as last_day, count(*) filter (where ts > timestamp '{EVENTS_AS_OF}' - interval 7 day) as last_week,
  case when max(ts) < timestamp '{EVENTS_AS_OF}' - interval 6 hour then 'STALE' else 'OK' end as state from events
union all select 'orders', count(*), max(o_orderdate), count(*) filter (where o_orderdate > timestamp '{EVENTS_AS_OF}' - interval 1 day), count(*) filter (where o_orderdate > timestamp '{EVENTS_AS_OF}' - interval 7 day),
  case when max(o_orderdate) < timestamp '{EVENTS_AS_OF}' - interval 6 hour then 'STALE' else 'OK' end from orders
""")
def freshness(v):
    now = F.lit(EVENTS_AS_OF).cast("timestamp")
    return H.freshness(v.table("events"), "events", "ts", now, 6).unionByName(H.freshness(v.table("orders"), "orders", "o_orderdate", now, 6))


@query("status_matrix", "select event_type as status, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 3) as percent from events group by 1")
def status_matrix(v):
    return H.histogram(v.table("events"), "event_type")


@query("coverage", "select count(*) as total, count(label.doc_id) as covered, case when count(label.doc_id) < 0.75 * count(*) then 'WARN' else 'OK' end as state from documents d left join labels label on d.doc_id = label.doc_id")
def coverage(v):
    return H.coverage(v.table("documents").select("doc_id"), v.table("labels").select("doc_id"), "doc_id", 0.75)


@query("pipeline_lag", "select date_diff('second', (select max(ts) from events where event_type = 'purchase'), least((select max(ts) from events), timestamp '2024-01-30 12:00:00'))::bigint as lag_seconds")
def pipeline_lag(v):
    e = v.table("events")
    return H.lag(e, e.filter("event_type = 'purchase'"), "ts", F.lit("2024-01-30 12:00:00").cast("timestamp"))
