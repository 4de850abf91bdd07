"""Queries of the store's catalogue on mails, people, topics, actions, decisions."""

from pyspark.sql import functions as F

from mnemora.operators import dossier, lifecycle, search
from mnemora.plans.catalog import query
from mnemora.plans.retrieval import bm25_sql
from mnemora.plans.views import AS_OF, with_views

WHO, ADDRESS, TOPIC = "customer#00000001", "supplier.000000003@n{}.example", "brand#1"


@query("thread", with_views("mails") + " select email_id, date_received, sender_id, sentiment from mails where conversation_id = (select conversation_id from mails where email_id = 17) order by date_received, email_id limit 50")
def thread(v):
    return dossier.thread(v, 17)


@query("person_mail", with_views("mails", "people", "mail_people") + f"""
select email_id, date_received, sender_id, role from (select distinct m.email_id, m.date_received, m.sender_id, l.role from mails m join mail_people l using (email_id) join people p using (person_id) where contains(lower(p.name), '{WHO}'))
order by date_received desc, email_id, role limit 20
""")
def person_mail(v):
    return dossier.by_person(v, WHO)


@query("topic_mail", with_views("mails", "mail_topics") + f" select email_id, date_received, sender_id from mails where email_id in (select email_id from mail_topics where contains(lower(topic), '{TOPIC}')) order by date_received desc, email_id limit 20")
def topic_mail(v):
    return dossier.by_topic(v, "Brand#1")


@query("date_range", with_views("mails") + " select email_id, date_received, sender_id from mails where date_received::date between date '1997-03-01' and date '1997-03-10' order by date_received desc, email_id limit 50")
def date_range(v):
    return dossier.by_date(v, "1997-03-01", "1997-03-10")


_TOPICS = "l as (select email_id, string_agg(topic, ', ' order by topic) as topics from mail_topics group by email_id)"


@query("decisions_topics", with_views("mails", "mail_topics", "decisions") + f""", {_TOPICS},
t as (select d.email_id, d.decision, d.decided_by, coalesce(d.decision_date, m.date_received::date) as date from decisions d join mails m using (email_id)
  where d.email_id in (select email_id from mail_topics where contains(lower(topic), '{TOPIC}')) and contains(d.decided_by, 's:1') order by 4 desc, 1, 2, 3 limit 20)
select t.*, l.topics from t left join l using (email_id)
""")
def decisions_topics(v):
    return dossier.decisions(v, TOPIC, "s:1")


@query("recent_decisions", with_views("mails", "decisions") + f"""
select email_id, decision, decided_by, coalesce(decision_date, date_received::date) as date from decisions join mails using (email_id) where date_received >= date '{AS_OF}' - interval 400 day
order by 4 desc, 1, 2, 3 limit 20
""")
def recent_decisions(v):
    return dossier.recent_decisions(v, AS_OF, 400)


@query("open_actions", with_views("mails", "actions") + """
select email_id, task, owner, deadline, status, line from actions join mails using (email_id) where status = 'open' and contains(owner, 's:2') order by deadline nulls last, date_received desc, email_id, task, owner, line limit 50
""")
def open_actions(v):
    return dossier.actions(v, "s:2")


@query("combined_filters", with_views("mails", "people", "mail_people", "mail_topics") + f""", {_TOPICS},
t as (select email_id, date_received, sender_id from mails where date_received::date >= date '1996-01-01' and date_received::date <= date '2000-12-31'
  and email_id in (select email_id from mail_people join people using (person_id) where contains(lower(name), '{WHO}'))
  and email_id in (select email_id from mail_topics where contains(lower(topic), '{TOPIC}')) and email_id in (select doc_id * 7 from documents) order by date_received desc, email_id limit 20)
select t.*, l.topics from t left join l using (email_id)
""")
def combined_filters(v):
    found = v.table("documents").select((F.col("doc_id") * 7).alias("email_id"))
    return dossier.combined(v, WHO, TOPIC, found, "1996-01-01", "2000-12-31")


@query("stale_threads", with_views("mails") + f"""
select email_id, conversation_id, sender_id, date_received, (date_diff('second', date_received, timestamp '{AS_OF}') // 86400)::int as days_waiting
from (select *, rank() over (partition by conversation_id order by date_received desc) as r from mails)
where r = 1 and contains(sender_id, 'c:1') and date_received < timestamp '{AS_OF}' - interval 5 day
""")
def stale_threads(v):
    mails = v.mails().withColumn("sender_address", F.col("sender_id"))
    return lifecycle.stale_threads(mails, "c:1", F.lit(AS_OF).cast("timestamp")).select("email_id", "conversation_id", "sender_id", "date_received", "days_waiting")


@query("overdue_actions", with_views("actions") + f"""
select email_id, task, owner, deadline, line, date_diff('day', deadline::date, date '{AS_OF}')::int as days_overdue from actions where status = 'open' and deadline <> 'asap' and deadline::date < date '{AS_OF}'
""")
def overdue_actions(v):
    return lifecycle.overdue(v.actions(), F.lit(AS_OF).cast("date")).select("email_id", "task", "owner", "deadline", "line", "days_overdue")


@query("actions_first", """
select l_orderkey as email_id, 's:' || l_suppkey as owner, min(l_partkey) as part, count(*) as n from (
  select *, row_number() over (partition by l_orderkey, l_suppkey, l_linenumber order by l_partkey) as r from lineitem) where r = 1 group by all
""")
def actions_first(v):
    lines = v.table("lineitem")
    rows = lines.select(F.col("l_orderkey").alias("email_id"), F.concat(F.lit("s:"), F.col("l_suppkey")).alias("owner"), F.lit("t").alias("task"), F.col("l_linenumber").cast("string").alias("deadline"), F.col("l_partkey").alias("id"))
    return lifecycle.without_repeats(rows, total=lines.count()).groupBy("email_id", "owner").agg(F.min("id").alias("part"), F.count(F.lit(1)).alias("n"))


@query("actions_expired", with_views("actions") + f"""
select case when status = 'open' and deadline <> 'asap' and try_cast(deadline as date) < date '{AS_OF}' - 180 then 'expired' else status end as status, count(*) as n from actions group by 1
""")
def actions_expired(v):
    return lifecycle.expire(v.actions(), F.lit(AS_OF).cast("date")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("store_stats", """
select 'mails' as name, count(*)::varchar as value from orders union all select 'people', ((select count(*) from customer) + (select count(*) from supplier))::varchar
union all select 'documents', count(*)::varchar from documents union all select 'turns', count(*)::varchar from conversations
union all select 'first_date', min(o_orderdate)::date::varchar from orders union all select 'last_date', max(o_orderdate)::date::varchar from orders
""")
def store_stats(v):
    return dossier.counts({"mails": v.mails(), "people": v.people(), "documents": v.table("documents"), "turns": v.table("conversations")}, v.mails(), "date_received")


def _section(name: str, rows: str, key: str, value: str, order: str, limit: int = 0) -> str:
    return f"select '{name}' as section, row_number() over (order by {order})::bigint as rank, ({key})::varchar as key, ({value})::varchar as value from {rows}" + (f" qualify row_number() over (order by {order}) <= {limit}" if limit else "")


_PERSON = with_views("mails", "people", "mail_people", "mail_topics", "actions", "decisions") + f""",
me as (select min(person_id) as person_id from people where contains(lower(name), '{WHO}')),
li as (select distinct email_id from mail_people where person_id = (select person_id from me)),
ma as (select * from mails where email_id in (select email_id from li)), re as (select * from ma where date_received >= date '{AS_OF}' - interval 2000 day),
sp as (select count(*) as total, min(date_received) as first, max(date_received) as last from ma),
rate as (select *, round_even(total / greatest(floor(date_diff('second', first, last) / 86400) / 7, 1.0), 1) as rate from sp where total > 0),
tc as (select topic, count(*) as n from mail_topics where email_id in (select email_id from re) group by 1), sc as (select sentiment, count(*) as n from re group by 1),
oc as (select person_id, count(distinct email_id) as n from mail_people where email_id in (select email_id from re) and person_id <> (select person_id from me) group by 1),
ac as (select * from actions where status = 'open' and owner = (select person_id from me)), de as (select * from decisions where decided_by = (select person_id from me) and email_id in (select email_id from re))
"""
_PERSON_PARTS = {
    "profile": _section("profile", "people where person_id = (select person_id from me)", "name", "email", "person_id"),
    "first_mail": _section("first_mail", "rate", "'date'", "first::date", "total"),
    "last_mail": _section("last_mail", "rate", "'date'", "last::date", "total"),
    "mails_per_week": _section("mails_per_week", "rate", "'rate'", "rate::decimal(18,1)", "total"),
    "recent_mails": _section("recent_mails", "(select count(*) as n from re)", "'count'", "n", "n"),
    "topics": _section("topics", "tc", "topic", "n", "n desc, topic", 10),
    "sentiments": _section("sentiments", "sc", "sentiment", "n", "n desc, sentiment"),
    "works_with": _section("works_with", "oc", "person_id", "n", "n desc, person_id", 10),
    "open_actions": _section("open_actions", "ac", "task", "deadline", "deadline nulls last, task, email_id, line", 10),
    "decisions": _section("decisions", "de", "decision", "email_id", "email_id desc, decision", 10),
}


@query("person_context", _PERSON + " union all ".join(_PERSON_PARTS.values()))
def person_context(v):
    return dossier.person_context(v, WHO, AS_OF, 2000)


@query("sender_brief", _PERSON + f""", whole as ({" union all ".join(_PERSON_PARTS.values())})
select 'known' as section, 1::bigint as rank, 'known' as key, (count(*) filter (where section = 'profile') > 0)::varchar as value from whole
union all select * from whole where section in ('profile', 'mails_per_week', 'recent_mails') or (section = 'topics' and rank <= 5)
union all select 'n_open_actions', 1, 'count', count(*)::varchar from whole where section = 'open_actions'
""")
def sender_brief(v):
    return dossier.sender_brief(v, WHO, AS_OF, 2000)


@query("topic_context", with_views("mails", "mail_people", "mail_topics", "actions", "decisions") + f""",
me as (select min(topic) as topic from mail_topics where contains(lower(topic), '{TOPIC}')),
re as (select * from mails where date_received >= date '{AS_OF}' - interval 2000 day and email_id in (select email_id from mail_topics where topic = (select topic from me))),
pc as (select person_id, count(distinct email_id) as n from mail_people where email_id in (select email_id from re) group by 1),
tc as (select topic, count(*) as n from mail_topics where email_id in (select email_id from re) and topic <> (select topic from me) group by 1), sc as (select sentiment, count(*) as n from re group by 1),
de as (select * from decisions where email_id in (select email_id from re)), ac as (select * from actions where status = 'open' and email_id in (select email_id from re))
""" + " union all ".join([
    _section("topic", "me", "'name'", "topic", "topic"), _section("mails", "(select count(*) as n from re)", "'count'", "n", "n"), _section("people", "pc", "person_id", "n", "n desc, person_id", 10),
    _section("related", "tc", "topic", "n", "n desc, topic", 10), _section("sentiments", "sc", "sentiment", "n", "n desc, sentiment"),
    _section("decisions", "de", "decision", "email_id", "email_id desc, decision, decided_by", 10), _section("open_actions", "ac", "task", "owner", "deadline nulls last, task, owner, email_id, line", 10),
]))
def topic_context(v):
    return dossier.topic_context(v, TOPIC, AS_OF, 2000)


@query("thread_context", with_views("mails", "mail_people", "actions", "decisions") + """,
re as (select * from mails where conversation_id = (select conversation_id from mails where email_id = 17)),
pe as (select distinct person_id from mail_people where email_id in (select email_id from re)),
de as (select d.*, coalesce(decision_date, date_received::date) as date from decisions d join re using (email_id)), ac as (select * from actions where status = 'open' and email_id in (select email_id from re))
""" + " union all ".join([
    _section("mails", "re", "email_id", "date_received::date", "date_received, email_id", 50), _section("people", "pe", "person_id", "''", "person_id", 10**9),
    _section("decisions", "de", "decision", "date", "date, email_id, decision, decided_by", 10**9), _section("open_actions", "ac", "task", "deadline", "deadline nulls last, task, email_id, line", 10**9),
]))
def thread_context(v):
    return dossier.thread_context(v, 17)


def _part(name: str, rows: str, n: int, key: str, value: str, order: str) -> str:
    return f"select attendee, '{name}' as section, row_number() over (partition by attendee order by {order})::bigint as rank, ({key})::varchar as key, ({value})::varchar as value from {rows} qualify row_number() over (partition by attendee order by {order}) <= {n}"


@query("meeting_prep", with_views("mails", "people", "mail_people", "mail_topics", "actions", "decisions") + f""",
who as (select person_id, a as attendee from people, (values ('customer#00000001'), ('supplier#00000000')) t(a) where contains(lower(name), a)),
li as (select distinct attendee, email_id from mail_people join who using (person_id)),
ma as (select * from mails join li using (email_id) where date_received >= date '{AS_OF}' - interval 1500 day),
to_ as (select attendee, sentiment, count(*) as n from ma group by all), de as (select * from decisions join (select attendee, email_id from ma) using (email_id)),
ac as (select a.*, who.attendee from actions a join who on a.owner = who.person_id where status = 'open'), tc as (select attendee, topic, count(*) as n from mail_topics join (select attendee, email_id from ma) using (email_id) group by all)
""" + " union all ".join([
    _part("mails", "ma", 10, "email_id", "date_received::date", "date_received desc, email_id"), _part("sentiments", "to_", 100, "sentiment", "n", "n desc, sentiment"),
    _part("decisions", "de", 10, "decision", "email_id", "email_id desc, decision, decided_by"), _part("open_actions", "ac", 10, "task", "deadline", "deadline nulls last, task, email_id, line"),
    _part("topics", "tc", 5, "topic", "n", "n desc, topic"),
]))
def meeting_prep(v):
    return dossier.meeting_prep(v, ["customer#00000001", "supplier#00000000"], AS_OF, 1500)


@query("recall", "with " + bm25_sql("documents", "doc_id", "text", ["the", "ing"], 5, "a") + ",\n" + bm25_sql("benchmark", "item_id", "text", ["the"], 5, "b") + """,
f as (select 'document' as kind, row_number() over (order by score desc, doc_id)::bigint as rank, doc_id::varchar as id, 'document ' || doc_id as title from a
union all select 'item', row_number() over (order by score desc, item_id)::bigint, item_id::varchar, 'item ' || item_id from b
union all select * from (select 'page' as kind, row_number() over (order by page_id)::bigint as rank, page_id::varchar as id, url as title from pages where contains(lower(html), 'the thing')) where rank <= 5)
select * from f union all select 'summary', 1, 'total_hits', count(*)::varchar from f union all select 'summary', 2, 'kinds_with_results', count(distinct kind)::varchar from f
""")
def recall(v):
    docs = search.ranked(v.document_index().bm25("the ing", 5, columns=["text"]), "doc_id")
    items = search.ranked(v.item_index().bm25("the", 5), "item_id")
    pages = v.table("pages").filter(F.lower("html").contains("the thing")).orderBy("page_id").limit(5).select("page_id", "url", F.lit(0.0).alias("score"))
    return dossier.recall({
        "document": docs.select("rank", F.col("doc_id").alias("id"), F.concat(F.lit("document "), F.col("doc_id")).alias("title")),
        "item": items.select("rank", F.col("item_id").alias("id"), F.concat(F.lit("item "), F.col("item_id")).alias("title")),
        "page": search.ranked(pages, "page_id").select("rank", F.col("page_id").alias("id"), F.col("url").alias("title")),
    })
