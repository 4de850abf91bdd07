"""Queries of searches over sessions, events, images and links, on the driver's tables."""

from pyspark.sql import functions as F

from mnemora.operators import recalls as R
from mnemora.operators import search, vectors
from mnemora.operators.dossier import section
from mnemora.plans.catalog import query
from mnemora.plans.retrieval import SEMANTIC, bm25_sql, semantic_mails
from mnemora.session import stored

_FACTS = "f as (select event_id as fact_id, case event_id % 3 when 0 then '[PREFERENCE] ' when 1 then '[TECHNICAL] ' else '' end || event_type as fact, ts as seen_at from events)"


@query("preference_recall", f"with {_FACTS}, n as (select * from f where fact like '[%' order by seen_at desc, fact_id limit 40) select fact_id, fact from n order by seen_at desc, fact_id limit 40")
def preference_recall(v):
    return R.preferences(v.fact_rows(), "no such topic", 40, v.fact_index()).select("fact_id", "fact")


@query("preference_topic", f"with {_FACTS}, tagged as (select * from f where fact like '[%'),\n" + bm25_sql("tagged", "fact_id", "fact", ["click"], 40) + """,
n as (select * from tagged order by seen_at desc, fact_id limit 40),
ids as (select fact_id from n where contains(lower(fact), 'click') union select fact_id from r)
select fact_id, fact from tagged where fact_id in (select fact_id from ids) or not exists (select 1 from ids) order by seen_at desc, fact_id limit 40
""")
def preference_topic(v):
    """Tagged facts on a topic that occurs: among the newest, and by rank among all."""
    return R.preferences(v.fact_rows(), "click", 40, v.fact_index()).select("fact_id", "fact")


@query("image_search", """
with i as (select doc_id, text, n_chars from documents where lang = 'en' and contains(lower(text), 'thing') order by n_chars desc, doc_id::varchar limit 30)
select i.doc_id::varchar as sha256, count(e.event_id) as occurrences, min(e.value) as first from i left join events e on e.event_id % 1000 = i.doc_id group by 1
""")
def image_search(v):
    images = v.table("documents").select(F.col("doc_id").cast("string").alias("sha256"), F.when(F.col("lang") == "en", "content").otherwise("noise").alias("classification"), F.col("text").alias("vision_description"), F.col("n_chars").alias("classified_at"))
    where = v.table("events").select((F.col("event_id") % 1000).cast("string").alias("sha256"), F.col("event_id").alias("message_id"), F.col("event_type").alias("sender_email"), F.col("value").alias("position_in_body"))
    found = R.image_search(images, where, "Thing", 30)
    return found.select("sha256", F.coalesce(F.size("occurrences"), F.lit(0)).cast("long").alias("occurrences"), F.col("occurrences")[0]["position_in_body"].alias("first"))


@query("calendar_events", """
with e as (select o_orderkey as event_id, o_orderdate as start_at from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate <= timestamp '1998-01-01'
  and o_orderkey in (select l_orderkey from lineitem where contains('supplier ' || l_suppkey, 'supplier 1')) order by 2, 1 limit 20)
select event_id, start_at, string_agg('Supplier ' || l_suppkey, ',' order by 'Supplier ' || l_suppkey) as attendees from e join lineitem on l_orderkey = event_id group by 1, 2
""")
def calendar_events(v):
    events = v.table("orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("start_at"), F.lit(None).cast("string").alias("organizer_name"), F.lit("x").alias("organizer_email"))
    who = v.table("lineitem").select(F.col("l_orderkey").alias("event_id"), F.concat(F.lit("Supplier "), "l_suppkey").alias("name"), F.lit("").alias("email"))
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    found = R.calendar_events(events, who, "supplier 1", at("1997-01-01"), at("1998-01-01"))
    return found.select("event_id", "start_at", F.array_join("attendees", ",").alias("attendees"))


@query("recent_sessions", "select user_id as session_id, max(ts) as started_at from events group by 1 having max(ts) >= timestamp '2024-01-30' and user_id % 2 = 0 order by 2 desc, 1 limit 20")
def recent_sessions(v):
    s = v.table("events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("started_at")).withColumn("workspace", F.when(F.col("session_id") % 2 == 0, "Home").otherwise("Work"))
    return R.recent_sessions(s, F.lit("2024-02-06").cast("timestamp_ntz"), 7, "home").select("session_id", "started_at")


@query("link_index", "select page_id::varchar as url from pages where page_id % 3 = 0 order by page_id % 7 nulls first, page_id::varchar limit 50")
def link_index(v):
    links = v.table("pages").select(F.col("page_id").cast("string").alias("url"), F.when(F.col("page_id") % 3 != 0, F.lit(1)).alias("fetched_at"), F.lit("ok").alias("last_status"), (F.col("page_id") % 7).alias("last_attempt_at"))
    return R.link_index(links, "unfetched").select("url")


@query("known_names", "select exists(select 1 from customer where contains(lower(c_name), '#00000001')) as person, exists(select 1 from part where contains(lower(p_brand), '#00000001')) as topic")
def known_names(v):
    return R.known_names(v.table("customer").select(F.col("c_name").alias("name")), v.table("part").select(F.col("p_brand").alias("name")), "#00000001")


@query("session_children", """
with l as (select conv_id, max(turn) as turn from conversations group by 1), a as (select l.conv_id * 1000 + l.turn as turn_id, l.conv_id from l)
select turn_id, 'decision' as kind, 'd' || conv_id as text from a union all select turn_id, 'fact', '[PREFERENCE] p' || conv_id from a where conv_id % 2 = 0
""")
def session_children(v):
    turns = v.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"))
    i = F.col("session_id")
    none = F.lit(None).cast("array<string>")
    answers = turns.select("session_id").distinct().select(i, F.array(F.concat(F.lit("d"), i)).alias("decisions"), none.alias("facts"), F.when(i % 2 == 0, F.array(F.concat(F.lit("p"), i))).alias("preferences"), none.alias("technical"))
    return R.session_children(turns, answers)


_ALL = "in"


def _like_sql(kind: str, rows: str, key: str, column: str, order: str) -> str:
    return f"""select '{kind}' as kind, row_number() over (order by {order})::bigint as rank, ({key})::varchar as id, ({column})::varchar as title
from {rows} where contains(lower({column}), '{_ALL}') qualify row_number() over (order by {order}) <= 5"""


@query("recall_all", "with " + bm25_sql("documents", "doc_id", "text", [_ALL], 20, "m") + ",\n" + bm25_sql("ev", "item_id", "text", [_ALL], 5, "i").replace("i_t as", "ev as (select * from benchmark),\ni_t as") + ",\n"
    + bm25_sql("st", "conv_id", "summary", [_ALL], 5, "ca").replace("ca_t as", "st as (select conv_id, string_agg(text, chr(10) order by turn) as summary from conversations where turn < 2 group by 1),\nca_t as") + ",\n"
    + bm25_sql("tt", "id", "text", [_ALL], 10, "cb").replace("cb_t as", "tt as (select conv_id * 1000 + turn as id, text from conversations),\ncb_t as") + ",\n"
    + bm25_sql("dd", "doc_id", "text", [_ALL], 10, "ch").replace("ch_t as", "dd as (select doc_id, text from documents),\nch_t as") + f""",
mk as (select doc_id as id, row_number() over (order by score desc, doc_id) as rank from m), {SEMANTIC}
se as (select email_id as id, row_number() over (order by similarity desc, email_id) as rank from g qualify row_number() over (order by similarity desc, email_id) <= 20),
fu as (select id, round(sum(1.0::double / (60 + rank)), 12) as score, min(rank) as best from (select * from mk union all select * from se) group by id),
em as (select 'email' as kind, row_number() over (order by score desc, best, id)::bigint as rank, id::varchar as id, case when id in (select id from mk) then 'keyword' else 'semantic' end as title from fu qualify row_number() over (order by score desc, best, id) <= 5),
ra as (select conv_id as key, row_number() over (order by score desc, conv_id) as rank from ca), sb as (select id // 1000 as key, max(score) as score from cb group by 1), rb as (select key, row_number() over (order by score desc, key) as rank from sb),
s1 as (select key, 'session' as source, 0 as p, rank from ra where rank <= 5), s2 as (select key, 'turn' as source, 1 as p, rank from rb where rank <= 5 - (select count(*) from s1) and key not in (select key from s1)),
co as (select 'conversation' as kind, row_number() over (order by p, rank, key)::bigint as rank, key::varchar as id, source as title from (select * from s1 union all select * from s2)),
cx as (select coalesce(try_cast(regexp_extract(source, '(\\d{{1,9}})$', 1) as bigint), -1) as key, max(score) as score from ch join documents using (doc_id) group by 1),
cc as (select 'chat' as kind, row_number() over (order by score desc, key)::bigint as rank, key::varchar as id, 'message' as title from cx qualify row_number() over (order by score desc, key) <= 5),
f as (select * from em union all select * from co union all select * from cc
union all """ + _like_sql("decision", "benchmark", "item_id", "text", "item_id desc") + "\nunion all " + _like_sql("action", "documents join labels using (doc_id)", "doc_id", "text", "quality asc nulls last, doc_id") + "\nunion all " + _like_sql("commitment", "conversations", "conv_id * 1000 + turn", "text", "conv_id * 1000 + turn")
    + "\nunion all " + _like_sql("image", "documents", "doc_id", "text", "n_chars desc, doc_id") + f"""
union all select 'event', row_number() over (order by score desc, item_id)::bigint, item_id::varchar, 'item ' || item_id from i),
pc as (select 'person_context' as kind, row_number() over (order by count(*) desc, coalesce(status, ''))::bigint as rank, 'sales:' || coalesce(status, '') as id, count(*)::varchar as title from sales
  where client_id = (select min(client_id) from clients where contains(lower(name), '{_ALL}')) group by coalesce(status, '')),
tc as (select 'topic_context' as kind, row_number() over (order by count(*) desc, name)::bigint as rank, 'items:' || name as id, count(*)::varchar as title from sale_lines join items using (item_id) where contains(lower(name), '{_ALL}') group by name
  qualify row_number() over (order by count(*) desc, name) <= 3)
select * from f union all select * from tc union all select * from pc
union all select 'summary', 1, 'total_hits', count(*)::varchar from f union all select 'summary', 2, 'kinds_with_results', coalesce(string_agg(distinct kind, ',' order by kind), '') from f
union all select 'summary', 3, 'has_person_context', (count(*) > 0)::varchar from pc union all select 'summary', 4, 'has_topic_context', (count(*) > 0)::varchar from tc
""")
def recall_all(v):
    """Everything on a word: eight kinds, of which mails are by rank and by meaning, and a person's and a topic's context."""
    docs, said = v.table("documents"), v.table("conversations")
    keyword = search.ranked(stored(v.document_index().bm25(_ALL, 20, columns=["text"]), "hits"), "doc_id").select(F.col("doc_id").alias("id"), "rank")
    semantic = search.ranked(stored(semantic_mails(v), "hits").withColumnRenamed("similarity", "score"), "email_id").select(F.col("email_id").alias("id"), "rank").filter("rank <= 20")
    emails = vectors.hybrid(keyword, semantic, 5).select(F.col("place").alias("rank"), "id", F.col("source").alias("title"))
    turns = v.turns_of_chats().select(F.col("id").alias("turn_id"), F.col("chat_id").alias("session_id"))
    talks = R.session_search(v.chat_index(), v.turn_index(), _ALL, 5, turns, (["summary", "title"], ["text"])).select(F.col("place").alias("rank"), F.col("session_id").alias("id"), F.col("source").alias("title"))
    posts = docs.select(F.col("doc_id").alias("message_id"), F.regexp_extract("source", r"(\d{1,9})$", 1).try_cast("long").alias("thread_id"))
    chats = R.chat_search(v.source_index(), v.document_index(), _ALL, 5, posts, (["title", "summary"], ["text"])).select(F.col("place").alias("rank"), F.col("thread_id").alias("id"), F.col("source").alias("title"))
    events = search.ranked(v.item_index().bm25(_ALL, 5), "item_id").select("rank", F.col("item_id").alias("id"), F.concat(F.lit("item "), "item_id").alias("title"))
    kinds = {
        "email": emails, "conversation": talks, "event": events, "chat": chats,
        "decision": R.like_ranked(v.table("benchmark"), "item_id", "text", _ALL, F.desc("item_id")),
        "action": R.like_ranked(docs.join(v.table("labels"), "doc_id"), "doc_id", "text", _ALL, F.asc_nulls_last("quality")),
        "commitment": R.like_ranked(said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text"), "turn_id", "text", _ALL),
        "image": R.like_ranked(docs, "doc_id", "text", _ALL, F.desc("n_chars")),
    }
    people, topics = v.table("clients"), v.table("items")
    has = F.lower("name").contains(_ALL)
    first = people.filter(has).agg(F.min("client_id").alias("client_id"))
    sales = v.table("sales").join(first, "client_id").groupBy(F.coalesce("status", F.lit("")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    lines = v.table("sale_lines").select("item_id").join(topics.filter(has).select("item_id", F.col("name").alias("k")), "item_id").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    person = section(sales, "sales", F.col("k"), F.col("n"), F.desc("n"), F.col("k"))
    topic = section(lines, "items", F.col("k"), F.col("n"), F.desc("n"), F.col("k"), limit=3)
    return R.unified(kinds, 5, R.known_names(people, topics, _ALL), {"person": person, "topic": topic})
