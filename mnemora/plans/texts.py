"""Queries of text, URL, JSON and hash functions on pages, documents and events."""

from pyspark.sql import functions as F

from mnemora.functions import extraction
from mnemora.functions import text as T
from mnemora.operators import health
from mnemora.operators import selection as S
from mnemora.plans.catalog import query

_UN = "replace(replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')"
_SQ = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query("html_text", "select page_id, " + _SQ.format(_UN.format("regexp_replace(regexp_replace(regexp_replace(html, '(?s)<style[^>]*>.*?</style>', '', 'g'), '(?s)<script[^>]*>.*?</script>', '', 'g'), '<[^>]+>', ' ', 'g')")) + " as text from pages")
def html_text(v):
    return v.table("pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("html_text_all_entities")
def html_text_all_entities(v):
    return v.table("pages").select("page_id", T.html_text(F.col("html"), T.unescape_html).alias("text"))


@query("html_title", "select page_id, case when regexp_matches(html, '(?is)<title[^>]*>.*?</title>') then " + _UN.format(_SQ.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")) + " end as title from pages")
def html_title(v):
    return v.table("pages").select("page_id", T.html_title(F.col("html")).alias("title"))


_TRACK = "('web', 'source', 'csf', 'e', 'cid', 'nav', 'ref')"


@query("url_parts", """
select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as host, regexp_extract(url, '^([^?#]*)', 1) as bare,
  array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' and not lower(split_part(p, '=', 1)) in ('web', 'source', 'csf', 'e', 'cid', 'nav')), '&') as kept
from pages
""")
def url_parts(v):
    u = F.col("url")
    clean = T.drop_tracking(u)
    return v.table("pages").select("page_id", T.url_host(u).alias("host"), F.regexp_extract(clean, r"^([^?#]*)", 1).alias("bare"), F.regexp_extract(clean, r"\?([^#]*)", 1).alias("kept"))


@query("page_links", """
with h as (select page_id, coalesce(html, '') || ' see <a href="' || url || '?source=x&id=' || page_id || '&WEB=1#top">' || url || '</a>. ' as html from pages),
l as (select page_id, regexp_replace(unnest(regexp_extract_all(html, '(?i)https?://[^\\s"''<>/]+/[^\\s"''<>]*')), '[.,;)"''>]+$', '') as u from h),
p as (select page_id, regexp_extract(u, '^([^?#]*)', 1) as head, regexp_extract(u, '(#.*)$', 1) as tail,
  array_to_string(list_filter(string_split(regexp_extract(u, '\\?([^#]*)', 1), '&'), lambda x: x <> '' and lower(string_split(x, '=')[1]) not in ('web', 'source', 'csf', 'e', 'cid', 'nav')), '&') as kept from l)
select distinct page_id, head || case when kept <> '' then '?' || kept else '' end || tail as link from p
""")
def page_links(v):
    """Links of the pages, to each of which one to itself is added, with and without tracking parameters."""
    own = F.concat(F.coalesce("html", F.lit("")), F.lit(' see <a href="'), "url", F.lit("?source=x&id="), "page_id", F.lit('&WEB=1#top">'), "url", F.lit("</a>. "))
    return v.table("pages").select("page_id", F.explode(T.extract_urls(own, r"[^\s\"'<>/]+")).alias("link"))


@query("video_ids", """
select doc_id, case when doc_id % 6 < 4 then 'v' || doc_id end as video from documents union all select page_id, null from pages where not regexp_matches(lower(url), '^https?://(www\\.|m\\.)?(youtube\\.com|youtu\\.be)[/:?]')
""")
def video_ids(v):
    """Documents by URLs of six forms, of which four name a video, and the pages' own URLs."""
    i, k = F.concat(F.lit("v"), "doc_id"), F.col("doc_id") % 6
    url = F.when(k == 0, F.concat(F.lit("https://youtu.be/"), i, F.lit("?t=3"))).when(k == 1, F.concat(F.lit("https://www.youtube.com/watch?list=1&v="), i)).when(k == 2, F.concat(F.lit("https://youtube.com/shorts/"), i, F.lit("/")))
    url = url.when(k == 3, F.concat(F.lit("https://m.youtube.com/embed/"), i, F.lit("?x"))).when(k == 4, F.concat(F.lit("https://example.com/watch?v="), i)).otherwise("https://www.youtube.com/v/")
    rows = v.table("documents").select("doc_id", url.alias("url")).unionByName(v.table("pages").filter(~F.lower("url").rlike(r"^https?://(www\.|m\.)?(youtube\.com|youtu\.be)[/:?]")).select(F.col("page_id").alias("doc_id"), "url"))
    return rows.select("doc_id", T.video_id(F.col("url")).alias("video"))


@query("file_slugs", """
with n as (select doc_id, lower(regexp_replace(regexp_replace(regexp_replace(strip_accents(coalesce(text, '')) || case when doc_id % 2 = 0 then ' -- v1..PDF' else '' end, '[^\\x00-\\x7F]', '', 'g'), '[^\\w\\s.-]', '', 'g'), '^\\s+|\\s+$', '', 'g')) as s from documents),
p as (select doc_id, regexp_replace(regexp_replace(s, '[\\s_-]+', '_', 'g'), '[.]+', '.', 'g') as s from n),
c as (select doc_id, case when length(s) <= 60 then s when regexp_matches(s, '[.][^.]{0,7}$') then left(s, 59 - length(regexp_extract(s, '[.]([^.]{0,7})$', 1))) || '.' || regexp_extract(s, '[.]([^.]{0,7})$', 1) else left(s, 60) end as s from p)
select doc_id, regexp_replace(s, '^[._]+|[._]+$', '', 'g') as slug from c
""")
def file_slugs(v):
    """Whole texts as names of files, half of them with an extension."""
    name = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, " -- v1..PDF").otherwise(""))
    return v.table("documents").select("doc_id", T.file_slug(name).alias("slug"))


@query("root_labels", """
with f as (select page_id, '/data/' || case page_id % 5 when 0 then 'notes/' when 1 then 'notes/web/' || (page_id % 7) || '/' when 2 then 'webmail/' when 3 then 'web/x/y/' else 'other/z/' end || 'f' || page_id as path from pages)
select page_id, case page_id % 5 when 0 then 'notes' when 1 then 'notes/web/' || (page_id % 7) when 2 then 'webmail' when 3 then 'web/x/y' else 'z' end as label from f
""")
def root_labels(v):
    """Files below roots of which one's name begins another's."""
    k = F.col("page_id") % 5
    folder = F.when(k == 0, "notes/").when(k == 1, F.concat(F.lit("notes/web/"), F.col("page_id") % 7, F.lit("/"))).when(k == 2, "webmail/").when(k == 3, "web/x/y/").otherwise("other/z/")
    path = F.concat(F.lit("file:/data/"), folder, F.lit("f"), "page_id")
    return v.table("pages").select("page_id", health.root_label(path, ["/data/web", "/data/webmail/", "/data/notes"]).alias("label"))


@query("noise_filter", "select doc_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 600 or length(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '[^\\p{L}\\p{N}]', '', 'g')) < 0.7 * length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) as noise from documents")
def noise_filter(v):
    return v.table("documents").select("doc_id", T.is_noise(F.col("text"), 600, 0.7).alias("noise"))


@query("slugs", "select doc_id, regexp_replace(left(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '-'), 60), '-+$', '') as slug from documents")
def slugs(v):
    return v.table("documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("subject_threads", """
with s as (select doc_id, case doc_id % 4 when 0 then 'Re: FW:  RE : ' when 1 then 'Fwd: ' when 2 then '' else ' re:' end || source as subject from documents)
select lower(trim(regexp_replace(trim(subject), '(?i)^(\\s*(re|fwd|fw)\\s*:\\s*)+', ''))) as subject_key, count(*) as mails from s group by 1
""")
def subject_threads(v):
    lead = F.when(F.col("doc_id") % 4 == 0, "Re: FW:  RE : ").when(F.col("doc_id") % 4 == 1, "Fwd: ").when(F.col("doc_id") % 4 == 2, "").otherwise(" re:")
    return S.subject_threads(v.table("documents").select(F.concat(lead, "source").alias("subject")))


@query("thread_keys", """
select doc_id, left(sha256(coalesce(case when doc_id % 2 = 0 then 'conv' || doc_id % 10 end, nullif(regexp_extract(case when doc_id % 3 = 0 then '<r' || doc_id || '> <x>' else '' end, '^\\s*(\\S+)', 1), ''), case when doc_id % 5 = 0 then '<p>' end, lower(source))), 16) as thread_id from documents
""")
def thread_keys(v):
    d = F.col("doc_id")
    conv, refs = F.when(d % 2 == 0, F.concat(F.lit("conv"), d % 10)), F.when(d % 3 == 0, F.concat(F.lit("<r"), d, F.lit("> <x>"))).otherwise("")
    return v.table("documents").select("doc_id", T.thread_key(conv, refs, F.when(d % 5 == 0, "<p>"), F.concat(F.lit("Re: "), F.col("source"))).alias("thread_id"))


@query("content_ids", "select doc_id, '-' || ('0x' || left(sha256(text), 15))::bigint as message_id, sha1(source) as source_hash from documents")
def content_ids(v):
    return v.table("documents").select("doc_id", T.document_id(F.col("text").cast("binary")).alias("message_id"), F.sha1("source").alias("source_hash"))


@query("embed_texts", "select doc_id, concat_ws(' — ', nullif(concat_ws(' · ', nullif(trim(case when doc_id % 3 = 0 then ' ' else source end), ''), nullif(lang, ''), case when doc_id % 2 = 0 then '2024-01-02' end), ''), nullif(trim(text), '')) as t from documents")
def embed_texts(v):
    d = F.col("doc_id")
    return v.table("documents").select("doc_id", T.embed_text(F.when(d % 3 == 0, " ").otherwise(F.col("source")), F.col("lang"), F.when(d % 2 == 0, "2024-01-02T10:00:00"), F.col("text")).alias("t"))


@query("json_props", "select event_id, json_extract_string(props, '$.k')::int as k, json_extract_string(props, '$.k') is not null as has from events")
def json_props(v):
    k = F.from_json("props", "k int")["k"]
    return v.table("events").select("event_id", k.alias("k"), k.isNotNull().alias("has"))


@query("id_kinds", "select case when doc_id % 4 = 0 then 'numeric' when doc_id % 4 = 1 then 'document' when doc_id % 4 = 2 then 'news' else 'opaque' end as kind, count(*) as n from documents group by 1")
def id_kinds(v):
    d = F.col("doc_id")
    mid = F.when(d % 4 == 0, d.cast("string")).when(d % 4 == 1, F.concat(F.lit("-"), d)).when(d % 4 == 2, F.concat(F.lit("news:"), d)).otherwise(F.concat(F.lit("AA="), d))
    return v.table("documents").groupBy(T.id_kind(mid).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("repaired_answers", "select user_id as id, 'user ' || user_id as summary, event_type as topic, 'open' as status, 'low' as urgency from events where event_id % 300 <> 200")
def repaired_answers(v):
    e = v.table("events")
    text = F.concat(F.lit('```json\n{"summary": "user '), "user_id", F.lit('", "topics": ["'), "event_type", F.lit('",], "urgency": "??", "action_items": ["do it"'))
    whole = F.when(F.col("event_id") % 300 == 200, "no object").otherwise(text)
    a = F.explode(F.array(extraction.parsed(whole)))  # a generator's column: the filter doesn't run the UDF again
    return e.select(F.col("user_id").alias("id"), a.alias("a")).filter("a is not null").select("id", "a.summary", F.col("a.topics")[0].alias("topic"), F.col("a.action_items")[0]["status"].alias("status"), "a.urgency")


@query("mime_types", "select doc_id, case doc_id % 3 when 0 then 'application/pdf' when 1 then 'image/png' else 'application/octet-stream' end as mime from documents")
def mime_types(v):
    name = F.concat(F.lit("a."), F.when(F.col("doc_id") % 3 == 0, "PDF").when(F.col("doc_id") % 3 == 1, "png").otherwise("xyz"))
    return v.table("documents").select("doc_id", S.mime_of(name).alias("mime"))
