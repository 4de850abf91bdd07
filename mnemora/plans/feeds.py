"""Queries of readers: the driver's tables are written as the files that a store is fed with, and read back."""

from __future__ import annotations

import zipfile
from pathlib import Path
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.functions import mime
from mnemora.functions import text as T
from mnemora.operators import health, writes
from mnemora.plans.catalog import query
from mnemora.session import fresh_path, spread
from mnemora.sources import readers


def _iso(c: str):
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def _files(v, name: str, rows: DataFrame) -> str:
    folder = fresh_path(v.spark, name)
    writes.write_files(rows, folder)
    return folder


@query("staged_mails", """
select o_orderkey::varchar as message_id, case when o_custkey % 7 = 0 then 'again ' || o_orderstatus else o_orderpriority end as subject, epoch(o_orderdate)::bigint as received, 'c' || o_custkey || '@x.example' as sender from orders
""")
def staged_mails(v):
    """All orders as staged mails; a seventh of the customers' are staged again in later batches."""
    o = v.table("orders")
    sender = F.struct(F.concat(F.lit("C "), "o_custkey").alias("name"), F.concat(F.lit("c"), "o_custkey", F.lit("@x.example")).alias("address"))
    mails = lambda df, subject: df.select(F.col("o_orderkey").cast("string").alias("message_id"), subject.alias("subject"), _iso("o_orderdate").alias("date_received"), sender.alias("sender"))
    number = F.expr("cast(message_id as long) div 2000")
    files = writes.staging_files(mails(o, F.col("o_orderpriority")), number).unionByName(writes.staging_files(mails(o.filter("o_custkey % 7 = 0"), F.concat(F.lit("again "), "o_orderstatus")), number + 500_000_000))
    staged = readers.staging_batches(v.spark, f"{_files(v, 'staging', files)}/batch-*.json")
    return staged.select("message_id", "subject", F.unix_seconds("received_at").alias("received"), F.col("sender.address").alias("sender"))


@query("answer_files", """
select lower(s_name) as message_key, 'all of ' || s_name as summary, 'nation ' || s_nationkey as topic, 'informational' as sentiment from supplier where s_suppkey % 10 <> 9
""")
def answer_files(v):
    """A file per supplier with a model's answer, fenced and with a comma too many; a tenth can't be read."""
    answer = F.concat(F.lit('```json\n{"summary": "all of '), "s_name", F.lit('", "topics": ["nation '), "s_nationkey", F.lit('",],}\n```'))
    rows = v.table("supplier").select(F.concat("s_name", F.lit(".json")).alias("name"), F.when(F.col("s_suppkey") % 10 == 9, "sorry").otherwise(answer).alias("content"))
    found = readers.extractions(v.spark, _files(v, "answers", rows))
    return found.select("message_key", "answer.summary", F.col("answer.topics")[0].alias("topic"), "answer.sentiment")


def _transcripts(v) -> str:
    """Conversations as session files in folders by workspace: a line a turn, by kind (conv_id + turn) % 8.

    Texts that begin with a bracket, tools of every sort, thinking and results; system lines and lines that can't be
    read; times that are equal, missing, or run backwards.
    """
    c = v.table("conversations").filter("conv_id is not null and turn is not null").withColumn("k", F.expr("(conv_id + turn) % 8"))
    block = lambda kind, **fields: F.struct(F.lit(kind).alias("type"), *[x.alias(n) for n, x in fields.items()])
    said = block("text", text=F.col("text"))
    tool = lambda name, **fields: block("tool_use", name=F.lit(name), input=F.struct(*[x.alias(n) for n, x in fields.items()]))
    listed = lambda *blocks: F.concat(F.lit("["), F.array_join(F.array(*[F.to_json(x) for x in blocks]), ", "), F.lit("]"))
    name = F.concat(F.lit("f"), "turn")
    content = (
        F.when(F.col("k") == 1, listed(said, tool("Read", file_path=name)))
        .when(F.col("k") == 2, listed(block("thinking", text=F.col("text")), tool("Grep", pattern=name, path=F.lit("x"))))
        .when(F.col("k") == 3, listed(said, tool("Edit", file_path=name)))
        .when(F.col("k") == 4, listed(tool("Bash", command=F.col("text"))))
        .when(F.col("k") == 5, listed(tool("Write", file_path=name), said))
        .when(F.col("k") == 6, listed(block("tool_result", text=F.col("text")), tool("Fetch", url=name), said))
        .otherwise(F.expr("regexp_replace(to_json(array(case when k = 0 then '[done] ' else '' end || text)), '(?s)^.|.$', '')"))
    )
    kind = F.when(F.col("k") == 7, F.when(F.col("turn") % 2 == 0, "system").otherwise("progress")).when(F.col("role") == "user", "user").otherwise("assistant")
    time = F.when(F.col("turn") % 3 == 1, F.lit("2026-01-01T10:00:00Z")).when(F.col("turn") % 3 == 2, F.concat(F.lit("2026-01-01T09:"), F.lpad((F.lit(59) - F.col("turn") % 60).cast("string"), 2, "0"), F.lit(":00.5Z")))
    head = F.to_json(F.struct(kind.alias("type"), F.when(F.col("turn") > 0, F.concat(F.lit("s"), "conv_id")).alias("sessionId"), F.when(F.col("turn") > 1, F.concat(F.lit("/w/p"), F.col("conv_id") % 3)).alias("cwd"), time.alias("timestamp")))
    speaker = F.when(F.col("turn") % 3 == 1, "user").otherwise(F.col("role"))
    line = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(', "message": {"role": "'), speaker, F.lit('", "content": '), content, F.lit("}}\n{broken"))
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("content"))
    return _files(v, "sessions", whole.select(F.concat(F.lit("-w"), F.col("conv_id") % 3, F.lit("/conv-"), "conv_id", F.lit(".jsonl")).alias("name"), "content"))


_TURNS_SQL = """
with e as (select *, (conv_id + turn) % 8 as k, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as said from conversations where conv_id is not null and turn is not null),
r as (select conv_id, turn, k, case when turn % 3 = 1 or role = 'user' then 'user' else 'assistant' end as who,
  case k when 0 then rtrim('[done] ' || regexp_replace(text, '\\s+$', '', 'g')) when 1 then concat_ws(chr(10), nullif(said, ''), '[Tool: Read f' || turn || ']') when 2 then '[Tool: Grep f' || turn || ']'
    when 3 then concat_ws(chr(10), nullif(said, ''), '[Tool: Edit f' || turn || ']') when 4 then '[Tool: Bash ' || left(coalesce(text, ''), 100) || ']' when 5 then concat_ws(chr(10), '[Tool: Write f' || turn || ']', nullif(said, ''))
    when 6 then concat_ws(chr(10), '[Tool: Fetch]', nullif(said, '')) end as text,
  case turn % 3 when 1 then '2026-01-01 10:00:00' when 2 then '2026-01-01 09:' || lpad((59 - turn % 60)::varchar, 2, '0') || ':00.5' end::timestamp as tm from e),
c as (select *, case when who = lag(who) over (partition by conv_id order by turn) then 0 else 1 end as ch from r where text <> ''),
n as (select *, sum(ch) over (partition by conv_id order by turn rows unbounded preceding) as run from c),
s as (select conv_id, coalesce('s' || max(conv_id) filter (where turn > 0), 'conv-' || conv_id) as session_id, arg_min(tm, turn) filter (where tm is not null) as started, arg_max(tm, turn) filter (where tm is not null) as ended,
  coalesce('/w/p' || max(conv_id % 3) filter (where turn > 1), '') as workspace from r where not (k = 7 and turn % 2 = 1) group by conv_id),
t as (select conv_id, (run - 1)::bigint as turn_index, min(who) as speaker, count(*) as parts, string_agg(text, chr(10) order by turn) as content, arg_max(tm, turn) filter (where tm is not null) as tm from n group by conv_id, run)
"""


@query("transcript_turns", _TURNS_SQL + """
select session_id, turn_index, speaker, parts, epoch_us(tm) as at, case when length(content) > 50000 then left(content, 50000) || chr(10) || '[...truncated]' else content end as content, contains(content, '```') as has_code, contains(content, '[Tool:') as has_tool_use
from t join s using (conv_id)
""")
def transcript_turns(v):
    return readers.transcripts(v.spark, _transcripts(v)).select("session_id", "turn_index", "speaker", "parts", F.unix_micros("at").alias("at"), "content", "has_code", "has_tool_use")


@query("transcript_sessions", _TURNS_SQL + """
select session_id, workspace, regexp_extract(workspace, '([^/]*)$', 1) as project, epoch_us(started) as started, epoch_us(ended) as ended, count(*) as turn_count
from t join s using (conv_id) group by all having count(*) filter (where speaker = 'user') >= 2
""")
def transcript_sessions(v):
    found = readers.transcript_sessions(v.spark, _transcripts(v))
    return found.select("session_id", "workspace", "project", F.unix_micros("started_at").alias("started"), F.unix_micros("ended_at").alias("ended"), "turn_count")


@query("session_listing", "select distinct 'conv-' || conv_id || '.jsonl' as name, '/w1' as workspace from conversations where conv_id % 3 = 1")
def session_listing(v):
    found = readers.session_files(v.spark, _transcripts(v), "2100-01-01", days=365 * 200, workspace="W1")
    return found.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "workspace")


def _folder(v) -> str:
    """Benchmark items as text files, pages as HTML files, and some that no extractor reads."""
    items = v.table("benchmark").select(F.concat(F.lit("notes/item-"), "item_id", F.lit(".TXT")).alias("name"), F.col("text").alias("content"))
    pages = v.table("pages").select(F.concat(F.lit("web/page-"), "page_id", F.lit(".html")).alias("name"), F.coalesce("html", F.lit("")).alias("content"))
    other = v.table("benchmark").select(F.concat(F.lit("other/item-"), "item_id", F.lit(".bin")).alias("name"), F.col("text").alias("content"))
    return _files(v, "folder", items.unionByName(pages).unionByName(other))


@query("folder_documents", "select '-' || ('0x' || left(sha256(text), 15))::bigint as message_id, min('item-' || item_id || '.TXT') as filename, text from benchmark group by text")
def folder_documents(v):
    return readers.standalone_documents(readers.files(v.spark, [_folder(v), "/no/such/root"], [".txt"], content=True))


_HTML = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<style[^>]*>.*?</style>', '', 'g'), '(?s)<script[^>]*>.*?</script>', '', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))".replace("\\\\s", "\\s").replace('\\"', '"')


@query("extracted_texts", f"""
with h as (select 'page-' || page_id || '.html' as name, {_HTML} as text, strlen(coalesce(html, '')) as n from pages),
r as (select name, case when n <= 20000 then nullif(text, '') end as text, case when n > 20000 then 'too_large' when coalesce(text, '') = '' then 'empty' else 'extracted' end as status from h
union all select 'item-' || item_id || '.TXT', nullif(trim(text), ''), case when trim(text) = '' then 'empty' else 'extracted' end from benchmark union all select 'item-' || item_id || '.bin', null, 'unsupported' from benchmark)
select name, md5(text) as digest, status from r
""")
def extracted_texts(v):
    found = readers.files(v.spark, [_folder(v)], [".txt", ".html", ".bin"], content=True)
    plain = lambda c: F.decode(c, "UTF-8")
    return readers.extracted(found, {"txt": plain, "html": lambda c: T.html_text(plain(c))}, 20_000).select("name", F.md5(F.col("text").cast("binary")).alias("digest"), "status")


@query("document_roots", "select 'notes' as root, count(*) as files from benchmark union all select 'web', count(*) from pages union all select 'nowhere', 0")
def document_roots(v):
    folder = _folder(v)
    found = health.newest_files(readers.files(v.spark, [folder], [".txt", ".html"]), [f"{folder}/{r}" for r in ("notes", "web", "nowhere")], F.current_timestamp())
    return found.select(F.regexp_extract("root", r"([^/]*)$", 1).alias("root"), "files")


@query("marker_files", """
with n as (select lower(o_orderpriority[3:]) as name from orders group by 1)
select name || '.log' as name, 'log' as kind, 'OK' as state from n union all select 'absent.log', 'log', 'MISSING' union all select 'needs_login', 'sentinel', 'PRESENT' union all select 'paused', 'sentinel', 'ABSENT'
""")
def marker_files(v):
    """A log per order priority, one that is missing, and two sentinels of which one is there."""
    logs = v.table("orders").select(F.concat(F.lower(F.substring("o_orderpriority", 3, 100)), F.lit(".log")).alias("name"), F.lit("line").alias("content")).distinct()
    folder = _files(v, "markers", logs.unionByName(v.spark.createDataFrame([("needs_login", "x")], "name string, content string")))
    known = {f"{n}.log": "log" for n in ("urgent", "high", "medium", "low", "not specified", "absent")} | {"needs_login": "sentinel", "paused": "sentinel"}
    found = readers.files(v.spark, [folder], [".log", ""])
    return health.marker_files(found, known, F.current_timestamp()).select("name", "kind", "state")


@query("proxy_addresses", "select distinct lower(trim(' S' || s_suppkey // 2 || '@X.example')) as email from supplier where s_suppkey % 3 = 0")
def proxy_addresses(v):
    """Suppliers as a list of people in one file; each third acts for the user."""
    one = F.to_json(F.struct(F.concat(F.lit(" S"), F.expr("s_suppkey div 2"), F.lit("@X.example")).alias("email"), (F.col("s_suppkey") % 3 == 0).alias("is_proxy_for_self")))
    people = v.table("supplier").agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ",\n"), F.lit("]")).alias("content")).select(F.lit("people.json").alias("name"), "content")
    return readers.proxy_addresses(v.spark, f"{_files(v, 'people', people)}/people.json")


@query("frontmatter_read", "select doc_id, source as title, case when doc_id % 2 = 0 then lang end as lang, case when doc_id % 3 < 2 then md5(coalesce(text, '')) else md5(coalesce(text, '') || '---') end as body from documents where doc_id % 3 < 2 union all select doc_id, null, null, md5('plain ' || coalesce(text, '')) from documents where doc_id % 3 = 2")
def frontmatter_read(v):
    """Documents with a block of fields before them, of which each third has none."""
    lang = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("lang: '"), "lang", F.lit("'\n"))).otherwise("# no language\n")
    body = F.coalesce("text", F.lit(""))
    whole = F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("plain "), body)).otherwise(F.concat(F.lit('---\ntitle: "'), "source", F.lit('"\n'), lang, F.lit("---\n"), body))
    found = v.table("documents").select("doc_id", readers.frontmatter(whole).alias("f"))
    return found.select("doc_id", F.col("f.meta")["title"].alias("title"), F.col("f.meta")["lang"].alias("lang"), F.md5(F.col("f.body").cast("binary")).alias("body"))


def _foreign(v, rows: DataFrame, name: str) -> str:
    """The URL of a database with one table: it loads the files that Spark writes, is closed, and archived for readers elsewhere."""
    folder = f"{fresh_path(v.spark, 'foreign')}"
    rows.write.option("escape", '"').csv(f"{folder}/rows")
    at = Path(urlparse(folder).path)  # the database engine opens plain paths only
    jvm = v.spark._jvm
    jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")  # else it writes a log beside the driver
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR(32672)"}
    db = jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{at}/store;create=true")
    run = db.createStatement()
    run.execute(f'CREATE TABLE {name} (' + ", ".join(f'"{c}" {kinds.get(t, t)}' for c, t in rows.dtypes) + ")")
    for part in sorted((at / "rows").glob("part-*.csv")):
        run.execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_DATA(NULL, '{name.upper()}', NULL, NULL, '{part}', ',', '\"', 'UTF-8', 0)")
    db.close()
    try:
        jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{at}/store;shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # that it was closed
            raise
    with zipfile.ZipFile(at / "store.jar", "w", zipfile.ZIP_STORED) as archive:
        for f in sorted((at / "store").rglob("*")):
            archive.write(f, f.relative_to(at))
    return f"jdbc:derby:jar:({at}/store.jar)store"


@query("foreign_table", "select s_suppkey, s_name, s_acctbal from supplier where s_acctbal > 100 and s_nationkey < 13")
def foreign_table(v):
    """Suppliers in a foreign database, read by two predicates at once: a read-only archive in the shared folder, which every executor opens."""
    url = _foreign(v, v.table("supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey"), "supplier")
    rows = readers.database(v.spark, url, "supplier", ['"s_suppkey" < 50 AND "s_nationkey" < 13', '"s_suppkey" >= 50 AND "s_nationkey" < 13'])
    return rows.filter("s_acctbal > 100").select("s_suppkey", "s_name", "s_acctbal")


_MIME_SQL = """
with d as (select doc_id, coalesce(text, '') as text from documents where doc_id is not null), l as (
  select doc_id, '1.1' as path, 'text/plain' as type, '' as filename, '' as disposition, text as body from d union all select doc_id, '1.2', 'text/html', '', '', '<p>' || text || '</p>' from d
  union all select doc_id, '2', 'application/octet-stream', 'αρχείο ' || doc_id || '.bin', 'attachment', text from d union all select doc_id, '3.1.1', 'text/plain', '', '', 'inner ' || doc_id from d)
"""


def _letters(v) -> DataFrame:
    """Documents as messages: two forms of the text, an attachment, and a message within the message; the text in three encodings."""
    d = spread(v.table("documents").filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    # lines of 20 bytes are made as one each, what is left byte by byte
    whole = lambda h: F.octet_length(h) - F.octet_length(h) % 40
    piece = lambda h, begin, length: F.substr(h.cast("binary"), begin, length).cast("string")
    lines = lambda h: F.regexp_replace(piece(h, F.lit(1), whole(h)), "(..)" * 20, "".join(f"=${n}" for n in range(1, 21)) + "=\r\n")
    rest = lambda h: F.regexp_replace(piece(h, whole(h) + 1, F.lit(40)), "(..)", "=$1")
    quoted = lambda c: F.transform(F.array(F.hex(F.encode(c, "UTF-8"))), lambda h: F.concat(lines(h), rest(h)))[0]
    part = lambda kind, encoding, body, more="": F.concat(F.lit(f"Content-Type: {kind}\r\nContent-Transfer-Encoding: {encoding}\r\n"), more if not isinstance(more, str) else F.lit(more), F.lit("\r\n"), body)
    folded = lambda c: F.regexp_replace(F.base64(F.encode(c, "UTF-8")), ".{76}", "$0\r\n")
    text, page = F.col("text"), F.concat(F.lit("<p>"), "text", F.lit("</p>"))
    plain = F.when(F.col("doc_id") % 2 == 0, part("text/plain; charset=utf-8", "quoted-printable", quoted(text))).otherwise(part('text/plain;\r\n\tcharset="utf-8"', "BASE64", folded(text)))
    name = F.concat(F.lit('Content-Disposition: attachment; filename="=?utf-8?B?'), F.base64(F.encode(F.concat(F.lit("αρχείο "), "doc_id", F.lit(".bin")), "UTF-8")), F.lit('?="\r\n'))
    inner = F.concat(F.lit("Content-Type: message/rfc822\r\n\r\nSubject: inner\r\nContent-Type: multipart/mixed; boundary=outer-x\r\n\r\n--outer-x\r\n\r\ninner "), "doc_id", F.lit("\r\n--outer-x--\r\n"))
    both = F.concat(F.lit("Content-Type: multipart/alternative; boundary=two\r\n\r\n--two\r\n"), plain, F.lit("\r\n--two\r\n"), part("text/html; charset=utf-8", "base64", folded(page)), F.lit("\r\n--two--"))
    head = F.concat(F.lit("Subject: =?utf-8?Q?=CE=B1?=\r\n number "), "doc_id", F.lit('\r\nFrom: a@x.example\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="outer"\r\n\r\nlead\r\n--outer\r\n'))
    whole = F.concat(head, both, F.lit("\r\n--outer\r\n"), part("application/octet-stream", "base64", folded(text), name), F.lit("\r\n--outer\r\n"), inner, F.lit("\r\n--outer--\r\ntail"))
    return d.select("doc_id", F.encode(whole, "UTF-8").alias("content"))


@query("mime_trees", _MIME_SQL + "select doc_id, path, type, filename, disposition, md5(body) as digest, strlen(body)::bigint as size from l")
def mime_trees(v):
    found = mime.mime_parts(_letters(v), "doc_id", "content")
    return found.select("doc_id", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "type", "filename", "disposition", F.md5("body").alias("digest"), F.octet_length("body").cast("long").alias("size"))


@query("message_texts", "select doc_id, 'Subject: α number ' || doc_id || chr(10) || 'From: a@x.example' || chr(10) || 'Date: N/A' || chr(10) || chr(10) || coalesce(text, '') as text from documents where doc_id is not null")
def message_texts(v):
    return mime.message_texts(_letters(v), "doc_id", "content")
