"""Readers of what the store is fed with; each gives rows of one schema, and nothing where nothing is."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.extraction import parsed
from mnemora.functions.fixed import COMMAND_SHOWN, CONTENT_RECORDS, SKIPPED_RECORDS, TOOL_BY_COMMAND, TOOLS_BY_FILE, TOOLS_BY_TARGET, TURN_SHOWN
from mnemora.operators.windows import first_of, in_order, runs
from mnemora.operators.snapshots import SnapshotTable, exists

ADDRESS = "struct<name:string,address:string>"
MAIL = (
    f"message_id string, date_received string, subject string, sender {ADDRESS}, to_recipients array<{ADDRESS}>, cc_recipients array<{ADDRESS}>, "
    "mailbox_name string, content string, conversation_id string, internet_message_id string, in_reply_to string, `references` string"
)


def table(spark: SparkSession, path: str, schema: str | None = None, key: list[str] | None = None, order: str | None = None) -> DataFrame:
    """The newest version of a table with versions, or a plain Parquet table; with a schema, an absent one is empty.

    key and order are those that the table is written with; they are needed where it has versions.
    """
    if exists(spark, path) or (schema is not None and not _there(spark, path)):
        return SnapshotTable(spark, path, key or [], order, schema).read()
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def file_name() -> Column:
    """The name of the file that a row is from, as it is: _metadata has # and the like as %XX."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def timestamp(text: Column) -> Column:
    """ISO texts with or without zone or fractions, in UTC; null if unreadable."""
    return F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{6})\d+", "$1"))


def staging_batches(spark: SparkSession, path: str) -> DataFrame:
    """Mails of batch-*.json files, objects with emails or bare lists; of a repeated message the later file's."""
    text = spark.read.text(path, wholetext=True).withColumn("file", file_name())
    item = "struct<" + ", ".join(f.replace(" ", ":", 1) for f in _fields(MAIL)) + ">"
    bare = F.from_json("value", f"array<{item}>")
    inside = F.from_json("value", f"struct<emails:array<{item}>>")["emails"]
    mails = text.select("file", F.explode(F.when(F.ltrim("value").startswith("["), bare).otherwise(inside)).alias("m")).select("file", "m.*")
    return first_of(mails.filter("message_id is not null"), ["message_id"], F.desc("file")).withColumn("received_at", timestamp(F.col("date_received")))


def _fields(ddl: str) -> list[str]:
    """A DDL list split at its top commas."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def extractions(spark: SparkSession, path: str) -> DataFrame:
    """message_key (the file's stem, lower case) and the answer in it, as far as it can be read."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("file", file_name())
    return text.select(F.lower(F.regexp_replace("file", r"\.json$", "")).alias("message_key"), parsed(F.col("value")).alias("answer")).filter("answer is not null")


def lines(spark: SparkSession, path: str, suffix: str = "*.jsonl") -> DataFrame:
    """file, position, value of the lines of text files under path; position orders the lines of a file as they stand.

    A task emits the lines of its byte ranges in order, so the start of the range and a number that grows within a
    task tell where a line stands, however a file is split.
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", suffix).text(path)
    position = F.struct(F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("line"))
    return text.select(F.col("_metadata.file_path").alias("file"), position.alias("position"), "value")


def stripped(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, "(?U)^[\\s\u001c-\u001f]+|[\\s\u001c-\u001f]+$", "")


def _shown(block: Column) -> Column:
    """How a block of a message's content appears in a turn; null if it doesn't."""
    of = lambda path: F.try_variant_get(block, path, "string")
    first = lambda *names: F.coalesce(*[F.nullif(of(f"$.input.{n}"), F.lit("")) for n in names], F.lit(""))
    kind, name = of("$.type"), F.coalesce(of("$.name"), F.lit("unknown"))
    target = F.when(name.isin(*TOOLS_BY_TARGET), first("file_path", "pattern", "path")).when(name.isin(*TOOLS_BY_FILE), first("file_path")).when(name == TOOL_BY_COMMAND, F.substring(first("command"), 1, COMMAND_SHOWN))
    tool = F.concat(F.lit("[Tool: "), name, F.coalesce(F.concat(F.lit(" "), target), F.lit("")), F.lit("]"))
    return F.when(kind == "text", F.nullif(stripped(of("$.text")), F.lit(""))).when(kind == "tool_use", tool)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """The lines of session files that are records to look at: what they say, and what they tell of the session."""
    rows = lines(spark, path).select("file", "position", F.try_parse_json("value").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    of = lambda path, kind="string": F.try_variant_get("v", path, kind)
    content, blocks = of("$.message.content", "variant"), of("$.message.content", "array<variant>")
    # what it is decides how it is read, not what it begins with
    text = F.when(F.schema_of_variant(content).startswith("ARRAY"), F.array_join(F.filter(F.transform(blocks, _shown), lambda x: x.isNotNull()), "\n")).otherwise(stripped(of("$.message.content")))
    kind = F.coalesce(of("$.type"), F.lit(""))
    speaker = F.when(F.coalesce(of("$.message.role"), kind) == "user", "user").otherwise("assistant")
    return rows.filter(~kind.isin(*SKIPPED_RECORDS)).select(
        "file", "position", kind.alias("type"), F.nullif(of("$.sessionId"), F.lit("")).alias("session_id"), F.nullif(of("$.cwd"), F.lit("")).alias("workspace"), F.nullif(of("$.timestamp"), F.lit("")).alias("time"),
        F.when(kind.isin(*CONTENT_RECORDS), speaker).alias("speaker"), F.when(kind.isin(*CONTENT_RECORDS), F.nullif(text, F.lit(""))).alias("text"),
    )


def _sessions(records: DataFrame) -> DataFrame:
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("position")))
    stem = F.regexp_extract(F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B"))), r"([^/]*?)(?:\.[^./]*)?$", 1)
    found = records.groupBy("file").agg(first("session_id").alias("own"), first("workspace").alias("workspace"), first("time").alias("started_at"), F.max_by("time", F.when(F.col("time").isNotNull(), F.col("position"))).alias("ended_at"))
    return found.select("file", F.coalesce("own", stem).alias("session_id"), F.coalesce("workspace", F.lit("")).alias("workspace"), "started_at", "ended_at")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Turns of session files (*.jsonl): file, session_id, turn_index, speaker, at, parts, content, has_code, has_tool_use.

    Records come in the order of the file, whatever their times; lines that can't be read are left out, runs of a
    speaker put together. A turn's time is that of its last record with one.
    """
    return _turns(_records(spark, path))


def _turns(records: DataFrame) -> DataFrame:
    said = runs(records.filter("text is not null"), "file", "position", "speaker")
    at = F.max_by("time", F.when(F.col("time").isNotNull(), F.col("position")))
    turns = said.groupBy("file", "__run").agg(F.min("speaker").alias("speaker"), at.alias("at"), F.count(F.lit(1)).alias("parts"), in_order("position", "text").alias("content"))
    content = F.when(F.char_length("content") > TURN_SHOWN, F.concat(F.substring("content", 1, TURN_SHOWN), F.lit("\n[...truncated]"))).otherwise(F.col("content"))
    out = turns.withColumn("content", content).join(_sessions(records).select("file", "session_id"), "file")
    return out.select("file", "session_id", (F.col("__run") - 1).alias("turn_index"), "speaker", timestamp(F.col("at")).alias("at"), "parts", "content", F.col("content").contains("```").alias("has_code"), F.col("content").contains("[Tool:").alias("has_tool_use"))


def transcript_sessions(spark: SparkSession, path: str, least_user_turns: int = 2) -> DataFrame:
    """file, session_id, workspace, project, started_at, ended_at, turn_count of sessions with so many turns of the user."""
    records = _records(spark, path)
    said = runs(records.filter("text is not null"), "file", "position", "speaker").groupBy("file", "__run").agg(F.min("speaker").alias("speaker"))
    counts = said.groupBy("file").agg(F.count(F.lit(1)).alias("turn_count"), F.count_if(F.col("speaker") == "user").alias("asked")).filter(F.col("asked") >= least_user_turns)
    project = F.regexp_extract(F.regexp_replace("workspace", "/+$", ""), r"([^/]*)$", 1)
    found = _sessions(records).join(counts, "file")
    return found.select("file", "session_id", "workspace", project.alias("project"), timestamp(F.col("started_at")).alias("started_at"), timestamp(F.col("ended_at")).alias("ended_at"), "turn_count")


def session_files(spark: SparkSession, root: str, now: str, days: int | None = None, workspace: str | None = None) -> DataFrame:
    """path, workspace, modified, length of session files (root/workspace/*.jsonl), newest first.

    days: only those modified in so many days before now; workspace: only folders with this in their name, case
    aside. A folder's name is a path with - for /. Only names and times are read.
    """
    found = files(spark, [root], [".jsonl"])
    name = F.regexp_extract("folder", r"([^/]*)$", 1)
    found = found.filter(F.size(F.split(F.regexp_replace("path", "^[a-z]+:/*", "/"), "/")) == len(f"/{root.split(':', 1)[-1].strip('/')}".split("/")) + 2)
    found = found.select("path", F.regexp_replace(name, "-", "/").alias("workspace"), "modified", "length")
    if days is not None:
        found = found.filter(F.col("modified") >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days)))
    if workspace:
        found = found.filter(F.lower("workspace").contains(workspace.lower()))
    return found.orderBy(F.desc("modified"), "path")


def files(spark: SparkSession, roots: list[str], suffixes: list[str], modified_after: str | None = None, content: bool = False) -> DataFrame:
    """path, folder, name, modified, length of files with the suffixes (case aside) under roots that exist."""
    out = None
    for root in roots:
        try:
            reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
            rows = (reader.option("modifiedAfter", modified_after) if modified_after else reader).load(root)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    out = out.filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*[s.lower() for s in suffixes]))
    return out.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), name.alias("name"), F.col("modificationTime").alias("modified"), "length", *(["content"] if content else []))


def extracted(found: DataFrame, extractors: dict[str, Callable[[Column], Column]], most_bytes: int | None = None) -> DataFrame:
    """path, name, text, status of file rows with content, by the extractor of their suffix.

    An extractor is a function of the content's column: built-ins, or the caller's own Arrow UDF around a parser.
    status: extracted, empty (no text came out), too_large (over most_bytes) or unsupported (no extractor).
    """
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    large = F.lit(False) if most_bytes is None else F.col("length") > most_bytes
    text = F.when(large, F.lit(None).cast("string"))
    for name, extractor in extractors.items():
        text = text.when(suffix == name.lower(), extractor(F.col("content")))
    out = found.withColumn("text", F.nullif(F.trim(text.otherwise(F.lit(None))), F.lit("")))
    status = F.when(large, "too_large").when(~suffix.isin(*[n.lower() for n in extractors]), "unsupported").when(F.col("text").isNull(), "empty").otherwise("extracted")
    return out.select("path", "name", "text", status.alias("status"))


def standalone_documents(found: DataFrame) -> DataFrame:
    """message_id, filename, text of file rows with content; one row for equal contents."""
    from mnemora.functions.text import document_id

    rows = found.select(document_id(F.col("content")).alias("message_id"), F.col("name").alias("filename"), F.decode("content", "UTF-8").alias("text"))
    return first_of(rows, ["message_id"], F.col("filename"))


def frontmatter(text: Column) -> Column:
    """struct(meta map, body) of a text that may begin with a block of key: value lines between --- lines."""
    block = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)", 1)
    has = text.rlike(r"(?s)\A---\s*\n.*?\n---\s*(?:\n|\z)")
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[^:#\s][^:]*:"))
    pair = lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, "^[^:]*:", "")), r"^[\"']|[\"']$", "").alias("v"))
    entries = F.transform(lines, pair)
    # of a repeated key the last counts
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]))
    body = F.regexp_replace(text, r"(?s)\A---\s*\n.*?\n---\s*(?:\n|\z)", "")
    return F.struct(F.when(has, F.map_from_entries(last)).otherwise(F.map_from_entries(F.filter(entries, lambda e: F.lit(False)))).alias("meta"), F.when(has, body).otherwise(text).alias("body"))


MOST_PROXIES = 10_000


def proxies(spark: SparkSession, path: str) -> list[str]:
    """The sorted addresses of proxy_addresses; more than MOST_PROXIES, which no list of helpers has, is an error."""
    found = [r[0] for r in proxy_addresses(spark, path).limit(MOST_PROXIES + 1).collect()]
    if len(found) > MOST_PROXIES:
        raise ValueError(f"{path}: more than {MOST_PROXIES} proxies; use proxy_addresses")
    return sorted(found)


def proxy_addresses(spark: SparkSession, path: str) -> DataFrame:
    """email of those who act for the user, from a list of people; none if the file isn't there."""
    try:
        rows = spark.read.schema("email string, is_proxy_for_self boolean, _corrupt_record string").json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "email string")
    return rows.filter("is_proxy_for_self and email is not null").select(F.lower(F.trim("email")).alias("email")).distinct()


def database(spark: SparkSession, url: str, table_name: str, predicates: list[str] | None = None, properties: dict | None = None) -> DataFrame:
    """A foreign table by JDBC, read in parallel by predicates; filters are pushed down."""
    return spark.read.jdbc(url, table_name, predicates=predicates, properties=properties or {}) if predicates else spark.read.jdbc(url, table_name, properties=properties or {})


def provider_mail(raw: DataFrame) -> DataFrame:
    """Provider messages (both spellings of fields) as staging rows."""
    either = lambda *names: F.coalesce(*[F.col(n) for n in names if _has(raw, n)]) if any(_has(raw, n) for n in names) else F.lit(None).cast("string")
    return raw.select(
        either("id", "Id").alias("message_id"), either("receivedDateTime", "ReceivedDateTime").alias("date_received"), either("subject", "Subject").alias("subject"),
        either("conversationId", "ConversationId").alias("conversation_id"), either("internetMessageId", "InternetMessageId").alias("internet_message_id"),
    )


_PERSON = "struct<EmailAddress:struct<Name:string,Address:string>>"
_MAIL_PAYLOAD = (
    f"Id string, ReceivedDateTime string, Subject string, From {_PERSON}, ToRecipients array<{_PERSON}>, CcRecipients array<{_PERSON}>, Body struct<Content:string>, "
    "ConversationId string, InternetMessageId string, WebLink string, HasAttachments boolean"
)
_TIME = "struct<DateTime:string,TimeZone:string>"
_ANSWER = "struct<Response:string>"
_EVENT_PAYLOAD = (
    f"Id string, Subject string, Organizer {_PERSON}, Attendees array<struct<EmailAddress:struct<Name:string,Address:string>,Status:{_ANSWER}>>, Start {_TIME}, End {_TIME}, Location struct<DisplayName:string>, "
    f"IsRecurring boolean, SeriesMasterId string, ResponseStatus {_ANSWER}, IsCancelled boolean, CreatedDateTime string, LastModifiedDateTime string"
)


def _payload(value: Column, schema: str) -> Column:
    """A payload's struct, whether its fields begin with capitals or not."""
    small = re.sub(r"\b([A-Z])(?=\w*[ :])", lambda m: m[1].lower(), schema)
    other = F.from_json(value, small).cast("struct<" + ", ".join(f.replace(" ", ":", 1) for f in _fields(schema)) + ">")
    # in a lambda a text is parsed once, however often its struct is used
    return F.transform(F.array(F.from_json(value, schema)), lambda large: F.when(large["Id"].isNotNull(), large).otherwise(other))[0]


def _payloads(raw: DataFrame, value: str, schema: str) -> DataFrame:
    """The fields of payloads with an id; a generator's column, as a filter on another would parse the texts again."""
    return raw.select(F.explode(F.array(_payload(F.col(value), schema))).alias("p")).filter("p.Id is not null").select("p.*")


def mail_payloads(raw: DataFrame, mailbox: str, value: str = "value") -> DataFrame:
    """A provider's messages (JSON texts) as staging rows: those of MAIL, web_link and has_attachments.

    A payload without an id, or that can't be read, is left out. What is missing is '' in texts, and no recipient.
    """
    none = lambda c: F.coalesce(c, F.lit(""))
    who = lambda p: F.struct(none(p["EmailAddress"]["Name"]).alias("name"), none(p["EmailAddress"]["Address"]).alias("address"))
    some = lambda c: F.transform(F.coalesce(c, F.array().cast(f"array<{_PERSON}>")), who)
    p = _payloads(raw, value, _MAIL_PAYLOAD)
    null = F.lit(None).cast("string")
    return p.select(
        F.col("Id").alias("message_id"), none(F.col("ReceivedDateTime")).alias("date_received"), none(F.col("Subject")).alias("subject"), who(F.col("From")).alias("sender"),
        some(F.col("ToRecipients")).alias("to_recipients"), some(F.col("CcRecipients")).alias("cc_recipients"), F.lit(mailbox).alias("mailbox_name"), none(F.col("Body.Content")).alias("content"),
        F.col("ConversationId").alias("conversation_id"), F.col("InternetMessageId").alias("internet_message_id"), null.alias("in_reply_to"), null.alias("references"),
        F.col("WebLink").alias("web_link"), F.coalesce("HasAttachments", F.lit(False)).alias("has_attachments"),
    )


def event_payloads(raw: DataFrame, value: str = "value") -> DataFrame:
    """A provider's calendar events (JSON texts) as rows, with their attendees; times are texts as they came, and read."""
    none = lambda c, other="": F.coalesce(c, F.lit(other))
    p = _payloads(raw, value, _EVENT_PAYLOAD)
    guest = lambda a: F.struct(none(a["EmailAddress"]["Address"]).alias("email"), none(a["EmailAddress"]["Name"]).alias("name"), none(a["Status"]["Response"], "None").alias("response_status"))
    guests = F.when(F.col("Attendees").isNull(), F.array().cast("array<struct<email:string,name:string,response_status:string>>")).otherwise(F.transform("Attendees", guest))
    return p.select(
        F.col("Id").alias("event_id"), none(F.col("Subject")).alias("subject"), none(F.col("Organizer.EmailAddress.Address")).alias("organizer_email"), none(F.col("Organizer.EmailAddress.Name")).alias("organizer_name"),
        timestamp(F.col("Start.DateTime")).alias("start_at"), timestamp(F.col("End.DateTime")).alias("end_at"), none(F.col("Location.DisplayName")).alias("location"), F.coalesce("IsRecurring", F.lit(False)).alias("is_recurring"),
        F.col("SeriesMasterId").alias("recurrence_master_id"), none(F.col("ResponseStatus.Response"), "None").alias("response_status"), F.coalesce("IsCancelled", F.lit(False)).alias("is_cancelled"),
        timestamp(F.col("CreatedDateTime")).alias("created_at"), timestamp(F.col("LastModifiedDateTime")).alias("modified_at"), guests.alias("attendees"),
    )


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def chat_messages(raw: DataFrame, chat: str) -> DataFrame:
    """Chat messages (flat) and channel posts (wrapped in message) as rows; ids are chat::id."""
    from mnemora.functions.text import contact_id, message_text
    from mnemora.operators.selection import is_system

    m = F.col("message") if "message" in raw.columns else None
    one = lambda wrapped, flat: F.coalesce(*([m[wrapped]] if m is not None else []), *([F.col(flat)] if flat in raw.columns else []))
    return raw.select(
        F.concat(F.lit(f"{chat}::"), F.col("id")).alias("message_id"), contact_id(one("from", "from")).alias("sender_mri"), one("imDisplayName", "imdisplayname").alias("sender_name"),
        timestamp(one("composetime", "composetime")).alias("composed_at"), message_text(one("content", "content")).alias("content_text"), is_system(one("messageType", "messagetype")).alias("is_system"),
    )
