"""Rules and selections over files, images, links, chats and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.fixed import IMAGE_MIN_BYTES, IMAGE_MIN_SIDE, LINK_ATTEMPTS, LINK_COOL_DAYS, MIME_BY_SUFFIX, SIGNATURE_SHARE
from mnemora.functions.text import normalize_subject
from mnemora.operators.windows import first_of


def signature_shares(occurrences: DataFrame, sender: str = "sender_email", image: str = "sha256", message: str = "message_id") -> DataFrame:
    """occurrence_count, sender_total, frequency of each image in a sender's messages with images."""
    pairs = occurrences.groupBy(sender, image).agg(F.count(F.lit(1)).alias("occurrence_count"))
    totals = occurrences.groupBy(sender).agg(F.count_distinct(message).alias("sender_total"))
    return pairs.join(totals, sender).withColumn("frequency", F.col("occurrence_count") / F.col("sender_total"))


def classify_images(images: DataFrame, shares: DataFrame, threshold: float = SIGNATURE_SHARE) -> DataFrame:
    """images (sha256, sender_email, width, height, bytes, classification, user_overridden) with class and method.

    A class that a user set, or any but unclassified, stays. Then, in this order: no size known, small sides,
    few bytes, frequent in the sender's mails; what passes stays unclassified.
    """
    rows = images.join(shares.select("sender_email", "sha256", "frequency"), ["sender_email", "sha256"], "left")
    settled = F.coalesce("user_overridden", F.lit(False)) | (F.coalesce("classification", F.lit("unclassified")) != "unclassified")
    small = (F.col("width") < IMAGE_MIN_SIDE) | (F.col("height") < IMAGE_MIN_SIDE)
    rules = [
        (F.col("width").isNull() | F.col("height").isNull(), "noise", "decode_failed"),
        (small, "noise", "dimensions"),
        (F.col("bytes") < IMAGE_MIN_BYTES, "noise", "byte_size"),
        (F.coalesce("frequency", F.lit(0.0)) >= threshold, "signature", "frequency"),
    ]
    kind, method = F.when(settled, F.col("classification")), F.when(settled, F.lit("kept"))
    for condition, k, m in rules:
        kind, method = kind.when(condition, k), method.when(condition, m)
    return rows.withColumns({"classification": kind.otherwise("unclassified"), "method": method.otherwise("stage1_passed")})


def position_in_body(body: Column, names: list[Column]) -> Column:
    """Where the first of the names that is found stands in the body, from 0 to 1; 0.5 if none is."""
    found = [F.nullif(F.position(F.lower(n), F.lower(body)), F.lit(0)) for n in names]
    return F.when(F.length(body) > 0, F.coalesce(*[(f - 1) / F.length(body) for f in found], F.lit(0.5))).otherwise(F.lit(0.5))


def vision_label(answer: Column) -> Column:
    """struct(classification, description) of a labelled answer; without a label it is a signature."""
    content, decoration = F.upper(answer).startswith("CONTENT:"), F.upper(answer).startswith("DECORATION:")
    text = F.trim(F.regexp_replace(answer, "(?i)^(content|decoration):", ""))
    return F.struct(F.when(content, "content").when(decoration, "noise").otherwise("signature").alias("classification"), F.when(content, text).alias("description"))


def image_backlog(mails: DataFrame, processed: DataFrame, since: Column | None = None, limit: int | None = None) -> DataFrame:
    rows = mails if since is None else mails.filter(F.col("date_received") >= since)
    rows = rows.join(processed.select("message_id").distinct(), "message_id", "left_anti").orderBy(F.desc("date_received"), "message_id")
    return rows.limit(limit) if limit else rows


def links_to_retry(links: DataFrame, now: Column, most: int = LINK_ATTEMPTS, days: int = LINK_COOL_DAYS) -> DataFrame:
    """Links without a fetch, or stale ones, that are under the cap or have rested; never those gone before any fetch."""
    status = F.coalesce("last_status", F.lit(""))
    rested = F.coalesce(F.col("last_attempt_at") < now - F.make_interval(days=F.lit(days)), F.lit(True))
    gone = F.col("fetched_at").isNull() & (status == "stale")
    due = (F.col("attempts") < most) | (rested & ~gone)
    return links.filter((F.col("fetched_at").isNull() | (status == "stale")) & (status != "unsupported-host") & due)


def skip_attachment(name: Column, mime: Column, size: Column) -> Column:
    """Empty files, calendars, small images and numbered inline images."""
    return (size == 0) | mime.startswith("text/calendar") | (mime.startswith("image/") & (size < 50 * 1024)) | F.lower(name).rlike(r"^image\d+\.\w+$")


def mime_of(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MIME_BY_SUFFIX.items() for x in kv))
    return F.coalesce(table[F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))], F.lit("application/octet-stream"))


def mime_family(mime: Column, family: str) -> Column:
    wanted = {
        "pdf": mime == "application/pdf",
        "word": mime.isin(MIME_BY_SUFFIX["doc"], MIME_BY_SUFFIX["docx"]),
        "excel": mime.isin(MIME_BY_SUFFIX["xls"], MIME_BY_SUFFIX["xlsx"]),
        "powerpoint": mime.isin(MIME_BY_SUFFIX["ppt"], MIME_BY_SUFFIX["pptx"]),
        "image": mime.startswith("image/"),
        "text": mime.startswith("text/"),
    }
    if family not in wanted:
        raise ValueError(f"no such family: {family}")
    return wanted[family]


def chat_kind(thread_type: Column, one_on_one: Column, members: Column) -> Column:
    """meeting by type, else the flag, else by human members (ids 8:…): three or more are a group."""
    humans = F.size(F.filter(members, lambda m: m["mri"].startswith("8:")))
    return F.when(thread_type == "meeting", "meeting").when(one_on_one, "oneOnOne").when(humans >= 3, "group").when(humans == 2, "oneOnOne").otherwise("group")


def is_system(message_type: Column) -> Column:
    return F.coalesce(message_type.startswith("ThreadActivity/"), F.lit(False))


def systemic_failure(results: DataFrame, permanent: Column) -> DataFrame:
    """attempted, permanent, systemic: more than 3 and more than a quarter of all failed for good."""
    out = results.agg(F.count(F.lit(1)).alias("attempted"), F.count_if(permanent).alias("permanent"))
    return out.withColumn("systemic", F.col("permanent") > F.greatest(F.lit(3.0), 0.25 * F.col("attempted")))


def to_resolve(ids: DataFrame, known: DataFrame, most: int = 50) -> DataFrame:
    """Ids that were never tried or failed, never tried ones first, then the longest ago; other than users never."""
    rows = ids.select("mri").distinct().filter(F.col("mri").startswith("8:")).join(known, "mri", "left")
    return rows.filter("status is null or status in ('pending', 'failed')").orderBy(F.asc_nulls_first("last_attempt_at"), "mri").limit(most)


def pull_order(chats: DataFrame) -> DataFrame:
    """Chats that aren't disabled, never pulled ones first, then the longest ago."""
    return chats.filter("not coalesce(ingest_disabled, false)").orderBy(F.asc_nulls_first("last_pulled_at"), "id")


def thread_title(kind: Column, chat_kind_: Column, topic: Column, started: Column, first_text: Column) -> Column:
    day = F.date_format(started, "yyyy-MM-dd")
    session = F.when(chat_kind_ == "oneOnOne", F.concat(F.lit("DM session "), day)).otherwise(F.concat(F.lit("Group ["), F.coalesce(topic, F.lit("")), F.lit("]: session "), day))
    text = F.coalesce(first_text, F.lit(""))
    return F.when(kind == "chat_session", session).otherwise(F.concat(F.substring(text, 1, 50), F.when(F.length(text) > 50, "...").otherwise("")))


def article_date(published: Column, fetched: Column) -> Column:
    """When an article is dated: published, or fetched if that is missing or later."""
    return F.when(published.isNull() | (published > fetched), fetched).otherwise(published)


def article_records(articles: DataFrame, categories: DataFrame, tickers: DataFrame, by: str | None = None) -> DataFrame:
    """message_id, sender_address, conversation_id, date_received, content of dated articles with a body.

    categories and tickers are by article_url; by: a column of articles by which tickers are instead, where several have one address.
    """
    gather = lambda df, value, name, key=F.col("article_url").alias("url"): df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), ", ").alias(name))
    rows = articles.withColumn("date_received", article_date(F.col("published_at"), F.col("fetched_at"))).filter("date_received is not null and trim(coalesce(content, '')) <> ''")
    rows = rows.join(gather(categories, "category", "categories"), "url", "left").join(gather(tickers, "ticker", "tickers", by) if by else gather(tickers, "ticker", "tickers"), by or "url", "left")
    line = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(label), F.col(c)))
    source = F.regexp_replace(F.regexp_replace(F.lower("source"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return rows.select(
        F.concat(F.lit("news:"), F.sha1("url")).alias("message_id"), F.concat(source, F.lit("@news")).alias("sender_address"),
        F.concat(F.lit("news-"), F.date_format("date_received", "yyyy-MM-dd")).alias("conversation_id"), "date_received",
        F.concat_ws("\n", "content", line("Categories: ", "categories"), line("Tickers: ", "tickers"), F.concat(F.lit("URL: "), F.col("url"))).alias("content"),
    )


def changed_events(fetched: DataFrame, known: DataFrame) -> DataFrame:
    """Events that are new, were changed, or wait for extraction."""
    old = known.select("outlook_event_id", F.col("modified_at").alias("__was"), F.col("llm_status").alias("__status"))
    return fetched.join(old, "outlook_event_id", "left").filter(~F.col("modified_at").eqNullSafe(F.col("__was")) | F.col("__status").isNull() | (F.col("__status") == "pending")).drop("__was", "__status")


def self_organized(email: Column, user: str, proxies: list[str]) -> Column:
    """The organizer is the user (pattern in the address; an empty one is nobody) or one who acts for them."""
    mail = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    mine = mail.contains(user.lower()) if user else F.lit(False)
    return mine | mail.isin(*[p.lower() for p in proxies]) if proxies else mine


def curation_candidates(attachments: DataFrame, processed: DataFrame, noise: list[str], mimes: list[str], limit: int, least_size: int = 10_000, least_text: int = 200) -> DataFrame:
    """Attachments worth filing: not yet filed, of the types, large enough, subject not noise, one of each base name."""
    rows = attachments.join(processed.select("id"), "id", "left_anti").filter(F.col("mime_type").isin(*mimes) & (F.col("file_size") >= least_size) & (F.length("extracted_text") >= least_text))
    rows = rows.filter(~F.coalesce(F.col("subject"), F.lit("")).rlike("(?iu)" + "|".join(noise)))
    base = F.lower(F.regexp_replace(F.regexp_replace("filename", r"\.[^.]+$", ""), r"(?iu)[\s_-]*(\(\d+\)|v\d+|copy|final)*$", ""))
    return first_of(rows.withColumn("base", base), ["base"], F.desc("id")).orderBy(F.desc("id")).limit(limit)


def recoverable(extracted: DataFrame, staged: DataFrame, loaded: DataFrame) -> DataFrame:
    """Extractions whose message is staged and loaded under neither of its two ids."""
    rows = extracted.join(staged.select("message_id", "internet_message_id").dropDuplicates(["message_id"]), "message_id")
    rows = rows.join(loaded.select("message_id"), "message_id", "left_anti")
    return rows.join(loaded.select("internet_message_id").filter("internet_message_id is not null"), "internet_message_id", "left_anti")


def subject_threads(mails: DataFrame) -> DataFrame:
    """Mails per normalized subject."""
    return mails.groupBy(normalize_subject(F.col("subject")).alias("subject_key")).agg(F.count(F.lit(1)).alias("mails"))
