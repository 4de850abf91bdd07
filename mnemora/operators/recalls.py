"""Searches and dossiers over sessions, chats, events, images and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.operators import search
from mnemora.operators.dossier import section, union
from mnemora.operators.index import TextIndex
from mnemora.session import stored

TAGS = ("[PREFERENCE]", "[TECHNICAL]")


def _hits(source: DataFrame | TextIndex, key: str, columns: list[str], words: str, limit: int, phrase: bool = False) -> DataFrame:
    """key, score of the best rows, by an index of the columns if there is one; stored, as they are read several times."""
    found = source.bm25(words, limit, phrase, columns) if isinstance(source, TextIndex) else search.bm25(source, key, columns, words, limit, phrase)
    return stored(found.toDF(key, "score"), "hits")


def preferences(facts: DataFrame, topic: str | None, limit: int = 20, index: TextIndex | None = None) -> DataFrame:
    """fact_id, fact, at: tagged facts on a topic, or all of them if none is on it; newest first.

    facts: fact_id, fact, at. The newest limit tagged facts are looked through for the topic, and all tagged
    ones are searched by rank, in an index of them by fact if there is one; both count.
    """
    tagged = facts.filter(F.col("fact").startswith(TAGS[0]) | F.col("fact").startswith(TAGS[1])).select("fact_id", "fact", "at")
    newest = tagged.orderBy(F.desc("at"), "fact_id").limit(limit)
    if not topic:
        return newest
    named = newest.filter(F.lower("fact").contains(topic.lower())).select("fact_id")
    ranked = _hits(tagged if index is None else index, "fact_id", ["fact"], topic, limit).select("fact_id")
    ids = named.unionByName(ranked).distinct()
    n = ids.agg(F.count(F.lit(1)).alias("n"))
    chosen = tagged.join(ids, "fact_id", "left_semi")
    fallback = newest.join(F.broadcast(n)).filter("n = 0").drop("n")
    return chosen.unionByName(fallback).orderBy(F.desc("at"), "fact_id").limit(limit)


def image_search(images: DataFrame, occurrences: DataFrame, words: str, limit: int = 10) -> DataFrame:
    """Content images whose description has the words, newest first, each with its occurrences by position."""
    found = images.filter((F.col("classification") == "content") & F.lower("vision_description").contains(words.lower())).orderBy(F.desc("classified_at"), "sha256").limit(limit)
    where = occurrences.join(F.broadcast(found.select("sha256")), "sha256", "left_semi").groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("position_in_body", "message_id", "sender_email"))).alias("occurrences"))
    return found.join(where, "sha256", "left").select("sha256", "vision_description", "classified_at", "occurrences")


def calendar_events(events: DataFrame, attendees: DataFrame, person: str | None = None, since: Column | None = None, until: Column | None = None, hits: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """Events by start, each once with its attendees; person is part of an attendee's name or address."""
    rows = events if since is None else events.filter(F.col("start_at") >= since)
    rows = rows if until is None else rows.filter(F.col("start_at") <= until)
    if person:
        p = person.lower()
        rows = rows.join(attendees.filter(F.lower("name").contains(p) | F.lower("email").contains(p)).select("event_id"), "event_id", "left_semi")
    if hits is not None:
        rows = rows.join(hits.select("event_id"), "event_id", "left_semi")
    top = rows.orderBy("start_at", "event_id").limit(limit)
    who = attendees.join(F.broadcast(top.select("event_id")), "event_id", "left_semi").groupBy("event_id").agg(F.array_sort(F.collect_list(F.coalesce("name", "email"))).alias("attendees"))
    return top.join(who, "event_id", "left").withColumn("organizer", F.coalesce("organizer_name", "organizer_email"))


def recent_sessions(sessions: DataFrame, as_of: Column, days: int = 7, workspace: str | None = None, limit: int = 20) -> DataFrame:
    rows = sessions.filter(F.col("started_at") >= as_of - F.make_interval(days=F.lit(days)))
    rows = rows.filter(F.lower("workspace").contains(workspace.lower())) if workspace else rows
    return rows.orderBy(F.desc("started_at"), "session_id").limit(limit)


def session_search(sessions: DataFrame | TextIndex, turns: DataFrame | TextIndex, words: str, limit: int = 20, of: DataFrame | None = None, columns: tuple[list[str], list[str]] = (["summary", "topics_summary"], ["summary", "content"])) -> DataFrame:
    """session_id, source, place: sessions found by summary, then by turns for twice the places left.

    Tables, or indexes by session_id and turn_id; of: turn_id, session_id, if turns is an index.
    """
    whole = search.ranked(_hits(sessions, "session_id", columns[0], words, limit), "session_id").select("session_id", "rank")
    best = _hits(turns, "turn_id", columns[1], words, 2 * limit)
    of = (turns if of is None else of).select("turn_id", "session_id")
    said = search.ranked(best.join(of, "turn_id").groupBy("session_id").agg(F.max("score").alias("score")), "session_id").select("session_id", "rank")
    return search.waterfall([("session", whole), ("turn", stored(said, "hits"))], "session_id", limit)


def chat_search(threads: DataFrame | TextIndex, messages: DataFrame | TextIndex, words: str, limit: int = 20, of: DataFrame | None = None, columns: tuple[list[str], list[str]] = (["title", "summary"], ["content_text", "sender_display_name"])) -> DataFrame:
    """thread_id, source, place of threads by title and summary, then by messages; unthreaded ones are thread -1.

    Tables, or indexes by thread_id and message_id; of: message_id, thread_id, if messages is an index.
    """
    whole = search.ranked(_hits(threads, "thread_id", columns[0], words, limit, True), "thread_id").select("thread_id", "rank")
    best = _hits(messages, "message_id", columns[1], words, 2 * limit, True)
    of = (messages if of is None else of).select("message_id", F.coalesce("thread_id", F.lit(-1).cast("long")).alias("thread_id"))
    said = best.join(of, "message_id").groupBy("thread_id").agg(F.max("score").alias("score"))
    return search.waterfall([("thread", whole), ("message", stored(search.ranked(said, "thread_id").select("thread_id", "rank"), "hits"))], "thread_id", limit)


def chat_thread(threads: DataFrame, messages: DataFrame, children: dict[str, DataFrame], thread_id: int) -> DataFrame:
    """A chat thread as a dossier: itself, its messages in order, and its children by kind (thread_id, text)."""
    own = threads.filter(F.col("thread_id") == thread_id)
    said = messages.filter(F.col("thread_id") == thread_id)
    parts = [section(own, "thread", F.col("title"), F.col("summary"), F.col("thread_id")), section(said, "messages", F.col("sender_display_name"), F.col("content_text"), F.col("composed_at"), F.col("message_id"), whole=True)]
    parts += [section(df.filter(F.col("thread_id") == thread_id), name, F.col("text"), F.lit(None), F.col("text"), whole=True) for name, df in children.items()]
    return union(parts)


def link_index(links: DataFrame, mode: str, limit: int = 50) -> DataFrame:
    """Links that are stale, or were never fetched, the longest untried first."""
    wanted = {"stale": F.col("last_status") == "stale", "unfetched": F.col("fetched_at").isNull()}[mode]
    return links.filter(wanted).orderBy(F.asc_nulls_first("last_attempt_at"), "url").limit(limit)


def known_names(people: DataFrame, topics: DataFrame, words: str) -> DataFrame:
    """person, topic: whether any name, and any topic, has the words; dossiers are only made for those."""
    has = lambda df, c, name: df.agg(F.coalesce(F.bool_or(F.lower(c).contains(words.lower())), F.lit(False)).alias(name))
    return has(people, "name", "person").join(F.broadcast(has(topics, "name", "topic")))


def session_children(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """turn_id, kind, text: what a session's answer holds, on the session's last turn.

    answers: session_id, decisions, facts, preferences, technical (arrays of texts). Preferences and
    technical decisions become facts with a tag.
    """
    last = turns.groupBy("session_id").agg(F.max_by("turn_id", "turn_index").alias("turn_id"))
    some = lambda c, kind, tag="": F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(tag), t).alias("text")))
    every = F.concat(some("decisions", "decision"), some("facts", "fact"), some("preferences", "fact", TAGS[0] + " "), some("technical", "fact", TAGS[1] + " "))
    return answers.join(last, "session_id").select("turn_id", F.explode(every).alias("c")).select("turn_id", "c.kind", "c.text")


def like_ranked(rows: DataFrame, key: str, column: str, words: str, *order: Column, title: str | None = None, limit: int = 5) -> DataFrame:
    """rank, id, title of the first rows by order (then key) whose column has the words, whatever the case."""
    order = (*order, F.col(key))
    found = rows.filter(F.lower(column).contains(words.lower())).orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return found.select(rank.alias("rank"), F.col(key).alias("id"), F.col(title or column).alias("title"))


def unified(kinds: dict[str, DataFrame], limit: int = 5, gates: DataFrame | None = None, contexts: dict[str, DataFrame] | None = None) -> DataFrame:
    """kind, rank, id, title of everything that is known on some words; every kind's best rows come first.

    kinds: name to ranked rows (rank, id, title), of which limit are taken. gates: one row of flags, such as
    known_names gives, and contexts: by flag, a dossier (section, rank, key, value), which is part of the result
    as kind flag_context if the flag holds and the dossier has a row. Four rows of kind summary tell how many rows
    there are, which kinds have any (sorted, with commas), and which contexts.
    """
    text = [df.filter(F.col("rank") <= limit).select(F.lit(k).alias("kind"), F.col("rank").cast("long").alias("rank"), F.col("id").cast("string").alias("id"), F.col("title").cast("string").alias("title")) for k, df in kinds.items()]
    hits = union(text)
    total = hits.agg(F.count(F.lit(1)).cast("string").alias("total_hits"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds_with_results"))
    lines = [(1, "total_hits"), (2, "kinds_with_results")]
    out = [hits]
    for flag, dossier in (contexts or {}).items():
        open_ = dossier.join(F.broadcast(gates.select(F.col(flag).alias("__open"))).filter("__open"))
        rows = open_.select(F.lit(f"{flag}_context").alias("kind"), F.col("rank").cast("long").alias("rank"), F.concat_ws(":", "section", "key").alias("id"), F.col("value").cast("string").alias("title"))
        out.append(rows)
        total = total.join(F.broadcast(rows.agg((F.count(F.lit(1)) > 0).cast("string").alias(f"has_{flag}_context"))))
        lines.append((len(lines) + 1, f"has_{flag}_context"))
    each = F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("rank"), F.lit(name).alias("id"), F.col(name).alias("title")) for n, name in lines))).alias("s")
    return union([*out, total.select(F.lit("summary").alias("kind"), each).select("kind", "s.*")])
