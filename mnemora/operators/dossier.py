"""The query catalogue over a store: mails, people, topics, actions, decisions.

A store is any object whose methods give the views (mails(), people(), mail_people(), mail_topics(),
actions(), decisions()). Dossiers are long tables (section, rank, key, value), so that each section is one
small aggregate and nothing is collected on the way; `nested` makes one row of arrays of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.operators.windows import numbered, top_of


def matches(who: str, name: str = "name", email: str = "email") -> Column:
    """An address names its owner; anything else is part of a name."""
    return F.lower(F.trim(F.col(email))) == who.strip().lower() if "@" in who else F.lower(F.col(name)).contains(who.strip().lower())


def person_ids(store, who: str) -> DataFrame:
    return store.people().filter(matches(who)).select("person_id")


def thread(store, email_id: int, limit: int = 50) -> DataFrame:
    """Mails of the mail's conversation, oldest first; none if it has no conversation."""
    mails = store.mails()
    own = mails.filter((F.col("email_id") == email_id) & F.col("conversation_id").isNotNull()).select("conversation_id")
    return mails.join(own, "conversation_id", "left_semi").orderBy("date_received", "email_id").limit(limit).select("email_id", "date_received", "sender_id", "sentiment")


def by_person(store, who: str, limit: int = 20) -> DataFrame:
    """Mails of the people that match, newest first; a mail comes once per role."""
    links = store.mail_people().join(person_ids(store, who), "person_id", "left_semi").select("email_id", "role").distinct()
    return store.mails().join(links, "email_id").orderBy(F.desc("date_received"), "email_id", "role").limit(limit).select("email_id", "date_received", "sender_id", "role")


def by_topic(store, topic: str, limit: int = 20) -> DataFrame:
    ids = store.mail_topics().filter(F.lower("topic").contains(topic.strip().lower())).select("email_id")
    return store.mails().join(ids, "email_id", "left_semi").orderBy(F.desc("date_received"), "email_id").limit(limit).select("email_id", "date_received", "sender_id")


def by_date(store, start: str, end: str, limit: int = 50) -> DataFrame:
    """Mails of the days from start to end, both included."""
    day = F.to_date("date_received")
    return store.mails().filter(day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))).orderBy(F.desc("date_received"), "email_id").limit(limit).select("email_id", "date_received", "sender_id")


def topic_lists(links: DataFrame) -> DataFrame:
    return links.groupBy("email_id").agg(F.array_join(F.array_sort(F.collect_list("topic")), ", ").alias("topics"))


def decisions(store, topic: str | None = None, person: str | None = None, limit: int = 20) -> DataFrame:
    """Decisions of mails, newest first by their own date or else the mail's, with all topics of the mail."""
    rows = store.decisions()
    if topic:
        rows = rows.join(store.mail_topics().filter(F.lower("topic").contains(topic.strip().lower())).select("email_id"), "email_id", "left_semi")
    if person:
        rows = rows.filter(F.lower("decided_by").contains(person.lower()))
    whole = rows.join(store.mails().select("email_id", "date_received"), "email_id").withColumn("date", F.coalesce("decision_date", F.to_date("date_received")))
    top = whole.orderBy(F.desc("date"), "email_id", "decision", "decided_by").limit(limit).select("email_id", "decision", "decided_by", "date")
    lists = topic_lists(store.mail_topics().join(F.broadcast(top.select("email_id").distinct()), "email_id", "left_semi"))
    return top.join(lists, "email_id", "left")


def recent_decisions(store, as_of: str, days: int = 30, limit: int = 20) -> DataFrame:
    mails = store.mails().filter(F.col("date_received") >= F.date_sub(F.lit(as_of).cast("date"), days)).select("email_id", "date_received")
    rows = store.decisions().join(mails, "email_id").withColumn("date", F.coalesce("decision_date", F.to_date("date_received")))
    return rows.orderBy(F.desc("date"), "email_id", "decision", "decided_by").limit(limit).select("email_id", "decision", "decided_by", "date")


def actions(store, owner: str | None = None, status: str | None = "open", limit: int = 50) -> DataFrame:
    """Actions by deadline, those without one last, then the newest mail; no status means all."""
    rows = store.actions()
    if status:
        rows = rows.filter(F.col("status") == status)
    if owner:
        rows = rows.filter(F.lower("owner").contains(owner.lower()))
    whole = rows.join(store.mails().select("email_id", "date_received"), "email_id")
    return whole.orderBy(F.asc_nulls_last("deadline"), F.desc("date_received"), "email_id", "task", "owner", "line").limit(limit).select("email_id", "task", "owner", "deadline", "status", "line")


def combined(store, person: str | None = None, topic: str | None = None, keyword: DataFrame | None = None, start: str | None = None, end: str | None = None, limit: int = 20) -> DataFrame:
    """Mails that pass all filters given, newest first, with their topics. keyword: a table of email_id.

    Every filter is a semi-join or a predicate, so none multiplies rows. No filter is an error.
    """
    if not any((person, topic, keyword is not None, start, end)):
        raise ValueError("at least one filter is needed")
    rows = store.mails()
    day = F.to_date("date_received")
    limits = [day >= F.lit(start).cast("date")] * bool(start) + [day <= F.lit(end).cast("date")] * bool(end)
    rows = rows.filter(reduce(lambda a, b: a & b, limits, F.lit(True)))
    if person:
        rows = rows.join(store.mail_people().join(person_ids(store, person), "person_id", "left_semi").select("email_id"), "email_id", "left_semi")
    if topic:
        rows = rows.join(store.mail_topics().filter(F.lower("topic").contains(topic.lower())).select("email_id"), "email_id", "left_semi")
    if keyword is not None:
        rows = rows.join(keyword.select("email_id"), "email_id", "left_semi")
    top = rows.orderBy(F.desc("date_received"), "email_id").limit(limit).select("email_id", "date_received", "sender_id")
    lists = topic_lists(store.mail_topics().join(F.broadcast(top.select("email_id")), "email_id", "left_semi"))
    return top.join(lists, "email_id", "left")


def section(df: DataFrame, name: str, key: Column, value: Column, *order: Column, limit: int | None = None, whole: bool = False) -> DataFrame:
    """A table as rows of a dossier; limit cuts before ranks are given. whole: all rows, of which there may be many."""
    if whole:
        rows = numbered(df, "__rank", *order)
        return rows.select(F.lit(name).alias("section"), F.col("__rank").cast("long").alias("rank"), key.cast("string").alias("key"), value.cast("string").alias("value"))
    rows = df.orderBy(*order).limit(limit) if limit else df
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return rows.select(F.lit(name).alias("section"), rank.cast("long").alias("rank"), key.cast("string").alias("key"), value.cast("string").alias("value"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def nested(dossier: DataFrame) -> DataFrame:
    """One row: a map from section to its ordered array of struct(key, value)."""
    item = F.array_sort(F.collect_list(F.struct("rank", "key", "value")))
    sections = dossier.groupBy("section").agg(F.transform(item, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))).alias("items"))
    return sections.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "items")))).alias("dossier"))


def tally(df: DataFrame, column: str, name: str, limit: int | None = None) -> DataFrame:
    """Counts by value, most first; null and '' as unknown."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))
    counts = df.groupBy(value.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return section(counts, name, F.col("k"), F.col("n"), F.desc("n"), F.col("k"), limit=limit)


def person_context(store, who: str, as_of: str, days: int = 365) -> DataFrame:
    """What is known of the first person that matches: counts, rate, topics, sentiments, partners, actions, decisions."""
    person = store.people().filter(matches(who)).agg(F.min("person_id").alias("person_id")).filter("person_id is not null")
    profile = store.people().join(F.broadcast(person), "person_id", "left_semi")
    links = store.mail_people().join(F.broadcast(person), "person_id", "left_semi").select("email_id").distinct()
    mails = store.mails().join(links, "email_id", "left_semi")
    recent = mails.filter(F.col("date_received") >= F.date_sub(F.lit(as_of).cast("date"), days))
    span = mails.agg(F.count(F.lit(1)).alias("total"), F.min("date_received").alias("first"), F.max("date_received").alias("last"))
    weeks = F.greatest(F.floor((F.unix_seconds(F.col("last").cast("timestamp")) - F.unix_seconds(F.col("first").cast("timestamp"))) / 86400) / 7, F.lit(1.0))
    span = span.withColumn("rate", F.bround(F.col("total") / weeks, 1)).filter("total > 0")
    ids = recent.select("email_id")
    topics = store.mail_topics().join(ids, "email_id", "left_semi")
    others = store.mail_people().join(ids, "email_id", "left_semi").join(F.broadcast(person), "person_id", "left_anti").groupBy("person_id").agg(F.count_distinct("email_id").alias("n"))
    mine = store.actions().filter("status = 'open'").join(F.broadcast(person.withColumnRenamed("person_id", "owner")), "owner", "left_semi")
    made = store.decisions().join(F.broadcast(person.withColumnRenamed("person_id", "decided_by")), "decided_by", "left_semi").join(ids, "email_id", "left_semi")
    one = F.col("section").isNotNull()
    return union([
        section(profile, "profile", F.col("name"), F.col("email"), F.col("person_id")),
        section(span, "first_mail", F.lit("date"), F.to_date("first"), F.col("total")),
        section(span, "last_mail", F.lit("date"), F.to_date("last"), F.col("total")),
        section(span, "mails_per_week", F.lit("rate"), F.col("rate").cast("decimal(18,1)"), F.col("total")),
        section(recent.agg(F.count(F.lit(1)).alias("n")), "recent_mails", F.lit("count"), F.col("n"), F.col("n")),
        tally(topics, "topic", "topics", 10),
        tally(recent, "sentiment", "sentiments"),
        section(others, "works_with", F.col("person_id"), F.col("n"), F.desc("n"), F.col("person_id"), limit=10),
        section(mine, "open_actions", F.col("task"), F.col("deadline"), F.asc_nulls_last("deadline"), F.col("task"), F.col("email_id"), F.col("line"), limit=10),
        section(made, "decisions", F.col("decision"), F.col("email_id"), F.desc("email_id"), F.col("decision"), limit=10),
    ]).filter(one)


def sender_brief(store, who: str, as_of: str, days: int = 365) -> DataFrame:
    """The short form of person_context: profile, rate, mails, five topics, number of open actions; or known = false."""
    whole = person_context(store, who, as_of, days)
    short = whole.filter("section in ('profile', 'mails_per_week', 'recent_mails') or (section = 'topics' and rank <= 5)")
    open_ = section(whole.filter("section = 'open_actions'").agg(F.count(F.lit(1)).alias("n")), "n_open_actions", F.lit("count"), F.col("n"), F.col("n"))
    known = section(whole.agg((F.count_if(F.col("section") == "profile") > 0).alias("k")), "known", F.lit("known"), F.col("k"), F.col("k"))
    return union([known, short, open_])


def topic_context(store, topic: str, as_of: str, days: int = 365) -> DataFrame:
    """What is known of the first topic that matches: mails, people, related topics, sentiments, decisions, actions."""
    name = store.mail_topics().filter(F.lower("topic").contains(topic.strip().lower())).agg(F.min("topic").alias("topic")).filter("topic is not null")
    links = store.mail_topics().join(F.broadcast(name), "topic", "left_semi").select("email_id")
    mails = store.mails().join(links, "email_id", "left_semi").filter(F.col("date_received") >= F.date_sub(F.lit(as_of).cast("date"), days))
    ids = mails.select("email_id")
    people = store.mail_people().join(ids, "email_id", "left_semi").groupBy("person_id").agg(F.count_distinct("email_id").alias("n"))
    related = store.mail_topics().join(ids, "email_id", "left_semi").join(F.broadcast(name), "topic", "left_anti")
    made = store.decisions().join(ids, "email_id", "left_semi")
    todo = store.actions().filter("status = 'open'").join(ids, "email_id", "left_semi")
    return union([
        section(name, "topic", F.lit("name"), F.col("topic"), F.col("topic")),
        section(mails.agg(F.count(F.lit(1)).alias("n")), "mails", F.lit("count"), F.col("n"), F.col("n")),
        section(people, "people", F.col("person_id"), F.col("n"), F.desc("n"), F.col("person_id"), limit=10),
        tally(related, "topic", "related", 10),
        tally(mails, "sentiment", "sentiments"),
        section(made, "decisions", F.col("decision"), F.col("email_id"), F.desc("email_id"), F.col("decision"), F.col("decided_by"), limit=10),
        section(todo, "open_actions", F.col("task"), F.col("owner"), F.asc_nulls_last("deadline"), F.col("task"), F.col("owner"), F.col("email_id"), F.col("line"), limit=10),
    ])


def thread_context(store, email_id: int) -> DataFrame:
    """A mail's thread: mails, people, decisions oldest first, open actions by deadline."""
    mails = store.mails()
    own = mails.filter((F.col("email_id") == email_id) & F.col("conversation_id").isNotNull()).select("conversation_id")
    rows = mails.join(F.broadcast(own), "conversation_id", "left_semi")
    ids = rows.select("email_id")
    people = store.mail_people().join(ids, "email_id", "left_semi").select("person_id").distinct()
    made = store.decisions().join(rows.select("email_id", "date_received"), "email_id").withColumn("date", F.coalesce("decision_date", F.to_date("date_received")))
    todo = store.actions().filter("status = 'open'").join(ids, "email_id", "left_semi")
    return union([
        section(rows, "mails", F.col("email_id"), F.to_date("date_received"), F.col("date_received"), F.col("email_id"), limit=50),
        section(people, "people", F.col("person_id"), F.lit(""), F.col("person_id"), whole=True),
        section(made, "decisions", F.col("decision"), F.col("date"), F.col("date"), F.col("email_id"), F.col("decision"), F.col("decided_by"), whole=True),
        section(todo, "open_actions", F.col("task"), F.col("deadline"), F.asc_nulls_last("deadline"), F.col("task"), F.col("email_id"), F.col("line"), whole=True),
    ])


def meeting_prep(store, who: list[str], as_of: str, days: int = 365, each: int = 10) -> DataFrame:
    """For each attendee: mails, their sentiments, decisions, open actions (of any time), five topics.

    attendee, section, rank, key, value. One pass for all attendees; ranks are taken by attendee, so each
    group is cut short before the shuffle.
    """
    cases = [F.when(matches(w), F.lit(w)) for w in who]
    people = store.people().select("person_id", F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("attendee"))
    links = store.mail_people().join(people, "person_id").select("attendee", "email_id").distinct()
    mails = store.mails().filter(F.col("date_received") >= F.date_sub(F.lit(as_of).cast("date"), days)).join(links, "email_id")
    made = store.decisions().join(mails.select("attendee", "email_id"), "email_id")
    todo = store.actions().filter("status = 'open'").join(people.withColumnRenamed("person_id", "owner"), "owner")
    topics = store.mail_topics().join(mails.select("attendee", "email_id"), "email_id").groupBy("attendee", "topic").agg(F.count(F.lit(1)).alias("n"))
    tone = mails.groupBy("attendee", F.coalesce(F.nullif("sentiment", F.lit("")), F.lit("unknown")).alias("sentiment")).agg(F.count(F.lit(1)).alias("n"))

    def part(df: DataFrame, name: str, n: int, key: Column, value: Column, *order: Column) -> DataFrame:
        return top_of(df, ["attendee"], n, *order).select("attendee", F.lit(name).alias("section"), F.col("rank").cast("long").alias("rank"), key.cast("string").alias("key"), value.cast("string").alias("value"))

    return union([
        part(mails, "mails", each, F.col("email_id"), F.to_date("date_received"), F.desc("date_received"), F.col("email_id")),
        part(tone, "sentiments", 100, F.col("sentiment"), F.col("n"), F.desc("n"), F.col("sentiment")),
        part(made, "decisions", each, F.col("decision"), F.col("email_id"), F.desc("email_id"), F.col("decision"), F.col("decided_by")),
        part(todo, "open_actions", each, F.col("task"), F.col("deadline"), F.asc_nulls_last("deadline"), F.col("task"), F.col("email_id"), F.col("line")),
        part(topics, "topics", 5, F.col("topic"), F.col("n"), F.desc("n"), F.col("topic")),
    ])


def counts(tables: dict[str, DataFrame], dated: DataFrame, date: str) -> DataFrame:
    """name, value of each table's rows, and of the first and last date."""
    parts = [df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(name).alias("name"), "value") for name, df in tables.items()]
    ends = dated.agg(F.to_date(F.min(date)).alias("first"), F.to_date(F.max(date)).alias("last"))
    parts += [ends.select(F.lit(f"{c}_date").alias("name"), F.col(c).cast("string").alias("value")) for c in ("first", "last")]
    return union(parts)


def recall(kinds: dict[str, DataFrame], limit: int = 5) -> DataFrame:
    """kind, rank, id, title of each kind's best rows (rank, id, title), and a row per kind with hits in kind summary."""
    found = union([df.filter(F.col("rank") <= limit).select(F.lit(k).alias("kind"), F.col("rank").cast("long").alias("rank"), F.col("id").cast("string").alias("id"), F.col("title")) for k, df in kinds.items()])
    total = found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("kind").alias("k"))
    summary = union([
        total.select(F.lit("summary").alias("kind"), F.lit(1).cast("long").alias("rank"), F.lit("total_hits").alias("id"), F.col("n").cast("string").alias("title")),
        total.select(F.lit("summary").alias("kind"), F.lit(2).cast("long").alias("rank"), F.lit("kinds_with_results").alias("id"), F.col("k").cast("string").alias("title")),
    ])
    return found.unionByName(summary)
