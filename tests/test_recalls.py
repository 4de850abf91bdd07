import datetime

from pyspark.sql import functions as F

from mnemora.operators import recalls as R


def day(n):
    return datetime.datetime(2026, 3, n)


def test_preferences(spark):
    rows = [(1, "[PREFERENCE] tabs over spaces", day(1)), (2, "[TECHNICAL] use parquet", day(2)), (3, "untagged parquet", day(3)), (4, "[PREFERENCE] short names", day(4))]
    facts = spark.createDataFrame(rows, "fact_id long, fact string, at timestamp")
    ids = lambda topic, limit: [r.fact_id for r in R.preferences(facts, topic, limit).collect()]
    assert ids("parquet", 5) == [2] and ids("tabs", 1) == [1]  # found by rank, though not among the newest
    assert ids("nowhere", 2) == [4, 2] and ids(None, 1) == [4]


def test_images(spark):
    images = spark.createDataFrame([("a", "content", "a Chart of sales", day(1)), ("b", "noise", "chart", day(2)), ("c", "content", "photo", day(3))], "sha256 string, classification string, vision_description string, classified_at timestamp")
    where = spark.createDataFrame([("a", "m2", "x@y", 0.9), ("a", "m1", "x@y", 0.1), ("c", "m3", "x@y", 0.5)], "sha256 string, message_id string, sender_email string, position_in_body double")
    got = R.image_search(images, where, "chart").collect()
    assert [(r.sha256, [o.message_id for o in r.occurrences]) for r in got] == [("a", ["m1", "m2"])]


def test_events_come_once(spark):
    events = spark.createDataFrame([(1, day(1), "Ann", "a@x"), (2, day(2), None, "b@x")], "event_id long, start_at timestamp, organizer_name string, organizer_email string")
    who = spark.createDataFrame([(1, "Ann Lee", "ann@x"), (1, "Annie", "annie@x"), (2, None, "bob@x")], "event_id long, name string, email string")
    got = R.calendar_events(events, who, person="ann").collect()
    assert [(r.event_id, r.attendees, r.organizer) for r in got] == [(1, ["Ann Lee", "Annie"], "Ann")]
    assert [r.organizer for r in R.calendar_events(events, who, since=F.lit(day(2))).collect()] == ["b@x"]


def test_sessions_and_chats(spark):
    sessions = spark.createDataFrame([(1, "about otters", None, "Home", day(1)), (2, "misc", "x", "Work", day(9))], "session_id long, summary string, topics_summary string, workspace string, started_at timestamp")
    turns = spark.createDataFrame([(10, 1, 0, "s", "otters here"), (20, 2, 0, None, "more otters"), (21, 2, 1, None, "bye")], "turn_id long, session_id long, turn_index long, summary string, content string")
    assert [(r.session_id, r.source) for r in R.session_search(sessions, turns, "otters").orderBy("place").collect()] == [(1, "session"), (2, "turn")]
    assert [r.session_id for r in R.recent_sessions(sessions, F.lit(day(10))).collect()] == [2]
    answers = spark.createDataFrame([(2, ["go"], ["f"], ["tabs"], None)], "session_id long, decisions array<string>, facts array<string>, preferences array<string>, technical array<string>")
    assert {tuple(r) for r in R.session_children(turns, answers).collect()} == {(21, "decision", "go"), (21, "fact", "f"), (21, "fact", "[PREFERENCE] tabs")}
    threads = spark.createDataFrame([(1, "red fox", "s")], "thread_id long, title string, summary string")
    messages = spark.createDataFrame([(5, 1, "Ann", "a red fox ran", day(1)), (6, None, "Bob", "red fox", day(2)), (7, None, "Bob", "fox red", day(2))], "message_id long, thread_id long, sender_display_name string, content_text string, composed_at timestamp")
    assert [(r.thread_id, r.source) for r in R.chat_search(threads, messages, "red fox").orderBy("place").collect()] == [(1, "thread"), (-1, "message")]
    todo = spark.createDataFrame([(1, "call")], "thread_id long, text string")
    got = {(r.section, r.key) for r in R.chat_thread(threads, messages, {"actions": todo}, 1).collect()}
    assert got == {("thread", "red fox"), ("messages", "Ann"), ("actions", "call")}


def test_links_and_gate(spark):
    links = spark.createDataFrame([("a", None, "stale", day(2)), ("b", day(1), "ok", day(1)), ("c", None, None, None)], "url string, fetched_at timestamp, last_status string, last_attempt_at timestamp")
    assert [r.url for r in R.link_index(links, "unfetched").collect()] == ["c", "a"] and [r.url for r in R.link_index(links, "stale").collect()] == ["a"]
    people, topics = spark.createDataFrame([("Ann Lee",)], "name string"), spark.createDataFrame([], "name string")
    assert tuple(R.known_names(people, topics, "lee").first()) == (True, False)


def test_recall_over_all_kinds(spark):
    ranked = lambda *rows: spark.createDataFrame([(k + 1, i, t) for k, (i, t) in enumerate(rows)], "rank int, id string, title string")
    kinds = {"emails": ranked(*((f"m{i}", "mail") for i in range(9))), "decisions": ranked(("d1", "adopt")), "actions": ranked()}
    gates = spark.createDataFrame([(True, False, True)], "person boolean, topic boolean, other boolean")
    dossier = spark.createDataFrame([("profile", 1, "Ann", "a@x")], "section string, rank int, key string, value string")
    got = R.unified(kinds, 5, gates, {"person": dossier, "topic": dossier, "other": dossier.limit(0)}).collect()
    assert [r.id for r in got if r.kind == "emails"] == ["m0", "m1", "m2", "m3", "m4"]
    assert [(r.id, r.title) for r in got if r.kind.endswith("_context")] == [("profile:Ann", "a@x")]
    assert {r.id: r.title for r in got if r.kind == "summary"} == {"total_hits": "6", "kinds_with_results": "decisions,emails", "has_person_context": "true", "has_topic_context": "false", "has_other_context": "false"}
    nothing = R.unified({"actions": ranked()}).collect()
    assert {r.id: r.title for r in nothing} == {"total_hits": "0", "kinds_with_results": ""}
    rows = spark.createDataFrame([(1, "Adopt X", 2), (2, "adopt y", None), (3, "adopt z", 1), (4, "no", 0)], "k long, t string, d int")
    assert [(r["rank"], r.id) for r in R.like_ranked(rows, "k", "t", "ADOPT", F.asc_nulls_last("d"), limit=2).collect()] == [(1, 3), (2, 1)]
