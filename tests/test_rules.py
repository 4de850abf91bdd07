import datetime

import pytest
from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.operators import health, lifecycle, selection as S


def ts(s):
    return datetime.datetime.fromisoformat(s)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_link_matrix(spark):
    now, old, new = ts("2026-08-19 01:00"), ts("2026-08-01"), ts("2026-08-18")
    rows = [("under cap", None, "http-error", new, 2), ("at cap", None, "http-error", new, 5), ("rested", None, "http-error", old, 5), ("fetched", old, "ok", old, 0), ("host", None, "unsupported-host", old, 0), ("gone", None, "stale", old, 5), ("once fetched", old, "stale", old, 9), ("never tried", None, None, None, 0)]
    df = spark.createDataFrame(rows, "name string, fetched_at timestamp, last_status string, last_attempt_at timestamp, attempts long")
    assert {r.name for r in S.links_to_retry(df, F.lit(now)).collect()} == {"under cap", "rested", "once fetched", "never tried"}


def test_actions(spark):
    rows = [(1, 1, "t", "o", "2026-01-01", "open"), (2, 1, "t", "o", "2026-01-01", "open"), (3, 1, "t", "o", None, "open"), (4, 1, "t", "o", "", "open"), (5, 2, "t", "o", "Friday", "open"), (6, 3, "t", "o", "2025-01-01 noon", "open"), (7, 3, "t", "o", "2025-01-01", "completed"), (8, 9, "t", "o", "2026-13-45", "open")]
    df = spark.createDataFrame(rows, "id long, email_id long, task string, owner string, deadline string, status string")
    assert {r.id for r in lifecycle.without_repeats(df).collect()} == {1, 3, 5, 6, 8} or {r.id for r in lifecycle.without_repeats(df).collect()} == {1, 3, 5, 6, 7, 8}
    as_of = F.lit(datetime.date(2026, 2, 1))
    assert {r.id for r in lifecycle.expire(df, as_of).filter("status = 'expired'").collect()} == {6}
    assert {r.id: r.days_overdue for r in lifecycle.overdue(df, as_of).collect()} == {1: 31, 2: 31, 6: 396}


def test_stale_threads(spark):
    rows = [(100, "a", "me@x", ts("2026-03-01")), (101, "a", "you@x", ts("2026-02-01")), (200, "b", "me@x", ts("2026-03-01")), (201, "b", "you@x", ts("2026-03-02")), (300, "c", "me@x", ts("2099-01-01")), (400, "d", "ME@x", ts("2026-03-01")), (401, "d", "me@x", ts("2026-03-01"))]
    df = spark.createDataFrame(rows, "id long, conversation_id string, sender_address string, date_received timestamp")
    now = F.lit(ts("2026-03-20 12:00"))
    assert {r.id: r.days_waiting for r in lifecycle.stale_threads(df, "me@x", now).collect()} == {100: 19, 400: 19, 401: 19}
    assert lifecycle.stale_threads(df, "", now).collect() == []


def test_image_cascade(spark):
    rows = [("k", 10, 10, 10, "content", None), ("u", 10, 10, 10, "unclassified", True), ("d", None, None, 9000, None, None), ("s", 50, 500, 9000, None, None), ("b", 500, 500, 4000, None, None), ("f", 500, 500, 9000, None, None), ("n", 500, 500, 9000, None, None)]
    images = spark.createDataFrame([("a@x", *r) for r in rows], "sender_email string, sha256 string, width int, height int, bytes long, classification string, user_overridden boolean")
    shares = spark.createDataFrame([("a@x", "f", 0.05), ("a@x", "n", 0.04)], "sender_email string, sha256 string, frequency double")
    got = {r.sha256: (r.classification, r.method) for r in S.classify_images(images, shares).collect()}
    assert got == {"k": ("content", "kept"), "u": ("unclassified", "kept"), "d": ("noise", "decode_failed"), "s": ("noise", "dimensions"), "b": ("noise", "byte_size"), "f": ("signature", "frequency"), "n": ("unclassified", "stage1_passed")}


def test_small_rules(spark):
    assert one(spark, S.vision_label, "content: a chart") == ("content", "a chart") and one(spark, S.vision_label, "hm") == ("signature", None)
    assert one(spark, T.title_from_url, "https://a.example/docs/my-first_page.html") == "My First Page" and one(spark, T.title_from_url, "https://a.example/") == "a.example"
    assert one(spark, T.contact_id, "https://x/contacts/8:orgid:1") == "8:orgid:1" and one(spark, T.contact_id, "https://x/") is None
    assert one(spark, T.drop_tracking, "https://h/p?web=1&a=b&CSF=2#f") == "https://h/p?a=b#f"
    assert one(spark, T.message_text, "a<br/>b <b>c</b> 1 < 2 &amp; &eacute;") == "a\nb c 1 < 2 & é"
    assert one(spark, T.strip_accents_all, "Ång ς ά ё") == "Ang ς α е"
    assert one(spark, T.normalize_subject, "Απ: RE: Fwd: Θέμα") == "θέμα"
    assert one(spark, lambda c: S.position_in_body(c, [F.lit("cid:9"), F.lit("cid:1")]), "abcd CID:1 xx") == pytest.approx(5 / 13)
    assert one(spark, lambda c: T.embed_text(c, F.lit(" "), F.lit(None).cast("string"), F.lit("sum")), "Subj") == "Subj — sum"
    kinds = [("meeting", None, []), (None, True, []), (None, None, ["8:a", "8:b", "8:c"]), (None, None, ["8:a", "28:bot", "8:b"]), (None, None, ["8:a"])]
    rows = [(t, o, [(m,) for m in members]) for t, o, members in kinds]
    df = spark.createDataFrame(rows, "t string, o boolean, m array<struct<mri:string>>")
    assert [r.k for r in df.select(S.chat_kind(F.col("t"), F.col("o"), F.col("m")).alias("k")).collect()] == ["meeting", "oneOnOne", "group", "oneOnOne", "group"]
    df = spark.createDataFrame([("me@corp.example",), ("PA@corp.example",), ("x@y",), (None,)], "e string")
    assert [r.s for r in df.select(S.self_organized(F.col("e"), "me@", ["pa@corp.example"]).alias("s")).collect()] == [True, True, False, False]
    assert [r.s for r in df.select(S.self_organized(F.col("e"), "", []).alias("s")).collect()] == [False] * 4
    with pytest.raises(ValueError):
        S.mime_family(F.lit("x"), "nope")


def test_articles(spark):
    fetched = ts("2026-03-02")
    rows = [("u1", "The Paper!", ts("2026-03-01"), fetched, "body"), ("u2", "P", ts("2099-01-01"), fetched, "b"), ("u3", "P", None, None, "b"), ("u4", "P", None, fetched, " ")]
    articles = spark.createDataFrame(rows, "url string, source string, published_at timestamp, fetched_at timestamp, content string")
    cats = spark.createDataFrame([("u1", "b"), ("u1", "a")], "article_url string, category string")
    ticks = spark.createDataFrame([], "article_url string, ticker string")
    got = {r.conversation_id: (r.sender_address, r.content) for r in S.article_records(articles, cats, ticks).collect()}
    assert got == {"news-2026-03-01": ("the-paper@news", "body\nCategories: a, b\nURL: u1"), "news-2026-03-02": ("p@news", "b\nURL: u2")}


def test_health(spark):
    now = F.lit(ts("2026-03-02 12:00"))
    df = spark.createDataFrame([(ts("2026-03-02 11:00"),), (ts("2026-02-01"),)], "at timestamp")
    r = health.freshness(df, "x", "at", now, 6).first()
    assert (r.rows, r.last_day, r.last_week, r.state) == (2, 1, 1, "OK")
    assert health.freshness(df.limit(0), "x", "at", now, 6).first().state == "STALE"
    files = spark.createDataFrame([("/a/x", ts("2030-01-01")), ("/a/y", ts("2026-01-01"))], "path string, modified timestamp")
    assert {(r.root, r.files, r.newest) for r in health.newest_files(files, ["/a/", "/b/"], now).collect()} == {("/a/", 2, ts("2026-03-02 12:00")), ("/b/", 0, None)}
    mails, done = spark.createDataFrame([(1,), (2,)], "message_id long"), spark.createDataFrame([(1,)], "message_id long")
    images = spark.createDataFrame([("unclassified", ts("2026-02-01")), ("noise", None)], "classification string, classified_at timestamp")
    assert tuple(health.backlog(images, mails, done, now).first()) == (1, 1, 1)
