import datetime

from pyspark.sql import functions as F

from mnemora.operators import windows as W


def ts(s):
    return datetime.datetime.fromisoformat(s)


def test_gaps_bound_sessions(spark):
    rows = [(1, ts("2026-03-01 08:00"), 1), (1, ts("2026-03-01 08:30"), 2), (1, ts("2026-03-01 15:00"), 3), (2, ts("2026-03-01 08:00"), 4), (2, ts("2026-03-01 16:30"), 5), (3, ts("2026-03-01 08:00"), 6), (3, ts("2026-03-01 16:00"), 7)]
    df = spark.createDataFrame(rows, "chat long, at timestamp, id long")
    got = {r.id: r.session for r in W.sessions(df, "chat", "at", ["id"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 1, 7: 1}


def test_reply_anchor(spark):
    df = spark.createDataFrame([("c::1", None), ("c::2", "1"), ("c::a::b", None)], "id string, parent string")
    assert [r.a for r in df.select(W.reply_anchor(F.col("parent"), F.col("id")).alias("a")).collect()] == ["1", "1", "a::b"]


def test_collapse(spark):
    rows = [("s", 1, "user", "a"), ("s", 2, "user", "b"), ("s", 3, "bot", "c"), ("s", 4, "user", "d"), ("t", 1, None, "x"), ("t", 2, None, "y")]
    got = W.collapse(spark.createDataFrame(rows, "sid string, at long, who string, text string"), "sid", "at", "who", "text", 2).collect()
    assert sorted((r.sid, r.turn_index, r.speaker, r.parts, r.content) for r in got) == [("s", 0, "user", 2, "a\n"), ("s", 1, "bot", 1, "c"), ("s", 2, "user", 1, "d"), ("t", 0, None, 2, "x\n")]


def test_latest_versions(spark):
    rows = [("f", "202603010900_Plan.docx", ts("2026-01-01")), ("f", "202603020900_plan.docx", ts("2026-01-01")), ("f", "plan.docx", ts("2026-03-01 10:00")), ("g", "plan.docx", ts("2026-03-01"))]
    got = W.latest_versions(spark.createDataFrame(rows, "folder string, name string, modified timestamp")).collect()
    assert {(r.folder, r.name) for r in got} == {("f", "202603020900_plan.docx"), ("g", "plan.docx")}


def test_generations_and_weeks(spark):
    days = [datetime.date(2026, 12, 20) + datetime.timedelta(i) for i in range(20)]
    df = spark.createDataFrame([("a", d) for d in days], "grp string, day date")
    kept = {r.day for r in W.keep_generations(df, "grp", "day", 3, 3).filter("kept").collect()}
    # three newest days, and the newest day of each of three ISO weeks; 1 January 2027 is in week 53 of 2026
    assert kept == {datetime.date(2027, 1, d) for d in (6, 7, 8, 3)} | {datetime.date(2026, 12, 27)}
    assert df.filter("day = date '2027-01-01'").select(W.iso_week(F.col("day"))).first()[0] == "2026-W53"


def test_month_chunks(spark):
    df = spark.createDataFrame([(datetime.date(2026, 1, 15), datetime.date(2026, 3, 1)), (datetime.date(2026, 1, 1), datetime.date(2026, 1, 1))], "a date, b date")
    got = [None if r.c is None else [(str(x.start), str(x.stop)) for x in r.c] for r in df.select(W.month_chunks(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [[("2026-01-15", "2026-02-01"), ("2026-02-01", "2026-03-01")], None]


def test_substance(spark):
    rows = [(1, "x" * 90, False), (1, "y" * 10, False), (2, "z" * 19 + "!", False), (2, "w" * 20, False), (3, "q" * 500, True)]
    got = W.has_substance(spark.createDataFrame(rows, "thread long, content_text string, is_system boolean"), ["thread"]).collect()
    assert {r.thread for r in got} == {1}
