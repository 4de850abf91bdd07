import datetime
import json

from pyspark.sql import functions as F

from mnemora.functions import extraction as X
from mnemora.operators import writes
from mnemora.operators.snapshots import SnapshotTable
from mnemora.sources import readers
from mnemora.streaming import incremental


def test_staging_batches(spark, tmp_path):
    mail = lambda i, s: {"message_id": i, "subject": s, "date_received": "2026-03-01T10:00:00.1234567Z", "sender": {"name": "A", "address": "a@x"}}
    (tmp_path / "batch-001.json").write_text(json.dumps({"batch_number": 1, "emails": [mail("m1", "old"), mail("m2", "x")]}, indent=1))
    (tmp_path / "batch-002.json").write_text(json.dumps([mail("m1", "new")]))
    got = {r.message_id: (r.subject, r.received_at, r.sender.address) for r in readers.staging_batches(spark, f"{tmp_path}/batch-*.json").collect()}
    at = datetime.datetime(2026, 3, 1, 10, 0, 0, 123456)
    assert got == {"m1": ("new", at, "a@x"), "m2": ("x", at, "a@x")}


def test_extractions_and_repairs(spark, tmp_path):
    (tmp_path / "AbC.json").write_text('```json\n{"summary": "s", "topics": ["t",], "people_roles": {"Ann": ["a", "b"], "Bob": {"role": "c"}}, "decisions": ["do"], "action_items": [{"task": "t", "owner": ["x", "y"], "deadline": ["2026-01-01"]}]}\n```')
    (tmp_path / "bad.json").write_text("sorry")
    rows = readers.extractions(spark, str(tmp_path)).collect()
    assert [r.message_key for r in rows] == ["abc"]
    a = rows[0].answer
    assert (a.summary, a.topics, a.people_roles, a.decisions[0].decision, a.action_items[0].owner, a.action_items[0].deadline, a.sentiment) == ("s", ["t"], {"Ann": "a, b", "Bob": "c"}, "do", "x, y", "2026-01-01", "informational")


def test_cut_off_answers():
    whole = {"summary": "it's {a} \"quote\"", "topics": ["a", "b"], "action_items": [{"task": "t", "owner": "o"}]}
    text = json.dumps(whole)
    for n in range(20, len(text)):
        found = X.loads(text[:n])
        assert found is None or found["summary"].startswith("it") or found == {}
    assert X.loads('{"summary": "x", "topics": ["a", "b') == {"summary": "x", "topics": ["a", "b"]}
    assert X.loads('{"summary": "x", "owner":') == {"summary": "x"} == X.loads('{"summary": "x", "own') == X.loads('{"summary": "x", "n": -1.')
    assert X.loads('{"a": [1, {"b": tru') == {"a": [1, {}]} and X.loads('{"a": "x\\u00') == {"a": "x"} and X.loads('{"a": 1 x "b": 2') is None
    whole = '{"summary": "it", "topics": ["a", {"k": [1, 2.5, true, null]}], "n": -12e3}'
    assert all(isinstance(X.loads(whole[:n]), dict) for n in range(1, len(whole) + 1))
    assert X.loads('{"a": "1"\n"b": "2"}') == {"a": "1", "b": "2"}
    assert X.loads('{"s": "a, }b"}') == {"s": "a, }b"} and X.loads("[1]") is None and X.loads(None) is None


def test_transcripts(spark, tmp_path):
    line = lambda kind, content, at=None, **more: json.dumps({"type": kind, "timestamp": at, "message": {"role": kind, "content": content}} | more)
    use = lambda name, **found: {"type": "tool_use", "name": name, "input": found}
    lines = [
        line("user", "  [done] please go on \u00a0", "2026-03-01T10:00:09Z"), "not json", "[1]", "", line("user", "z second", "2026-03-01T10:00:01Z", sessionId="s1"), line("user", "a third", "2026-03-01T10:00:01Z"),
        line("system", "no", cwd="/x/proj/"), line("progress", "no", "2020-01-01T00:00:00Z"), line("summary", "no", "2027-01-01T00:00:00Z"),
        line("assistant", [{"type": "thinking", "text": "x"}, {"type": "text", "text": " ```py``` "}, use("Read", path="f", file_path=""), use("Glob"), use("Edit", file_path="e")]),
        line("assistant", [use("Write", file_path="w"), use("Bash", command="c" * 300), use("Task", prompt="p"), {"type": "tool_use"}, {"type": "tool_result", "text": "r"}]),
        line("assistant", [{"type": "text", "text": "  "}]), line("user", [{"type": "text", "text": "last"}], message={"content": "[x] no role"}), line("user", 7),
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "no id.jsonl").write_text(line("user", "alone"))
    (tmp_path / "d" / "other.txt").write_text(line("user", "not a session file"))
    got = {(r.session_id, r.turn_index): (r.speaker, r.content, r.has_code, r.has_tool_use, r.parts, str(r.at)) for r in readers.transcripts(spark, str(tmp_path)).collect()}
    assert got == {
        ("s1", 0): ("user", "[done] please go on\nz second\na third", False, False, 3, "2026-03-01 10:00:01"),
        ("s1", 1): ("assistant", "```py```\n[Tool: Read f]\n[Tool: Glob ]\n[Tool: Edit e]\n[Tool: Write w]\n[Tool: Bash " + "c" * 100 + "]\n[Tool: Task]\n[Tool: unknown]", True, True, 2, "None"),
        ("s1", 2): ("user", "[x] no role\n7", False, False, 2, "None"),
        ("no id", 0): ("user", "alone", False, False, 1, "None"),
    }
    (whole,) = readers.transcript_sessions(spark, str(tmp_path)).collect()
    assert (whole.session_id, whole.workspace, whole.project, str(whole.started_at), str(whole.ended_at), whole.turn_count) == ("s1", "/x/proj/", "proj", "2026-03-01 10:00:09", "2027-01-01 00:00:00", 3)


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(f"line {i} " + "x" * (i % 50) for i in range(20_000)))
    (tmp_path / "b.jsonl").write_text("one\ntwo")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        rows = readers.lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 10
        got = [r.value.split(" ")[1] for r in rows.filter("file like '%a.jsonl'").orderBy("position").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [str(i) for i in range(20_000)]


def test_a_long_turn_is_cut_as_told(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps({"type": "user", "message": {"content": "x" * 30_000}}) for _ in range(2)))
    (r,) = readers.transcripts(spark, str(tmp_path)).collect()
    assert r.content == "x" * 30_000 + "\n" + "x" * 19_999 + "\n[...truncated]" and r.speaker == "user"


def test_files_frontmatter_proxies(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "A.TXT").write_text("same")
    (tmp_path / "b.txt").write_text("same")
    (tmp_path / "c.bin").write_text("no")
    found = readers.files(spark, [str(tmp_path), "/no/such/root"], [".txt"], content=True)
    assert {r.name for r in found.collect()} == {"A.TXT", "b.txt"}
    docs = readers.standalone_documents(found).collect()
    assert len(docs) == 1 and docs[0].message_id.startswith("-") and docs[0].text == "same"
    df = spark.createDataFrame([("---\ntitle: \"A: b\"\nurl: http://x\n# note\n---\nbody\n---\n",), ("plain",)], "t string")
    got = [(r.f.meta, r.f.body) for r in df.select(readers.frontmatter(F.col("t")).alias("f")).collect()]
    assert got == [({"title": "A: b", "url": "http://x"}, "body\n---\n"), ({}, "plain")]
    (tmp_path / "people.json").write_text(json.dumps([{"email": "PA@x", "is_proxy_for_self": True}, {"email": "b@x"}]))
    assert readers.proxies(spark, f"{tmp_path}/people.json") == ["pa@x"] and readers.proxies(spark, "/no/such.json") == []
    assert readers.table(spark, "/no/such", "a long").collect() == []


def test_chat_payloads(spark):
    flat = spark.createDataFrame([("1", "https://x/contacts/8:orgid:7", "Ann", "2026-03-01T10:00:00Z", "a<br>b", "Text")], "id string, from string, imdisplayname string, composetime string, content string, messagetype string")
    r = readers.chat_messages(flat, "c").first()
    assert (r.message_id, r.sender_mri, r.sender_name, r.content_text, r.is_system) == ("c::1", "8:orgid:7", "Ann", "a\nb", False)


def test_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, "m1", "i1", "Inbox"), (2, "m2", None, "Inbox")], "id long, message_id string, internet_message_id string, mailbox_name string")
    new = spark.createDataFrame([(3, "m1", None, "Archive"), (4, "m3", "i1", "Inbox"), (5, "m4", None, "Inbox"), (6, "m4", None, "Sent"), (7, "m5", "i5", "x"), (8, "m6", "i5", "x")], old.schema)
    assert {r.id for r in writes.insert_absent(old, new, ["message_id", "internet_message_id"], "id").collect()} == {1, 2, 5, 7}
    assert {r.id: r.mailbox_name for r in writes.move_mailboxes(old, new).collect()} == {1: "Archive", 2: "Inbox"}
    held = SnapshotTable(spark, f"{tmp_path}/t", ["message_id"])
    held.replace(old)
    held.rewrite(lambda rows: writes.upsert(rows, new, "message_id", "id"))
    assert {r.message_id: r.id for r in readers.table(spark, f"{tmp_path}/t").collect()} == {"m1": 3, "m2": 2, "m3": 4, "m4": 6, "m5": 7, "m6": 8}
    flags = spark.createDataFrame([("a", 1, True), ("b", 1, None)], "sha string, w int, o boolean")
    again = spark.createDataFrame([("a", 2, None), ("c", 3, None)], flags.schema)
    assert {tuple(r) for r in writes.keep_flags(flags, again, "sha", "o").collect()} == {("a", 2, True), ("b", 1, None), ("c", 3, False)}
    writes.write_batches(old.coalesce(1), f"{tmp_path}/b", 1)
    assert len(list((tmp_path / "b").glob("*.json"))) == 2


def test_streams(spark, tmp_path):
    src, target, schema = tmp_path / "in", f"{tmp_path}/out", "id long, v string, n long"
    src.mkdir()
    for k, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(1, "c", 2)], [(1, "c", 2)]]):
        (src / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("id", "v", "n"), r))) for r in rows))
        incremental.upsert_stream(incremental.stream_files(spark, str(src), schema), target, "id", "n", f"{tmp_path}/cp").awaitTermination()
        assert {r.id: r.v for r in SnapshotTable(spark, target, ["id"], "n").read().collect()} == ({1: "a", 2: "b"} if k == 0 else {1: "c", 2: "b"})
    assert incremental.guard_cursor(5, 100, True) and not incremental.guard_cursor(100, 100, True) and not incremental.guard_cursor(0, 100, False)


def test_session_stream_equals_batch(spark, tmp_path):
    from mnemora.operators import windows as W

    src = tmp_path / "ev"
    base = datetime.datetime(2026, 3, 1)
    rows = [(c, base + datetime.timedelta(hours=h), w) for c in (1, 2) for h, w in ((0, "a"), (7.9, "b"), (20, "a"), (200, "z"))]
    spark.createDataFrame(rows, "chat long, at timestamp, who string").write.parquet(str(src))
    stream = incremental.session_stream(spark.readStream.schema("chat long, at timestamp, who string").parquet(str(src)), "chat", "at", "who")
    stream.writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination()
    got = {(r.chat, r.started_at, r.ended_at, r.messages, r.participants) for r in spark.table("sess").collect()}
    df = W.sessions(spark.read.parquet(str(src)), "chat", "at", ["who"])
    whole = {(r.chat, r.started_at, r.ended_at, r.messages, r.participants) for r in W.session_summary(df, "chat", "at", "who").collect()}
    # the newest sessions are still open
    assert got == {x for x in whole if x[1] < base + datetime.timedelta(hours=100)}
