"""Messages as trees, against the standard library's own reader."""

import email
from email import policy
from email.message import EmailMessage

from pyspark.sql import functions as F

from mnemora.functions import mime


def letters():
    one = EmailMessage()
    one["Subject"], one["From"], one["Date"] = "Grüße – Καλημέρα and a long line " * 6, "Zoë <z@x.example>", "Mon, 1 Jan 2024 10:00:00 +0000"
    one.set_content("plain ünï = = text\nwith =41 and a very long line " + "x" * 300 + "\n")
    one.add_alternative("<p>html &amp; more</p>", subtype="html")
    one.add_attachment(bytes(range(256)) * 5, maintype="application", subtype="octet-stream", filename="naïve file.bin")
    two = EmailMessage()
    two["Subject"] = "forward"
    two.set_content("outer", cte="base64")
    two.add_attachment(one)
    three = EmailMessage()
    three["subject"] = "html only"
    three.set_content("<b>bold</b>", subtype="html")
    return [m.as_bytes(policy=policy.SMTP) for m in (one, two, three)] + [m.as_bytes() for m in (one, two, three)]


def leaves(message):
    out = []

    def walk(part, path):
        if part.is_multipart():
            for i, below in enumerate(part.get_payload()):
                walk(below, [*path, i + 1])
        else:
            out.append((path, part.get_content_type(), part.get_filename() or "", part.get_content_disposition() or "", part.get_payload(decode=True)))

    walk(message, [])
    return out


def test_trees_are_those_of_the_library(spark):
    raw = letters()
    df = spark.createDataFrame(list(enumerate(raw)), "id int, content binary")
    got = {}
    for r in mime.mime_parts(df, "id", "content").collect():
        got.setdefault(r.id, []).append((r.path, r.type, r.filename, r.disposition, bytes(r.body)))
    for i, data in enumerate(raw):
        want = leaves(email.message_from_bytes(data, policy=policy.default))
        clean = lambda found: sorted((p, t, f, d, b.rstrip(b"\r\n")) for p, t, f, d, b in found)
        assert clean(got[i]) == clean(want), i


def test_texts(spark):
    df = spark.createDataFrame(list(enumerate(letters())) + [(9, None), (10, b"no header at all"), (11, b"\nonly a body"), (12, b"Content-Type: multipart/mixed; boundary=b\n\nlead\n--b\n\nfirst\n--bb\n--b\nContent-Type: text/html\n\n<i>x</i>"), (13, b"Content-Type: multipart/mixed\n\nno boundary")], "id int, content binary")
    got = {r.id: r.text for r in mime.message_texts(df, "id", "content").collect()}
    assert got[0] == got[3].replace("\n", "\r\n").replace("\r\n", "\n") or got[0].replace("\r\n", "\n") == got[3]
    assert got[3].startswith("Subject: " + ("Grüße – Καλημέρα and a long line " * 6).strip()) and "From: Zoë <z@x.example>" in got[3] and "plain ünï = = text\nwith =41" in got[3]
    assert got[4].rstrip() == "Subject: forward\nFrom: N/A\nDate: N/A\n\nouter" and got[5].rstrip().endswith("\n\nbold")
    assert 9 not in got and got[11].endswith("\nonly a body") and got[12].endswith("\nfirst\n--bb")


def test_character_sets(spark):
    rows = [(0, "Ελλάδα".encode("cp1253"), "windows-1253"), (1, "Ελλάδα".encode(), "x-unknown"), (2, "é".encode("latin-1"), None), (3, b"", None), (4, "Ελ".encode(), None)]
    df = spark.createDataFrame(rows, "id int, b binary, c string")
    got = [r.t for r in df.select("id", mime.decoded(F.col("b"), F.col("c")).alias("t")).orderBy("id").collect()]
    assert got == ["Ελλάδα", "Ελλάδα", "é", "", "Ελ"]
    words = ["=?utf-8?Q?Gr=C3=BC=C3=9Fe_a?= =?UTF-8?b?zrE=?= end", "plain", "=?iso-8859-1?q?=E9?=,x", "=?utf-8?Q?broken", None]
    df = spark.createDataFrame(list(enumerate(words)), "id int, w string")
    assert [r.t for r in df.select("id", mime.header_text(F.col("w")).alias("t")).orderBy("id").collect()] == ["Grüße aα end", "plain", "é,x", "=?utf-8?Q?broken", None]


def test_bytes_in_runs_and_steps_are_cut_once(spark):
    """Bodies of many encoded bytes: as many pieces as runs, and no step of a part's reading is in the plan more than a few times."""
    rows = [(0, "=E2=82=AC" * 20000), (1, "a=3Db=" + "=C3=A9=" * 3 + "=zz=4"), (2, "=" * 5000), (3, "")]
    df = spark.createDataFrame(rows, "id int, q string")
    got = {r.id: bytes(r.b) for r in df.select("id", mime._unquoted(F.col("q")).alias("b")).collect()}
    assert got == {0: "€".encode() * 20000, 1: b"a=b=" + "é=".encode() * 3 + b"=zz=4", 2: b"=" * 5000, 3: b""}
    rows = [(0, "QUJD\r\nREVG\n"), (1, "QU JD*=="), (2, "QQ=="), (3, "QUJDR"), (4, ""), (5, "QQ=\r\n=\r\n"), (6, "QQ==QUJD")]
    df = spark.createDataFrame(rows, "id int, z string")
    got = {r.id: bytes(r.b) for r in df.select("id", mime._unbase64(F.col("z")).alias("b")).collect()}
    assert got == {0: b"ABCDEF", 1: b"ABC", 2: b"A", 3: b"ABC", 4: b"", 5: b"A", 6: bytes([0x41, 0x04, 0x14, 0x24])[:4]}
    letters_ = spark.createDataFrame([(1, b"Subject: x\n\ny")], "id int, content binary").select("id", F.decode("content", "ISO-8859-1").alias("part"))
    plan = mime._read(letters_, F.col("part"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(part") == 1


def test_all_levels_are_read_in_one_pass_and_deeper_ones_too(spark, monkeypatch):
    """Nothing is written between levels; a text is written whole only if it lies deeper than a pass reads."""
    written, stored = [], mime.stored
    monkeypatch.setattr(mime, "stored", lambda df, *args: written.append(stored(df, *args)) or written[-1])
    deep = letters()[1]
    for n in range(6):
        deep = f"Subject: level {n}\r\nContent-Type: multipart/mixed; boundary=b{n}\r\n\r\n--b{n}\r\nContent-Type: message/rfc822\r\n\r\n".encode() + deep + f"\r\n--b{n}--\r\n".encode()
    for raw, passes in (letters()[::2][:2], 1), ([deep], 5):
        written.clear()
        df = spark.createDataFrame(list(enumerate(raw)), "id int, content binary").coalesce(1)
        got = sorted((r.id, *r[1:5], bytes(r.body).rstrip(b"\r\n")) for r in mime.mime_parts(df, "id", "content").select("id", "path", "type", "filename", "disposition", "body").collect())
        assert got == sorted((i, *part[:4], part[4].rstrip(b"\r\n")) for i, data in enumerate(raw) for part in leaves(email.message_from_bytes(data, policy=policy.default)))
        assert len(written) == passes


def test_edges_and_soft_ends_as_the_library_has_them(spark):
    head = b"Content-Type: multipart/mixed; boundary=\"a.b\"\n\n"
    raw = [
        head + b"lead\n--a.b\n\none\r\n--a.b  \r\n\ntwo\r\r\n--a.b--\nbehind\n--a.b\n\nno part\n",
        head + b"--a.b\n\n--axb\n--a.bc\n--a.b-\n--a.b\nX: y\n\nlast, broken off\r",
        head + b"--a.b--\n",
        b"Content-Transfer-Encoding: quoted-printable\n\na =\nb=\r\nc =\r\n\r\nd =3D=\ne",
        b"Content-Transfer-Encoding: quoted-printable\n\na =\nb =E9=\n\n= c=zz",
    ]
    df = spark.createDataFrame(list(enumerate(raw)), "id int, content binary")
    got = {}
    for r in mime.mime_parts(df, "id", "content").collect():
        got.setdefault(r.id, []).append((r.path, bytes(r.body)))
    got = {i: [b for _, b in sorted(parts)] for i, parts in got.items()}
    assert got == {0: [b"one", b"two\r"], 1: [b"--axb\n--a.bc\n--a.b-", b"last, broken off\r"], 3: [b"a bc \r\nd =e"], 4: [b"a b \xe9\n= c=zz"]}


def test_messages_are_built_and_cut_by_several_tasks(spark, tmp_path):
    from mnemora.plans import feeds
    from mnemora.plans.views import Views

    spark.createDataFrame([(n, "é" * n) for n in range(90)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = feeds._letters(Views(spark, str(tmp_path)))
    assert rows.rdd.getNumPartitions() == 16
    for n in (0, 2, 20, 42, 89):
        whole = email.message_from_bytes(bytes(rows.filter(F.col("doc_id") == n).first().content), policy=policy.default)
        assert [b.decode() for *_, b in leaves(whole)] == ["é" * n, "<p>" + "é" * n + "</p>", "é" * n, f"inner {n}"]


def test_texts_come_from_one_reading_of_the_messages(spark):
    """Heads and bodies are of the same pass, and only what is shown is read as a text."""
    df = spark.createDataFrame(list(enumerate(letters()[::2][:2])) + [(8, None), (9, b""), (10, b"Subject: s\nContent-Type: application/x\n\nnot shown")], "id int, content binary")
    texts = mime.message_texts(df, "id", "content")
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation [") == 1
    got = {r.id: r.text for r in texts.collect()}
    assert got[9] == "Subject: N/A\nFrom: N/A\nDate: N/A\n\n" and got[10] == "Subject: s\nFrom: N/A\nDate: N/A\n" and 8 not in got and len(got) == 4
