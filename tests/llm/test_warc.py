import base64
import gzip
import hashlib

import pyarrow.fs as pafs
from pyspark.sql import functions as F

from mnemora.llm import warc

ROWS = [
    (5, "http://a/5", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "http://a/1\r\nX: y", "<p>één\r\n\r\n🙂</p>"),
    (3, "u", None), (4, "u", ""), (6, "u", "x" * 300_000), (None, "u", "<p>no id</p>"), (7, "http://a/7", "<p>own</p>"), (7, "http://a/7", "<p>own</p>"),
]


def pages(spark):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in ROWS], "page_id long, url string, html string, sha1 string, payload string, first string")


def expected(least_bytes):
    out = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        same = [j for j, _, other in ROWS if (other or "").encode() == data and j is not None]
        first = min(same, default=None)
        revisit = len(data) >= least_bytes and first is not None and i != first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    for least in (0, 5):
        got = warc.round_trip(pages(spark), least).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(least)
        assert all(r.sound for r in got)
        assert {r.url for r in got if r.page_id == 9} == {None} and {r.url for r in got if r.page_id == 1} == {"http://a/1%0D%0AX:%20y"}
    assert warc.round_trip(pages(spark).limit(0)).collect() == []


def test_selected_records_and_archives(spark, monkeypatch):
    folder, index = warc.write(pages(spark).repartition(2))
    got = warc.read(folder, index.filter(F.col("page_id").isin(1, 2, 6))).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {i: html for i, _, html in ROWS if i in (1, 2, 6)}
    assert warc.read(folder, index.filter("page_id = 5"), payloads=False).collect()[0].refers_to == 2
    monkeypatch.setattr(warc, "GAP", 0)
    monkeypatch.setattr(warc, "READ", 1000)
    assert warc.read(folder, index).count() == len(ROWS)
    fs, base = pafs.FileSystem.from_uri(folder)
    files = [x.path for x in fs.get_file_info(pafs.FileSelector(base)) if x.path.endswith(".gz")]
    assert files and sum(gzip.decompress(fs.open_input_file(f).read()).count(b"WARC/1.1\r\n") for f in files) == len(ROWS)


def test_a_broken_payload_is_found():
    member = warc.record(1, "u", b"abc", warc.digest(b"abd"), None)
    assert not warc.parse(member)["sound"]


def test_rows_of_one_id_and_url_are_written_in_one_order(spark):
    rows = [(1, "-", f"<p>{i}</p>") for i in range(40)] + [(1, None, "<p>none</p>"), (1, "", "<p>empty</p>")]
    written = []
    for order in (rows, rows[::-1]):
        folder, index = warc.write(spark.createDataFrame(order, "page_id long, url string, html string").repartition(3))
        fs, base = pafs.FileSystem.from_uri(folder)
        written.append([(x.base_name, fs.open_input_file(x.path).read()) for x in sorted(fs.get_file_info(pafs.FileSelector(base)), key=lambda x: x.path) if x.path.endswith(".gz")])
        got = {(r.url, bytes(r.payload).decode()) for r in warc.read(folder, index).collect()}
        assert got == {(url, html) for _, url, html in rows}
    assert written[0] == written[1]


def test_reading_is_dealt_by_bytes(spark, monkeypatch):
    folder, index = warc.write(pages(spark).repartition(2))
    monkeypatch.setattr(warc, "STRETCH", 500)
    much = index.agg(F.sum("length")).first()[0]
    got = warc.read(folder, index)
    assert got.rdd.getNumPartitions() == much // 500 + 1 > 4 and got.count() == len(ROWS)


def test_ids_that_are_texts(spark):
    ids = ["a", "", "x\r\nWARC-Type: revisit", "<urn:page:a>", "ü %41", None]
    rows = [(i, "u", "same payload") for i in ids]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert set(got) == set(ids) and all(r.sound for r in got.values())
    assert {i: r.refers_to for i, r in got.items()} == {i: None if i == "" else "" for i in ids}


def test_pages_of_one_payload_go_to_several_archives(spark):
    skew = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in skew}
    try:
        for k, v in skew.items():
            spark.conf.set(k, v)
        pages = spark.range(0, 20_000, 1, 8).selectExpr("id as page_id", "concat('http://x/', sha2(cast(id as string), 256)) as url", "case when id % 4 > 0 then 'parked' else concat('page ', id) end as html")
        _, index = warc.write(pages)
        sizes = sorted(r["count"] for r in index.groupBy("archive").count().collect())
        assert sum(sizes) == 20_000 and sizes[-1] <= 4 * sizes[len(sizes) // 2], sizes
        assert index.filter("record_type = 'response'").count() == 5_001
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
