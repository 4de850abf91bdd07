"""What larger tables and executors elsewhere show."""

import html
import unicodedata

from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.operators import lifecycle, selection
from mnemora.plans import catalog
from mnemora.session import dealt
from tests.compare import SF_DIR


def test_articles_of_one_address_have_their_own_tickers(spark):
    rows = spark.createDataFrame([(1, "u", "S", "a"), (2, "u", "S", "b")], "page_id long, url string, source string, content string").withColumn("published_at", F.lit("2024-03-01").cast("timestamp")).withColumn("fetched_at", F.col("published_at"))
    kinds = spark.createDataFrame([("u", "k")], "article_url string, category string")
    found = selection.article_records(rows, kinds, spark.createDataFrame([(2, "T")], "page_id long, ticker string"), "page_id")
    assert sorted(r.content for r in found.collect()) == ["a\nCategories: k\nURL: u", "b\nCategories: k\nTickers: T\nURL: u"]


def test_a_foreign_table_lies_where_executors_see_it(spark):
    df = catalog.QUERIES["foreign_table"](spark, SF_DIR)
    want = spark.read.parquet(f"{SF_DIR}/supplier.parquet").filter("s_acctbal > 100 and s_nationkey < 13").select("s_suppkey", "s_name", "s_acctbal")
    assert sorted(df.collect()) == sorted(want.collect())
    from mnemora.plans import feeds

    class V:
        pass

    v = V()
    v.spark = spark
    assert feeds._foreign(v, want, "supplier").startswith("jdbc:derby:jar:(")


def test_texts_stay_out_of_python(spark):
    letters = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(letters[i : i + 997]) for i in range(0, len(letters), 997)] + ["plain", "", None, "ﬁne ½"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", T.ascii_letters(F.col("t")).alias("x"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    want = {i: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for i, t in enumerate(texts)}
    assert {r.id: r.x for r in df.collect()} == want
    texts = ["&amp;&lt;x&#65;&#x42;&notit;&nosuch; & &", "none", "", None, "&#0;&copy 2&copyx;", "a &" + "b" * 40 + ";", "&eacute;&#128;end", "\n&amp;\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", T.unescape_html(F.col("t")).alias("x"))
    assert {r.id: r.x for r in df.collect()} == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}


def test_a_review_file_is_read_in_parts_and_in_order(spark, tmp_path):
    from mnemora.operators import people as P

    lines = [f'{{"id_a": {(i * 7919) % 5000}, "id_b": {i + 10000}, "decision": "merge"}}' for i in range(5000)]
    (tmp_path / "review.json").write_text("\r\n".join([*lines[:2500], "", "no json", *lines[2500:]]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = P.read_review(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 4
        assert [r.id_b for r in rows.orderBy("n").collect()] == list(range(10000, 15000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_people_of_one_file_are_compared_in_several_tasks(spark, monkeypatch):
    from mnemora.operators import people as P

    dealt, stored = [], P.stored

    def seen(df, *args):
        dealt.append(df.rdd.getNumPartitions())
        return stored(df, *args)

    monkeypatch.setattr(P, "stored", seen)
    rows = spark.createDataFrame([(1, "nikos papadopoulos", None), (2, "nikolas papadopoulos", None), (3, "Νίκος Παπαδόπουλος", None), (4, "", None), (5, None, None)], "id long, name string, email string").coalesce(1)
    assert [(r.id_a, r.id_b) for r in P.fuzzy_pairs(rows).collect()] == [(1, 2), (2, 3)]
    assert dealt and dealt[0] > 1
    dealt.clear()
    assert [tuple(r) for r in P.resolve(rows, cut=seen)[1].collect()] == [(3, 1)]
    assert max(dealt[:2]) > 1


def test_answers_are_not_tried_as_what_they_cannot_be(spark, monkeypatch):
    from mnemora.functions import extraction as X

    tried, loads = [], X.json.loads
    monkeypatch.setattr(X.json, "loads", lambda text, **kw: tried.append(text) or loads(text, **kw))
    assert X.loads('```json\n{"summary": "user 1", "topics": ["a",], "x": ["do it"') == {"summary": "user 1", "topics": ["a"], "x": ["do it"]}
    assert not tried
    assert X.loads('so: {"a": [1], "c": "x\\n') == {"a": [1], "c": "x\n"}
    assert X.loads('{"a": [1, 2,]} and') == {"a": [1, 2]}
    assert X.loads("{}") == {} and X.loads("no") is None and X.loads("} {") == {}


def test_a_payload_is_parsed_once_in_each_spelling(spark):
    from mnemora.sources import readers

    rows = spark.createDataFrame([('{"Id": "1", "Subject": "a"}',), ('{"id": "2", "subject": "b"}',), ("{}",), ("no",), (None,)], "value string")
    df = readers.mail_payloads(rows, "Inbox")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 2
    assert sorted((r.message_id, r.subject) for r in df.collect()) == [("1", "a"), ("2", "b")]


def test_actions_are_dealt_to_many_tasks_before_they_are_sorted(spark):
    rows = spark.range(0, 40000, 1, 4).select((F.col("id") % 30000).alias("email_id"), F.lit("t").alias("task"), F.concat(F.lit("s:"), F.col("id") % 30000 % 7).alias("owner"), F.when(F.col("id") < 30000, F.lit("")).alias("deadline"), "id")
    found = lifecycle.without_repeats(rows).withColumn("task_number", F.spark_partition_id()).collect()
    assert sorted(r.id for r in found) == list(range(30000))
    each = [sum(r.task_number == n for r in found) for n in range(max(r.task_number for r in found) + 1)]
    assert len(each) == 16 and max(each) < 2 * len(found) / 16
    plan = lifecycle.without_repeats(rows).groupBy("email_id", "owner").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan[plan.index("Exchange"):]


def test_tasks_grow_with_the_rows(spark):
    rows = spark.range(1000)
    assert [dealt(rows, "id", total=n, most=100).rdd.getNumPartitions() for n in (0, 1600, 1601, 10000)] == [16, 16, 17, 100]
