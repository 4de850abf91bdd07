"""Registered queries over all their rows and whole texts, against SQL without the cuts of their registered SQL."""

import pytest
from pyspark.sql import functions as F

from mnemora.operators import recalls as R
from mnemora.plans import catalog
from mnemora.plans.views import Views
from mnemora.session import reachable
from tests import compare

WHOLE = {
    "repaired_answers": "select user_id as id, 'user ' || user_id as summary, event_type as topic, 'open' as status, 'low' as urgency from events where event_id % 300 <> 200",
    "embed_texts": """
select doc_id, concat_ws(' — ', nullif(concat_ws(' · ', nullif(trim(case when doc_id % 3 = 0 then ' ' else source end), ''), nullif(lang, ''), case when doc_id % 2 = 0 then '2024-01-02' end), ''), nullif(trim(text), '')) as t from documents
""",
    "month_chunks": """
with o as (select o_custkey, min(o_orderdate)::date as since, max(o_orderdate)::date as until from orders group by 1 having min(o_orderdate)::date < max(o_orderdate)::date),
m as (select *, unnest(generate_series(date_trunc('month', since), date_trunc('month', until - 1), interval 1 month))::date as m from o)
select o_custkey, greatest(m, since) as start, least((m + interval 1 month)::date, until) as stop from m
""",
    "slugs": "select doc_id, regexp_replace(left(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '-'), 60), '-+$', '') as slug from documents",
    "speaker_turns": """
with r as (select conv_id, turn, case when turn % 3 = 1 then 'user' else role end as who, text from conversations where role <> 'system'),
c as (select *, case when who = lag(who) over (partition by conv_id order by turn) then 0 else 1 end as ch from r),
n as (select *, sum(ch) over (partition by conv_id order by turn rows unbounded preceding) as run from c)
select conv_id, (run - 1)::bigint as turn_index, min(who) as speaker, min(turn) as first, count(*) as parts, left(string_agg(text, chr(10) order by turn), 50000) as content from n group by conv_id, run
""",
    "order_nulls": "select doc_id, quality from documents left join labels using (doc_id)",
    "preference_recall": "select event_id as fact_id, case event_id % 3 when 0 then '[PREFERENCE] ' else '[TECHNICAL] ' end || event_type as fact from events where event_id % 3 < 2 order by ts desc, event_id limit 40",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole(spark, monkeypatch, name):
    monkeypatch.setattr(compare, "SF_DIR", "/root/testdata/sf0.01")
    reachable(spark)
    got, want = compare.both(spark, name, catalog.QUERIES[name], WHOLE[name])
    assert got == want


def test_preferences_on_a_topic(spark):
    reachable(spark)
    rows = Views(spark, "/root/testdata/sf0.01").table("events").filter("event_id % 3 < 2")
    facts = rows.select(F.col("event_id").alias("fact_id"), F.concat(F.lit("[TECHNICAL] "), "event_type").alias("fact"), F.col("ts").alias("at"))
    got = [r.fact_id for r in R.preferences(facts, "click", 40).collect()]
    all_ = sorted(((r.at, -r.fact_id, r.fact) for r in facts.collect()), reverse=True)
    named = {-i for _, i, fact in all_[:40] if "click" in fact}
    ranked = set(sorted(-i for _, i, fact in all_ if "click" in fact)[:40])  # all score the same, so ids decide
    assert named - ranked and got == [-i for _, i, _ in all_ if -i in named | ranked][:40]


def test_speaker_turns_keep_all_text(spark):
    reachable(spark)
    rows = Views(spark, compare.SF_DIR).table("conversations").filter("role <> 'system'")
    got = catalog.QUERIES["speaker_turns"](spark, compare.SF_DIR)
    n, length = rows.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    # a line break joins each part but a run's first; some run has several parts
    assert got.agg(F.sum("parts"), F.sum(F.length("content") - F.col("parts") + 1), F.max("parts") > 1).first()[:] == (n, length, True)


def test_slugs_of_late_words(spark, tmp_path):
    reachable(spark)
    spark.createDataFrame([(1, "." * 150 + "Late words"), (2, "日" * 100 + " ok")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in catalog.QUERIES["slugs"](spark, str(tmp_path)).collect()} == {(1, "late-words"), (2, "ok")}


def test_order_nulls_ends_in_nulls(spark):
    reachable(spark)
    rows = [tuple(r) for r in catalog.QUERIES["order_nulls"](spark, "/root/testdata/sf0.01").collect()]
    assert rows == sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, -r[0])) and sum(q is None for _, q in rows) == 601
