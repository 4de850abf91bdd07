"""Queries of entity resolution on customers and suppliers, with names made to differ in known ways."""

from pyspark.sql import functions as F

from mnemora.operators import people as P
from mnemora.plans.catalog import query

# people: id; four spellings of one name per group of 4; e-mails for some
_PEOPLE = """
p0 as (select c_custkey as id, c_custkey // 4 as g, c_custkey % 4 as k, c_mktsegment as seg from customer),
people as (select id, case k when 0 then 'Ann Lee' || chr(97 + (g % 26)::int) || chr(97 + (g // 26 % 26)::int) when 1 then 'ANN LEE' || upper(chr(97 + (g % 26)::int) || chr(97 + (g // 26 % 26)::int))
  when 2 then 'Ann  Lee' || chr(97 + (g % 26)::int) || chr(97 + (g // 26 % 26)::int) || ' ' else 'Lee' || chr(97 + (g % 26)::int) || chr(97 + (g // 26 % 26)::int) || ' Ann' end as name,
  case when k = 0 then 'ann' || g || '@corp.example' when k = 1 and g % 3 = 0 then 'ann' || g || '@gmail.com' when k = 3 and g % 5 = 0 then ' ANN' || g || '@corp.example' end as email from p0)
"""


def _people(v):
    c = v.table("customer").select(F.col("c_custkey").alias("id"), F.expr("c_custkey div 4").alias("g"), (F.col("c_custkey") % 4).alias("k"))
    tail = F.concat(F.char(97 + F.col("g") % 26), F.char(97 + F.expr("g div 26") % 26))
    name = F.when(F.col("k") == 0, F.concat(F.lit("Ann Lee"), tail)).when(F.col("k") == 1, F.concat(F.lit("ANN LEE"), F.upper(tail))).when(F.col("k") == 2, F.concat(F.lit("Ann  Lee"), tail, F.lit(" "))).otherwise(F.concat(F.lit("Lee"), tail, F.lit(" Ann")))
    mail = F.when(F.col("k") == 0, F.concat(F.lit("ann"), "g", F.lit("@corp.example"))).when((F.col("k") == 1) & (F.col("g") % 3 == 0), F.concat(F.lit("ann"), "g", F.lit("@gmail.com"))).when((F.col("k") == 3) & (F.col("g") % 5 == 0), F.concat(F.lit(" ANN"), "g", F.lit("@corp.example")))
    return c.select("id", name.alias("name"), mail.alias("email"))


_NORM = "lower(trim(regexp_replace(name, '\\s+', ' ', 'g')))"


@query("people_into_addressed", f"with {_PEOPLE}, n as (select *, {_NORM} as key from people) select a.id as loser, min(b.id) as survivor from n a join n b on a.key = b.key where a.email is null and b.email is not null group by 1")
def people_into_addressed(v):
    return P.into_addressed(_people(v))[1]


@query("people_unaddressed", f"with {_PEOPLE}, n as (select *, {_NORM} as key from people where email is null), s as (select key, min(id) as survivor from n group by 1) select id as loser, survivor from n join s using (key) where id <> survivor")
def people_unaddressed(v):
    return P.unaddressed(_people(v))[1]


@query("people_same_address", f"with {_PEOPLE}, n as (select *, lower(trim(email)) as key from people where email is not null), s as (select key, min(id) as survivor from n group by 1) select id as loser, survivor from n join s using (key) where id <> survivor")
def people_same_address(v):
    return P.same_address(_people(v))[1]


@query("people_other_spelling", f"""
with {_PEOPLE}, n as (select *, array_to_string(list_sort(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda t: length(t) > 1)), ' ') as key from people),
s as (select key, arg_min(id, (email is null)::int * 1000000000 + id) as survivor from n group by 1 having count(distinct lower(trim(email))) <= 1 and count(*) > 1)
select id as loser, survivor from n join s using (key) where id <> survivor
""")
def people_other_spelling(v):
    return P.other_spelling(_people(v))[1]


@query("people_resolved")
def people_resolved(v):
    return P.resolve(_people(v))[1]


@query("canonical_names", f"with {_PEOPLE} select id, array_to_string(list_sort(list_filter(regexp_extract_all(lower(strip_accents(name)), '[a-z0-9]+'), lambda t: length(t) > 1)), ' ') as canon from people")
def canonical_names(v):
    return _people(v).select("id", P.T.canonical_name(F.col("name")).alias("canon"))


@query("fuzzy_blocks", """
with n as (select s_suppkey as id, 'supplier' as surname, 's' || (s_suppkey // 3) as block from supplier)
select a.id as id_a, b.id as id_b from n a join n b on a.block = b.block and a.id < b.id
""")
def fuzzy_blocks(v):
    # names 'Sup x' + a long common surname per three suppliers: one is a subset of none, so ratios decide
    rows = v.table("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("sup"), F.char(97 + (F.col("s_suppkey") % 3).cast("int")), F.lit(" longsurname"), F.expr("s_suppkey div 3")).alias("name"), F.lit(None).cast("string").alias("email"))
    return P.fuzzy_pairs(rows).select("id_a", "id_b")


@query("fuzzy_scores")
def fuzzy_scores(v):
    first = F.element_at(F.array(*map(F.lit, ["nikos", "nikolas", "nick", "niko"])), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rows = v.table("supplier").select(F.col("s_suppkey").alias("id"), F.concat(first, F.lit(" papadopoulos"), F.expr("s_suppkey div 8")).alias("name"), F.lit(None).cast("string").alias("email"))
    return P.fuzzy_pairs(rows)


@query("merged_links", """
with l as (select distinct o_custkey as person_id, o_orderstatus as role, o_orderkey % 50 as email_id from orders)
select distinct email_id, role, person_id // 4 * 4 as person_id from l
""")
def merged_links(v):
    links = v.table("orders").select((F.col("o_orderkey") % 50).alias("email_id"), F.col("o_orderstatus").alias("role"), F.col("o_custkey").alias("person_id"))
    merged = v.table("customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("loser"), F.expr("c_custkey div 4 * 4").alias("survivor"))
    return P.reassign(links, "person_id", merged, ["email_id", "role", "person_id"])


@query("composed_merges", "select c_custkey as loser, c_custkey // 4 * 4 as survivor from customer where c_custkey % 4 <> 0")
def composed_merges(v):
    c = v.table("customer").select(F.col("c_custkey").alias("loser"))
    first = c.filter("loser % 2 = 1").withColumn("survivor", F.col("loser") - 1)
    second = c.filter("loser % 4 = 2").withColumn("survivor", F.col("loser") - 2)
    return P.compose(first, second)


_TOPICS = """t0 as (select p_partkey as id, case p_partkey % 3 when 0 then p_brand || ' ' || p_type when 1 then lower(p_brand) || '-' || p_type else upper(p_brand) || '_' || p_type || '/' end as name from part),
topics as (select *, trim(regexp_replace(regexp_replace(strip_accents(lower(trim(name))), '[-_/.]+', ' ', 'g'), '\\s+', ' ', 'g')) as canon from t0)"""


def _topics(v):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit(" "), "p_type")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lower("p_brand"), F.lit("-"), "p_type")).otherwise(F.concat(F.upper("p_brand"), F.lit("_"), "p_type", F.lit("/")))
    return v.table("part").select(F.col("p_partkey").alias("id"), name.alias("name"), name.alias("display_name"))


@query("topics_normalized", f"with {_TOPICS} select id, canon from topics")
def topics_normalized(v):
    return _topics(v).select("id", P.T.normalize_topic(F.col("name")).alias("canon"))


_RESOLVED = f"""with {_TOPICS}, u as (select l_partkey as id, count(*) as usage from lineitem group by 1), k as (select t.*, coalesce(usage, 0) as usage from topics t left join u using (id)),
g as (select canon, arg_max(id, usage * 1000000000 - id) as survivor, arg_max(name, length(name) * 1000000000 - id) as display_name from k group by 1)
"""


@query("topics_resolved", _RESOLVED + "select survivor as id, canon as name, display_name from g")
def topics_resolved(v):
    return P.resolve_topics(_topics(v), v.table("lineitem").select(F.col("l_partkey").alias("topic_id")))[0]


@query("topics_merged", _RESOLVED + "select id as loser, survivor from k join g using (canon) where id <> survivor")
def topics_merged(v):
    return P.resolve_topics(_topics(v), v.table("lineitem").select(F.col("l_partkey").alias("topic_id")))[1]


@query("topics_upserted", f"""
with {_TOPICS}, o as (select min(id) as id, canon as name, canon as display_name from topics where id < 300 group by canon),
s as (select canon, min(id) as n, arg_min(name, id) as display_name from topics where id >= 300 group by 1), f as (select * from s where canon not in (select name from o))
select * from o union all select (select max(id) from o) + row_number() over (order by n), canon, display_name from f
""")
def topics_upserted(v):
    old = _topics(v).filter("id < 300").groupBy(P.T.normalize_topic(F.col("name")).alias("name")).agg(F.min("id").alias("id")).select("id", "name", F.col("name").alias("display_name"))
    return P.upsert_topics(old, _topics(v).filter("id >= 300").select("name", F.col("id").alias("n")))


@query("people_upserted", """
with o as (select c_custkey as id, c_name as name, 'm' || c_custkey || '@x' as email from customer),
n as (select o_orderkey as n, case when o_custkey % 3 = 0 then 'C' || o_custkey else 'Person number ' || o_custkey || repeat('x', (o_orderkey % 5)::int) end as name, case when o_custkey % 2 = 0 then 'M' || o_custkey * 2 || '@x ' end as email from orders),
m as (select lower(trim(email)) as email, arg_max(name, length(name) * 1000000000 - n) as name, min(n) as n from n where email is not null group by 1),
k as (select id, case when length(m.name) > length(o.name) then m.name else o.name end as name, o.email from o left join m on lower(trim(o.email)) = m.email),
f as (select name, email, n from m where email not in (select email from o)),
e as (select name, null as email, min(n) as n from n where email is null and name not in (select name from o) and name not in (select name from f) group by 1)
select * from k union all select (select max(id) from o) + row_number() over (order by n), name, email from (select * from f union all select * from e)
""")
def people_upserted(v):
    old = v.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("m"), "c_custkey", F.lit("@x")).alias("email"))
    name = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("C"), "o_custkey")).otherwise(F.concat(F.lit("Person number "), "o_custkey", F.repeat(F.lit("x"), (F.col("o_orderkey") % 5).cast("int"))))
    seen = v.table("orders").select(F.col("o_orderkey").alias("n"), name.alias("name"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("M"), F.col("o_custkey") * 2, F.lit("@x "))).alias("email"))
    return P.upsert_people(old, seen)
