"""Queries of ranked search, vectors and fusion."""

from pyspark.sql import functions as F

from mnemora.operators import search, vectors
from mnemora.operators.index import TextIndex
from mnemora.operators.snapshots import SnapshotTable
from mnemora.operators.vectorindex import VectorIndex, hydrated
from mnemora.plans.catalog import query
from mnemora.session import fresh_path, stored

WORDS = "the edition"
_TOK = r"regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\p{{L}}\p{{N}}]+')"


def bm25_sql(table: str, key: str, column: str, terms: list[str], limit: int, name: str = "r", where: str = "true") -> str:
    """CTEs name_d, name_s and name with key, score of the best rows."""
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) as tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) filter (where tf{i} > 0) as df{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(terms)))
    every = " and ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""{name}_t as (select {key}, {_TOK.format(c=column)} as w from {table} where {where}),
{name}_d as (select {key}, len(w) as dl, {tf} from {name}_t),
{name}_s as (select count(*) as n, avg(dl) as av, {df} from {name}_d),
{name} as (select {key}, round({score}, 6) as score from {name}_d, {name}_s where {every} order by score desc, {key} limit {limit})"""


@query("kw_bm25", "with " + bm25_sql("documents", "doc_id", "text", ["the", "ing"], 20) + " select doc_id, score from r")
def kw_bm25(v):
    return v.document_index().bm25("the Ing", 20, columns=["text"])


@query("kw_all_hits", "with " + bm25_sql("documents", "doc_id", "text", ["éau", "de"], 1_000_000).replace("'éau'", "'eau'") + " select doc_id, score from r")
def kw_all_hits(v):
    return v.document_index().bm25("ÉAU de", None, columns=["text"])


@query("kw_phrase", f"""
with t as (select doc_id, {_TOK.format(c='text')} as w from documents),
p as (select doc_id, len(w) as dl, len(list_filter(generate_series(1, len(w) - 1), lambda i: w[i] = 'of' and w[i + 1] = 'the')) as tf from t),
s as (select count(*) as n, avg(dl) as av, count(*) filter (where tf > 0) as df from p)
select doc_id, round(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av)), 6) as score from p, s where tf > 0 order by score desc, doc_id limit 20
""")
def kw_phrase(v):
    return v.document_index().bm25("of the", 20, phrase=True, columns=["text"])


@query("kw_column", "with " + bm25_sql("conversations", "conv_id * 1000 + turn as id", "text", ["the"], 20, where="role = 'assistant'").replace("select conv_id * 1000 + turn as id, len(w)", "select id, len(w)").replace("select conv_id * 1000 + turn as id, round", "select id, round").replace("score desc, conv_id * 1000 + turn as id", "score desc, id") + " select id, score from r")
def kw_column(v):
    return v.turn_index("assistant").bm25("the", 20)


@query("kw_postings", f"""
with p as (select doc_id, unnest({_TOK.format(c='text')}) as term from documents)
select doc_id, count(*) as tf from p where term in ('of', 'and', 'that') group by doc_id having count(distinct term) = 3
""")
def kw_postings(v):
    return search.search_postings(search.postings(v.table("documents"), "doc_id", ["text"]), "doc_id", ["of", "and", "that"], "text")


@query("kw_or_semi", """
select doc_id from documents where contains(lower(text), 'benchmark') or doc_id in (select doc_id from labels where toxic = 1) or doc_id in (select conv_id from conversations where contains(lower(text), 'heing'))
""")
def kw_or_semi(v):
    own = v.table("documents").filter(F.lower("text").contains("benchmark")).select("doc_id")
    toxic = v.table("labels").filter("toxic = 1").select("doc_id")
    said = v.table("conversations").filter(F.lower("text").contains("heing")).select(F.col("conv_id").alias("doc_id"))
    return v.table("documents").join(own.unionByName(toxic).unionByName(said), "doc_id", "left_semi").select("doc_id")


_HIT = f"list_has_any({_TOK.format(c='x')}, ['the', 'ing'])"


@query("kw_snippet", "with " + bm25_sql("documents", "doc_id", "text", ["the", "ing"], 20) + f""",
w as (select doc_id, score, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from r join documents using (doc_id)),
p as (select *, greatest(1, least(coalesce(list_position(list_transform(w, lambda x: {_HIT}), true), 1) - 7, len(w) - 29)) as a from w)
select doc_id, score, case when a > 1 then '...' else '' end || array_to_string(list_transform(w[a : a + 29], lambda x: case when {_HIT} then '<b>' || x || '</b>' else x end), ' ') || case when a + 30 <= len(w) then '...' else '' end as snippet from p
""")
def kw_snippet(v):
    hits = v.document_index().bm25("the ing", 20, columns=["text"])
    return v.table("documents").join(F.broadcast(hits), "doc_id").select("doc_id", "score", search.snippet(F.col("text"), "the ing").alias("snippet"))


_RANKED = "select {k} as id, row_number() over (order by score desc, {k}) as rank from {t}"


@query("kw_waterfall", "with " + bm25_sql("documents", "doc_id", "left(text, 60)", ["the", "of"], 40, "a") + ",\n" + bm25_sql("documents", "doc_id", "text", ["the", "of"], 40, "b") + """,
ra as (select doc_id, row_number() over (order by score desc, doc_id) as rank from a), rb as (select doc_id, row_number() over (order by score desc, doc_id) as rank from b),
s1 as (select doc_id, 'head' as source, 0 as p, rank from ra where rank <= 40),
s2 as (select doc_id, 'body' as source, 1 as p, rank from rb where rank <= 40 - (select count(*) from s1) and doc_id not in (select doc_id from s1)),
s3 as (select doc_id, 'label' as source, 2 as p, rank from (select doc_id, row_number() over (order by doc_id) as rank from labels where toxic = 1) where rank <= 40 - (select count(*) from s1) - (select count(*) from s2)
       and doc_id not in (select doc_id from s1) and doc_id not in (select doc_id from s2))
select doc_id, source, row_number() over (order by p, rank, doc_id)::int as place from (select * from s1 union all select * from s2 union all select * from s3)
""")
def kw_waterfall(v):
    docs = v.document_index()
    head = search.ranked(stored(docs.bm25("the of", 40, columns=["head"]), "head"), "doc_id")
    body = search.ranked(stored(docs.bm25("the of", 40, columns=["text"]), "body"), "doc_id")
    toxic = v.table("labels").filter("toxic = 1").orderBy("doc_id").limit(40).select("doc_id", F.lit(0.0).alias("score"))
    return search.waterfall([("head", head), ("body", body), ("label", search.ranked(toxic, "doc_id"))], "doc_id", 40)


_COS = "round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 5)"


@query("cosine_top_k", f"select vec_id, similarity from (select e.vec_id, {_COS} as similarity from embeddings e, (select embedding from embeddings where vec_id = 7) q) order by similarity desc, vec_id limit 25")
def cosine_top_k(v):
    rows = v.table("embeddings")
    probe = rows.filter("vec_id = 7").select("embedding").first()[0]
    return vectors.cosine_top_k(rows, "vec_id", "embedding", probe, 25)


@query("cosine_threshold", f"select e.vec_id, {_COS} as similarity from embeddings e, (select embedding from embeddings where vec_id = 7) q where {_COS} >= 0.3")
def cosine_threshold(v):
    rows = v.table("embeddings")
    probe = rows.filter("vec_id = 7").select(F.col("embedding").alias("q"))
    return rows.join(F.broadcast(probe)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 5).alias("similarity")).filter("similarity >= 0.3")


@query("unit_vectors", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) as squared, len(embedding)::int as dims from embeddings")
def unit_vectors(v):
    d = F.transform("embedding", lambda x: x.cast("double"))
    back = F.aggregate(F.zip_with(vectors.unit(F.col("embedding")), d, lambda u, x: u * x), F.lit(0.0), lambda a, x: a + x)
    return v.table("embeddings").select("vec_id", F.round(back * back, 6).alias("squared"), F.size("embedding").alias("dims"))


@query("vector_ids", """
with x as (select unnest([doc_id, -doc_id - 1, -2000000 - doc_id, -10000000 - doc_id]) as id, unnest(['email', 'attachment', 'conversation', 'thread']) as kind, unnest([doc_id, doc_id + 1, doc_id, doc_id]) as entity from documents where doc_id > 0)
select id, kind, entity, true as back from x
""")
def vector_ids(v):
    """Signed ids of the documents as mails, attachments, sessions and threads, taken apart and put together again."""
    d = v.table("documents").filter("doc_id > 0")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), (F.col("doc_id") + more).alias("entity")) for k, more in (("email", 0), ("attachment", 1), ("conversation", 0), ("thread", 0))))
    ids = d.select(F.explode(kinds).alias("e")).select(vectors.encode_vector_id(F.col("e.kind"), F.col("e.entity")).alias("id"))
    out = ids.select("id", vectors.decode_vector_id(F.col("id")).alias("x")).select("id", "x.kind", "x.entity")
    return out.withColumn("back", vectors.encode_vector_id(F.col("kind"), F.col("entity")) == F.col("id"))


def _hits(v):
    rows = v.table("embeddings")
    probe = rows.filter("vec_id = 7").select("embedding").first()[0]
    return vectors.cosine_top_k(rows, "vec_id", "embedding", probe, 60)


SEMANTIC = f"""h as (select vec_id, similarity from (select e.vec_id, {_COS} as similarity from embeddings e, (select embedding from embeddings where vec_id = 7) q) order by similarity desc, vec_id limit 60),
f_ as (select case when vec_id % 3 = 0 then vec_id when vec_id % 3 = 1 and vec_id % 2 = 0 then vec_id // 2 end as email_id, similarity from h),
g as (select email_id, max(similarity) as similarity from f_ where email_id is not null group by email_id),
"""


def semantic_mails(v):
    """Mails near a probe: vectors are of mails, attachments and threads; an attachment counts for its mail."""
    kind = F.when(F.col("vec_id") % 3 == 0, "email").when(F.col("vec_id") % 3 == 1, "attachment").otherwise("thread")
    hits = _hits(v).select(kind.alias("kind"), F.col("vec_id").alias("entity"), "similarity")
    attachments = v.table("embeddings").filter("vec_id % 2 = 0").select(F.col("vec_id").alias("attachment_id"), F.expr("vec_id div 2").alias("email_id"))
    return vectors.fold_to_emails(hits, attachments)


@query("semantic_candidates", f"with {SEMANTIC.rstrip().rstrip(',')} select email_id, similarity from g")
def semantic_candidates(v):
    return semantic_mails(v)


_LISTS = "k as (select doc_id as id, row_number() over (order by score desc, doc_id) as rank from r),\ns as (select vec_id as id, row_number() over (order by similarity desc, vec_id) as rank from h)"
_SEM = f"h as (select vec_id, similarity from (select e.vec_id, {_COS} as similarity from embeddings e, (select embedding from embeddings where vec_id = 7) q) order by similarity desc, vec_id limit 60)"


@query("rrf_fusion", "with " + bm25_sql("documents", "doc_id", "text", ["the", "ing"], 40) + f",\n{_SEM},\n{_LISTS}" + """
select id, round(sum(1.0::double / (60 + rank)), 12) as score, min(rank)::int as best from (select * from k union all select * from s) group by id
""")
def rrf_fusion(v):
    kw = search.ranked(v.document_index().bm25("the ing", 40, columns=["text"]), "doc_id").select(F.lit("k").alias("list"), F.col("doc_id").alias("id"), "rank")
    sem = search.ranked(_hits(v).withColumnRenamed("similarity", "score"), "vec_id").select(F.lit("s").alias("list"), F.col("vec_id").alias("id"), "rank")
    return vectors.rrf(kw.unionByName(sem))


@query("hybrid_search", "with " + bm25_sql("documents", "doc_id", "text", ["the", "ing"], 40) + f",\n{_SEM},\n{_LISTS}" + """,
f as (select id, round(sum(1.0::double / (60 + rank)), 12) as score, min(rank) as best from (select * from k where rank <= 40 union all select * from s where rank <= 40) group by id),
t as (select *, row_number() over (order by score desc, best, id)::int as place from f)
select id, score, place, case when id in (select id from k) then 'keyword' else 'semantic' end as source from t where place <= 10
""")
def hybrid_search(v):
    kw = search.ranked(v.document_index().bm25("the ing", 40, columns=["text"]), "doc_id").select(F.col("doc_id").alias("id"), "rank")
    sem = search.ranked(_hits(v).withColumnRenamed("similarity", "score"), "vec_id").select(F.col("vec_id").alias("id"), "rank")
    return vectors.hybrid(kw, sem, 10)


@query("to_embed", "select doc_id from documents where trim(coalesce(text, '')) <> '' and doc_id not in (select vec_id from embeddings where label < 5)")
def to_embed(v):
    index = v.table("embeddings").filter("label < 5").select(F.lit("email").alias("kind"), F.col("vec_id").alias("entity"))
    return vectors.to_embed(v.table("documents"), index, "doc_id", "email", "text").select("doc_id")


@query("replace_vectors", "select 'email' as kind, vec_id as entity, case when vec_id % 10 = 0 then 2 else 1 end as version from embeddings")
def replace_vectors(v):
    index = v.table("embeddings").select(F.lit("email").alias("kind"), F.col("vec_id").alias("entity"), F.lit(1).alias("version"))
    held = SnapshotTable(v.spark, fresh_path(v.spark, "vectors"), ["kind", "entity"])
    held.put(index)
    held.put(index.filter("entity % 10 = 0").withColumn("version", F.lit(2)))
    return held.read()


@query("attachment_search", "with " + bm25_sql("documents", "doc_id", "text", ["on", "shth"], 50) + " select r.doc_id, score, quality from r left join labels l on l.doc_id = r.doc_id")
def attachment_search(v):
    return v.document_index().bm25("on shth", 50, columns=["text"]).join(v.table("labels"), "doc_id", "left").select("doc_id", "score", "quality")


@query("session_search", "with " + bm25_sql("conversations", "conv_id * 1000 + turn as id", "text", ["of", "the"], 60).replace("select conv_id * 1000 + turn as id, len(w)", "select id, len(w)").replace("select conv_id * 1000 + turn as id, round", "select id, round").replace("score desc, conv_id * 1000 + turn as id", "score desc, id") + """,
x as (select id, row_number() over (order by score desc, id) as rank from r)
select id // 1000 as conv_id, min(rank)::int as rank, count(*) as hits from x group by id // 1000
""")
def session_search(v):
    hits = search.ranked(v.turn_index().bm25("of the", 60), "id")
    return hits.groupBy(F.expr("id div 1000").alias("conv_id")).agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("hits"))


@query("index_upkeep", "with " + bm25_sql("u", "id", "text", ["quokka", "the"], 1_000_000).replace("r_t as", "u as (select conv_id * 1000 + turn as id, case when turn % 4 = 0 then 'Quokka ' || text else text end as text from conversations where turn <> 2),\nr_t as") + " select id, score from r")
def index_upkeep(v):
    """An index of all turns of which some are put again with other texts, and some removed; then made one segment."""
    turns = v.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn", "text")
    index = TextIndex(v.spark, fresh_path(v.spark, "index-upkeep"), "id", ["text"], buckets=8).put(turns)
    index.put(turns.filter("turn % 4 = 0").withColumn("text", F.concat(F.lit("Quokka "), "text"))).remove(turns.filter("turn = 2"))
    return index.merged(fresh_path(v.spark, "index-merged")).bm25("quokka the", None)


_KIND = "case vec_id % 4 when 0 then 'email' when 1 then 'attachment' when 2 then 'conversation' else 'thread' end"


@query("semantic_by_kind", f"""
with h as (select vec_id, similarity, row_number() over (order by similarity desc, id) as rank from (select e.vec_id, case vec_id % 4 when 0 then vec_id + 1 when 1 then -vec_id - 1 when 2 then -2000000 - vec_id else -10000000 - vec_id end as id,
  {_COS} as similarity from embeddings e, (select embedding from embeddings where vec_id = 7) q) order by similarity desc, id limit 80),
x as (select *, {_KIND} as type, case when vec_id % 4 < 2 then vec_id + 1 else vec_id end as entity from h),
y as (select doc_id as entity, 'email' as type, 'mail ' || doc_id as title, text as summary, source as date from documents where doc_id % 3 > 0 union all select doc_id, 'attachment', 'file ' || doc_id, lang, null from documents where doc_id % 2 = 0
  union all select distinct conv_id, 'conversation', 'session ' || conv_id, null, null from conversations union all select page_id, 'thread', url, null, null from pages)
select rank::int as rank, type, entity, title, summary, date, similarity from x join y using (type, entity)
""")
def semantic_by_kind(v):
    """The 80 vectors nearest to one, by cells, as mails, attachments, sessions and threads; those that aren't there are left out."""
    e, d = v.table("embeddings"), v.table("documents")
    kind = F.when(F.col("vec_id") % 4 == 0, "email").when(F.col("vec_id") % 4 == 1, "attachment").when(F.col("vec_id") % 4 == 2, "conversation").otherwise("thread")
    entity = F.when(F.col("vec_id") % 4 < 2, F.col("vec_id") + 1).otherwise(F.col("vec_id"))
    rows = e.select(vectors.encode_vector_id(kind, entity).alias("vector_id"), "embedding")
    index = VectorIndex(v.spark, fresh_path(v.spark, "vectors")).build(rows, "embedding")
    none = F.lit(None).cast("string")
    entities = {
        "email": d.filter("doc_id % 3 > 0").select(F.col("doc_id").alias("entity"), F.concat(F.lit("mail "), "doc_id").alias("title"), F.col("text").alias("summary"), F.col("source").alias("date")),
        "attachment": d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("entity"), F.concat(F.lit("file "), "doc_id").alias("title"), F.col("lang").alias("summary"), none.alias("date")),
        "conversation": v.table("conversations").select(F.col("conv_id").alias("entity")).distinct().select("entity", F.concat(F.lit("session "), "entity").alias("title"), none.alias("summary"), none.alias("date")),
        "thread": v.table("pages").select(F.col("page_id").alias("entity"), F.col("url").alias("title"), none.alias("summary"), none.alias("date")),
    }
    probe = e.filter("vec_id = 7").select("embedding").first()[0]
    return hydrated(index.top_k(probe, 80), entities, 80, 5)
