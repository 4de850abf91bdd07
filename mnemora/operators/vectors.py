"""Vector retrieval and rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.fixed import RRF_K


def unit(v: Column) -> Column:
    """A vector at length 1; one without length stays."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def cosine(a: Column, b: Column) -> Column:
    """JVM-side, for short vectors or few rows."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def cosine_top_k(rows: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """key, similarity (5 places) of the k nearest rows, best first, ties by key.

    Each batch is one matrix product; a task passes on its own k best only, so the final sort is small. Vectors that
    are null, hold a null, or are not as long as the query take no part.
    """
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)
    kind = dict(rows.dtypes)[key]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, len(q))
            norm = np.linalg.norm(m, axis=1)
            sim = np.round(m @ q / np.where(norm == 0, 1, norm), 5)
            found = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sim)], ["key", "similarity"])
            table = pa.Table.from_batches([found] if held is None else [held, found]).sort_by([("similarity", "descending"), ("key", "ascending")])
            held = table.slice(0, k).combine_chunks().to_batches()[0]
        if held is not None:
            yield held

    sound = (F.size(vector) == len(q)) & F.forall(vector, lambda x: x.isNotNull())
    top = rows.filter(sound).select(key, vector).mapInArrow(best, f"key {kind}, similarity double")
    return top.orderBy(F.desc("similarity"), "key").limit(k).select(F.col("key").alias(key), "similarity")


def encode_vector_id(kind: Column, entity: Column) -> Column:
    return F.when(kind == "email", entity).when(kind == "thread", -10_000_000 - entity).when(kind == "conversation", -2_000_000 - entity).otherwise(-entity)


def decode_vector_id(vector_id: Column) -> Column:
    """struct(kind, entity) of a signed vector id."""
    kind = F.when(vector_id > 0, "email").when(vector_id <= -10_000_000, "thread").when(vector_id <= -2_000_000, "conversation").otherwise("attachment")
    entity = F.when(vector_id > 0, vector_id).when(vector_id <= -10_000_000, -vector_id - 10_000_000).when(vector_id <= -2_000_000, -vector_id - 2_000_000).otherwise(-vector_id)
    return F.struct(kind.alias("kind"), entity.alias("entity"))


def fold_to_emails(hits: DataFrame, attachments: DataFrame) -> DataFrame:
    """email_id, similarity: e-mail hits as they are, attachment hits as their e-mail, others left out.

    hits: kind, entity, similarity; attachments: attachment_id, email_id. An e-mail's best hit counts.
    """
    parent = attachments.select(F.col("attachment_id").alias("entity"), F.lit("attachment").alias("kind"), F.col("email_id").alias("parent"))
    whole = hits.filter(F.col("kind").isin("email", "attachment")).join(parent, ["kind", "entity"], "left")
    mail = F.when(F.col("kind") == "email", F.col("entity")).otherwise(F.col("parent"))
    return whole.select(mail.alias("email_id"), "similarity").filter("email_id is not null").groupBy("email_id").agg(F.max("similarity").alias("similarity"))


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """id, score, best: fusion of ranked lists (list, id, rank), rank from 1, best first.

    Each list gives an id 1 / (k + its best rank there); equal sums go by best rank, then id.
    """
    once = lists.groupBy("list", "id").agg(F.min("rank").alias("rank"))
    fused = once.groupBy("id").agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 12).alias("score"), F.min("rank").alias("best"))
    return fused.orderBy(F.desc("score"), "best", "id")


def hybrid(keyword: DataFrame, semantic: DataFrame | None, limit: int, k: int = RRF_K) -> DataFrame:
    """id, score, place, source of fused keyword and semantic lists (id, rank); pools of four times limit.

    Without semantic candidates the keyword list stays as it is. source is semantic only for ids that the
    keyword list lacks.
    """
    pool = 4 * limit
    lists = keyword.filter(F.col("rank") <= pool).select(F.lit("keyword").alias("list"), "id", "rank")
    if semantic is not None:
        lists = lists.unionByName(semantic.filter(F.col("rank") <= pool).select(F.lit("semantic").alias("list"), "id", "rank"))
    top = rrf(lists, k).limit(limit)
    known = keyword.filter(F.col("rank") <= pool).select("id", F.lit("keyword").alias("source"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "best", "id"))
    return top.withColumn("place", place).join(known, "id", "left").select("id", "score", "place", F.coalesce("source", F.lit("semantic")).alias("source"))


def replace_vectors(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with new rows in place of those of the same (kind, entity)."""
    return index.join(new.select("kind", "entity"), ["kind", "entity"], "left_anti").unionByName(new)


def to_embed(rows: DataFrame, index: DataFrame, key: str, kind: str, text: str, ready: Column | None = None) -> DataFrame:
    """Rows with text that the index lacks, if they are ready."""
    own = index.filter(F.col("kind") == kind).select(F.col("entity").alias(key))
    some = F.trim(F.coalesce(F.col(text), F.lit(""))) != ""
    return rows.filter(some & (F.lit(True) if ready is None else ready)).join(own, key, "left_anti")


def to_embed_again(rows: DataFrame, embedded: str = "embedding_at", changed: str = "extracted_at") -> DataFrame:
    """Rows that were extracted and never embedded since."""
    return rows.filter((F.col("extraction_status") == "extracted") & (F.col(embedded).isNull() | (F.col(embedded) < F.col(changed))))
