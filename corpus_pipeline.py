"""A training corpus from documents, in five stages; each is written as Parquet and read again by the next.

1. language_id: predicts each document's language; rejects texts without letters, with an unsure prediction
   or with so long a code that no known language fits; the prediction becomes lang.
2. line_dedup: of lines found in ten documents or more only the first occurrence stays; a document that has
   no word left goes.
3. near_dedup: of documents that are linked by 5-word shingles at a similarity of 0.8 or more, the one with
   the least doc_id stays.
4. mixing: takes 80 % of the words by weights of domains, languages and sources, no document twice.
5. bpe: token ids, and digests of ids and of the decoded text.

All stages but the last return the columns of documents. ORACLE_SQL is None: SQL expresses neither the
trained prediction nor the tokenizer; tests hold the stages against brute force.

Defined results. Null and empty texts, and those without letters, go in stage 1. A row without a doc_id is a
document of its own: it is linked with nothing and shares in the budget like any other. Rows that share a doc_id
but not the text are one document to near-dedup, which keeps or drops all of them, and are chosen each by itself
in mixing. Of rows equal in doc_id and text one stays after near-dedup; those without a doc_id all stay, and mixing
takes equal ones together or none of them. Ties are as in the operators. Texts of any length are taken whole. Other columns than COLUMNS go in stage 1; an empty
table gives an empty result. A stage's table is removed when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm import bpe, langid, linededup, mixing, neardup
from mnemora.llm._shared import remove, written
from mnemora.llm.queries import domain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE, MOST_BITS = 0.5, 6.0
MIN_DOCS = 10
SHINGLE_WORDS, PERCENT = 5, 80
MIX_PERCENT, MIX_SEED = 80, 20240131
MIX_WEIGHTS = [{"d0": 1, "d1": 1, "d2": 1, "d3": 1}, {"en": 4, "de": 2, "fr": 2, "es": 2}, {}]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.predict(docs, langid.learn(docs), carry=["text", "source", "n_chars"])
    sure = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & (F.col("bits_per_byte") <= MOST_BITS)
    return found.filter(sure).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bitmaps = linededup.keep_bitmaps(docs, MIN_DOCS, keep_first=True)
    kept = linededup.apply_bitmaps(docs, bitmaps, carry=["lang", "source"])
    kept = kept.filter((F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(COLUMNS)
    kept = neardup.near_duplicates(docs, SHINGLE_WORDS, PERCENT).filter("kept and doc_id is not null").select("doc_id")
    named = rows.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(COLUMNS).unionByName(rows.filter("doc_id is null"))


def _text_key() -> dict[str, Column]:
    """Tells rows of one doc_id, or of none, apart by their text."""
    return {"text_hash": F.xxhash64("text"), "text_length": F.length("text")}


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    levels = {"domain": domain(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    budget = F.floor(F.sum("tokens") * MIX_PERCENT / 100)
    # rows without an id have their place in the order by their text: by a common id, they would be in one
    by_text = F.concat(F.lit("text-"), F.xxhash64("text").cast("string"))
    named = docs.select(*COLUMNS, F.col("doc_id").alias("id")).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), by_text))
    taken = mixing.mix(named, levels, MIX_WEIGHTS, budget, 1, MIX_SEED, carry={"id": F.col("id")} | _text_key())
    # equal rows are next to each other in the order; they are taken if all of them fit
    taken = taken.groupBy("id", *_text_key().keys()).agg(F.min("copies").alias("copies")).filter("copies > 0")
    rows = docs.select(*COLUMNS, *(c.alias(f"own_{n}") for n, c in _text_key().items()))
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    for n in _text_key():
        same = same & F.col(f"own_{n}").eqNullSafe(F.col(n))
    return rows.join(taken, same).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.broadcast_vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    return bpe.digests(docs, vocabulary, ids=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("bpe", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents; each but the last is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        now: list[str] = []
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}", now)
        remove(spark, before)
        before = now
    return STAGES[-1][1](spark, docs, sf_dir)
