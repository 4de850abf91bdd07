"""Ranked keyword search: tokens, phrases, BM25, snippets, and sources in order of priority.

A query is split at white space; all its parts must occur. A part may hold several tokens, which must then
follow each other. Texts are lower-cased, accents dropped, tokens are runs of letters and digits.

BM25 has k1 = 1.2, b = 0.75, idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6; a row's length is that of
all columns searched. Scores hold within one search only. Equal scores go by id.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.text import strip_accents

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TOKEN = r"[\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    return strip_accents(F.lower(F.coalesce(text, F.lit(""))))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def query_parts(query: str, phrase: bool = False) -> list[list[str]]:
    """The query's parts as lists of tokens; with phrase, the whole query is one part."""
    plain = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", query.lower()) if unicodedata.category(c) != "Mn"))
    parts = [re.findall(r"[^\W_]+", p) for p in ([plain] if phrase else plain.split())]
    return [p for p in parts if p]


def occurrences(words: Column, part: list[str]) -> Column:
    """How often a part occurs in an array of tokens."""
    if len(part) == 1:
        return F.size(F.filter(words, lambda t: t == part[0]))
    first = F.transform(words, lambda t, i: F.when(t == part[0], i))
    starts = F.filter(first, lambda i: i.isNotNull())
    want = F.array(*map(F.lit, part))
    return F.size(F.filter(starts, lambda i: F.slice(words, i + 1, F.lit(len(part))) == want))


def bm25(rows: DataFrame, key: str, columns: list[str], query: str, limit: int | None = 20, phrase: bool = False) -> DataFrame:
    """key and score of the rows that have all the query's parts in the columns together, best first.

    This reads every text: it is for tables that are searched once or are small. `operators.index` keeps an index
    for all others. A phrase may go from one column into the next here.

    Statistics of the corpus come first, as a single row that is broadcast. Rows without the first token of
    any part are skipped before their text is split into tokens.
    """
    parts = query_parts(query, phrase)
    text = F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in columns))
    base = rows.select(F.col(key).alias("key"), text.alias("text"))
    if not parts:
        return base.filter(F.lit(False)).select(F.col("key").alias(key), F.lit(0.0).alias("score"))
    folded = base.withColumn("text", fold(F.col("text")))
    may = F.lit(False)
    for part in parts:
        may = may | F.col("text").contains(part[0])
    words = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    # a generator's column is computed once for a row, however often it is used behind
    hits = folded.filter(may).select("key", F.explode(F.array(words)).alias("words")).select("key", F.size("words").alias("length"), *(occurrences(F.col("words"), p).alias(f"tf{i}") for i, p in enumerate(parts)))
    lengths = folded.agg(F.count(F.lit(1)).alias("n"), F.avg(F.regexp_count("text", F.lit(TOKEN))).alias("average"))
    found = hits.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(parts))))
    score = F.lit(0.0)
    for i in range(len(parts)):
        idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("average")))
    all_in = F.lit(True)
    for i in range(len(parts)):
        all_in = all_in & (F.col(f"tf{i}") > 0)
    one_row = lengths.join(F.broadcast(found))
    out = hits.filter(all_in).join(F.broadcast(one_row)).select(F.col("key").alias(key), F.round(score, 6).alias("score"))
    return out.orderBy(F.desc("score"), key).limit(limit) if limit is not None else out


def postings(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The index as a table: key, field, term, tf, positions; for many searches of an unchanged store.

    Write it partitioned by a prefix of term, so a search reads its terms only.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), tokens(F.col(c)).alias("words")) for c in columns))).alias("f")
    words = rows.select(key, each).select(key, "f.field", F.posexplode("f.words").alias("position", "term"))
    return words.groupBy(key, "field", "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def search_postings(index: DataFrame, key: str, terms: list[str], field: str | None = None) -> DataFrame:
    """Rows of an index that have all terms, in one field if given, with the sum of their frequencies."""
    own = index.filter(F.col("term").isin(terms)) if field is None else index.filter(F.col("term").isin(terms) & (F.col("field") == field))
    return own.groupBy(key).agg(F.count_distinct("term").alias("found"), F.sum("tf").alias("tf")).filter(F.col("found") == len(set(terms))).drop("found")


def snippet(text: Column, query: str, before: str = "<b>", behind: str = "</b>", size: int = 30) -> Column:
    """The words around the first hit, at most size of them, hits marked, ... where words are left out."""
    want = sorted({t for p in query_parts(query) for t in p})
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    hit = lambda w: F.arrays_overlap(tokens(w), F.array(*map(F.lit, want)))
    first = F.coalesce(F.array_position(F.transform(words, hit), F.lit(True)).cast("int"), F.lit(1))
    start = F.greatest(F.lit(1), F.least(first - size // 4, F.size(words) - size + 1))
    shown = F.transform(F.slice(words, start, F.lit(size)), lambda w: F.when(hit(w), F.concat(F.lit(before), w, F.lit(behind))).otherwise(w))
    return F.concat(F.when(start > 1, "...").otherwise(""), F.array_join(shown, " "), F.when(start + size <= F.size(words), "...").otherwise(""))


def waterfall(sources: list[tuple[str, DataFrame]], key: str, limit: int) -> DataFrame:
    """key, source, place: sources in order of priority, each only for the places that are left.

    Every source is a ranked table (key, rank, …), rank from 1. A source gives its first rows, as many as
    places were left before it; those that an earlier source (or rank) gave are then left out, so fewer than
    limit rows can come back. Only limit rows of each source are ever looked at.
    """
    out = None
    for i, (name, ranked) in enumerate(sources):
        top = ranked.filter(F.col("rank") <= limit).select(key, "rank")
        if out is None:
            mine = top
        else:
            left = out.agg((F.lit(limit) - F.count(F.lit(1))).alias("left"))
            mine = top.join(F.broadcast(left)).filter(F.col("rank") <= F.col("left")).select(key, "rank").join(out.select(key), key, "left_anti")
        mine = mine.groupBy(key).agg(F.min("rank").alias("rank")).select(key, F.lit(i).alias("priority"), F.lit(name).alias("source"), "rank")
        out = mine if out is None else out.unionByName(mine)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("priority", "rank", key))
    return out.withColumn("place", place).select(key, "source", "place")


def ranked(found: DataFrame, key: str) -> DataFrame:
    """A short result of bm25() with ranks from 1."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), key)))
