"""A full-text index in tables: ranked search reads the postings of its terms and never a text.

An index is a folder of segments. A segment has, by term, the rows that hold it with its positions and the
lengths of the row's fields (postings), the rows' lengths (rows), and the keys that the segment replaces or
removes in earlier ones (gone). It counts once its last table (totals: rows and tokens by field of the whole
index as of this segment) is there, so a segment whose writer crashed is as if it had not been begun. There is
one writer at a time.

Postings are dealt by bucket (crc32 of the term) as folders and within these sorted by term and key, in ranges,
so a term that most rows hold is spread over many files and a search reads the row groups of its terms only.

Keys are unique: of rows that repeat a key within one put, an arbitrary one would count, so that is an error.
Null keys are left out. Tokens, queries, scores and order are those of `operators.search`; a phrase lies within
one field.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators.search import B, K1, LEAST_IDF, query_parts, tokens
from mnemora.session import remove

#: Folders of postings in a segment; a segment is merged with those after it if it is under so many times as large.
BUCKETS, GROWTH = 64, 4
#: Postings that one task sorts: so many fit its memory, whatever the size of the index.
SORTED = 400_000


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


class TextIndex:
    """The index at a path over the fields of rows (key, fields). See the module."""

    def __init__(self, spark: SparkSession, path: str, key: str, fields: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.fields, self.buckets = spark, path.rstrip("/"), key, list(fields), buckets

    # ---- segments

    def _segments(self) -> list[int]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = place(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        number = lambda path: int(path.getName().split("-")[1])
        whole = {number(s.getPath().getParent().getParent()) for s in fs.globStatus(place(f"{self.path}/segment-*/totals/_SUCCESS")) or []}
        done = set(whole)
        for s in fs.globStatus(place(f"{self.path}/segment-*/covers-*")) or []:
            segment, first = number(s.getPath().getParent()), number(s.getPath())
            if segment in whole:  # also one that is covered itself covers others
                done -= set(range(first, segment))
        return sorted(done)

    def there(self) -> bool:
        """Whether anything was put into the index and is still there."""
        return bool(self._segments())

    def _table(self, segment: int, name: str) -> DataFrame:
        at = f"{self.path}/segment-{segment}"
        if name != "postings":
            return self.spark.read.parquet(f"{at}/{name}")
        kinds = dict(self._table(segment, "rows").dtypes)
        # with its schema, as it has no file if no row has a token
        return self.spark.read.schema(f"key {kinds['key']}, field string, term string, lengths {kinds['lengths']}, positions array<int>, bucket int").parquet(f"{at}/{name}")

    def _live(self, name: str, segments: list[int], keep=lambda df: df) -> DataFrame | None:
        """The rows of a table of all segments, without those that a later segment replaced or removed."""
        out = None
        for i, segment in enumerate(segments):
            part = keep(self._table(segment, name))
            gone = None
            for later in segments[i + 1 :]:
                more = self._table(later, "gone")
                gone = more if gone is None else gone.unionByName(more)
            part = part if gone is None else part.join(gone.distinct(), "key", "left_anti").select(part.columns)
            out = part if out is None else out.unionByName(part)
        return out

    def _totals(self, rows: DataFrame | None) -> list:
        """Number of rows, then tokens by field."""
        sums = [F.coalesce(F.sum(F.col("lengths")[f]), F.lit(0)).cast("long").alias(f"f{i}") for i, f in enumerate(self.fields)]
        return [0] * (1 + len(sums)) if rows is None else list(rows.agg(F.count(F.lit(1)), *sums).first())

    def _write(self, rows: DataFrame | None, gone: DataFrame | None) -> None:
        known = self._segments()
        segment = known[-1] + 1 if known else 1
        at = f"{self.path}/segment-{segment}"
        if rows is not None:
            # texts are cut into tokens once and a row's postings are made within the row, so only postings are shuffled, once
            rows = rows.filter(F.col(self.key).isNotNull()).select(F.col(self.key).alias("key"), F.explode(F.array(F.struct(*(_sorted(tokens(F.col(f))).alias(f) for f in self.fields)))).alias("words"))
            rows = rows.select("key", F.struct(*(F.size(F.col("words")[f]).alias(f) for f in self.fields)).alias("lengths"), "words")
            each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col("words")[f].alias("words")) for f in self.fields))).alias("f")
            each = rows.select("key", "lengths", each).select("key", "lengths", "f.field", F.explode(F.array(F.struct(F.col("f.words").alias("words"), _starts(F.col("f.words")).alias("starts")))).alias("f"))
            # a posting of no term stands for the row itself
            own = F.when(F.col("field") == self.fields[0], F.array(F.lit(None).cast("struct<term:string,positions:array<int>>"))).otherwise(F.array())
            loose = each.select("key", "lengths", "field", F.explode(F.concat(own, _runs(F.col("f.words"), F.col("f.starts")))).alias("p")).select("key", "field", "p.term", "lengths", "p.positions")
            loose.write.mode("overwrite").parquet(f"{at}/words")
            loose = self.spark.read.schema(loose.schema).parquet(f"{at}/words")
            loose.filter("term is null").select("key", "lengths").write.mode("overwrite").parquet(f"{at}/rows")
            if self._table(segment, "rows").groupBy("key").count().filter("count > 1").limit(1).count():
                raise ValueError(f"{self.path}: a key repeats among the rows put")
            terms = loose.filter("term is not null").withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % self.buckets).cast("int"))
            self._deal(terms, loose.count(), at)
            remove(self.spark, [f"{at}/words"])
            own = self._table(segment, "rows").select("key")
            gone = own if gone is None else gone.unionByName(own)
        else:
            # a segment that only removes has empty tables, of the same columns as the first
            for name in ("rows", "postings"):
                self._table(known[0], name).filter(F.lit(False)).write.mode("overwrite").parquet(f"{at}/{name}")
        gone.filter("key is not null").distinct().write.mode("overwrite").parquet(f"{at}/gone")
        totals = self._totals(self._live("rows", [*known, segment]))
        names = ["n", *(f"f{i}" for i in range(len(self.fields)))]
        self.spark.createDataFrame([tuple(totals)], ", ".join(f"{c} long" for c in names)).coalesce(1).write.mode("overwrite").parquet(f"{at}/totals")

    def _deal(self, postings: DataFrame, most: int, at: str) -> None:
        """Writes postings, at most so many, in ranges that are as many as they need."""
        dealt = postings.repartitionByRange(max(1, -(-most // SORTED)), "bucket", "term", "key").sortWithinPartitions("bucket", "term", "key")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/postings")

    def put(self, rows: DataFrame) -> TextIndex:
        """Adds rows (key, fields); those whose key is there are replaced."""
        self._write(rows, None)
        return self

    def remove(self, keys: DataFrame) -> TextIndex:
        """Takes out the rows of these keys; others stay."""
        if self._segments():
            self._write(None, keys.select(F.col(self.key).alias("key")))
        return self

    def merged(self, path: str) -> TextIndex:
        """The same index as one segment at another path: each later segment costs a search an anti-join."""
        segments, out = self._segments(), TextIndex(self.spark, path, self.key, self.fields, self.buckets)
        if segments:
            at = f"{out.path}/segment-1"
            rows = self._live("rows", segments)
            rows.write.mode("overwrite").parquet(f"{at}/rows")
            self._deal(self._live("postings", segments), sum(self._table(s, "postings").count() for s in segments), at)
            rows.select("key").write.mode("overwrite").parquet(f"{at}/gone")
            self._table(segments[-1], "totals").coalesce(1).write.mode("overwrite").parquet(f"{at}/totals")
        return out

    def _bytes(self, segment: int) -> int:
        place = self.spark._jvm.org.apache.hadoop.fs.Path
        at = place(f"{self.path}/segment-{segment}/postings")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()

    def tidy(self) -> TextIndex:
        """Makes one segment of the oldest one that is under GROWTH times as large as all after it, and of these.

        So segments form a geometric row, and a posting is rewritten a logarithmic number of times. The new segment says
        from which one on it covers others; it counts, and they no longer do, once its last table is there. `forget`
        deletes what is covered.
        """
        segments = self._segments()
        if len(segments) < 2:
            return self
        sizes = [self._bytes(s) for s in segments]
        first = next((i for i in range(len(sizes)) if sizes[i] < GROWTH * sum(sizes[i + 1 :])), len(sizes))
        run = segments[first:]
        if len(run) > 1:
            segment = segments[-1] + 1
            at = f"{self.path}/segment-{segment}"
            self._live("rows", run).write.mode("overwrite").parquet(f"{at}/rows")
            self._deal(self._live("postings", run), sum(self._table(s, "postings").count() for s in run), at)
            reduce(DataFrame.unionByName, [self._table(s, "gone") for s in run]).distinct().write.mode("overwrite").parquet(f"{at}/gone")
            place = self.spark._jvm.org.apache.hadoop.fs.Path
            mark = place(f"{at}/covers-{run[0]}")
            mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(mark, True).close()
            self._table(segments[-1], "totals").coalesce(1).write.mode("overwrite").parquet(f"{at}/totals")
        return self

    def forget(self) -> None:
        """Deletes segments that others cover; a search that began before may still read them."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = place(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        kept = {f"segment-{s}" for s in self._segments()}
        done = fs.globStatus(place(f"{self.path}/segment-*/totals/_SUCCESS")) or []
        remove(self.spark, [f"{self.path}/{n}" for n in (s.getPath().getParent().getParent().getName() for s in done) if n not in kept])

    # ---- search

    def postings(self, terms: list[str], columns: list[str] | None = None) -> DataFrame | None:
        """key, field, term, positions, lengths of the terms; only their buckets and row groups are read."""
        buckets = sorted({bucket_of(t, self.buckets) for t in terms})
        mine = F.col("bucket").isin(buckets) & F.col("term").isin(sorted(set(terms))) & F.col("field").isin(columns or self.fields)
        return self._live("postings", self._segments(), lambda df: df.filter(mine).select("key", "field", "term", "positions", "lengths"))

    def bm25(self, query: str, limit: int | None = 20, phrase: bool = False, columns: list[str] | None = None) -> DataFrame:
        """As search.bm25 over the columns (by default all): key and score, best first."""
        columns = columns or self.fields
        parts, segments = query_parts(query, phrase), self._segments()
        terms = [t for p in parts for t in p]
        kind = dict(self._table(segments[0], "rows").dtypes)["key"] if segments else "long"
        if not terms or not segments:
            return self.spark.createDataFrame([], f"`{self.key}` {kind}, score double")
        totals = self._table(segments[-1], "totals").first()
        n, average = totals["n"], sum(totals[f"f{self.fields.index(c)}"] for c in columns) / max(totals["n"], 1)
        length = sum((F.col("lengths")[c] for c in columns), F.lit(0))
        where = {(c, t): f"p{i}" for i, (c, t) in enumerate((c, t) for c in columns for t in sorted({t for p in parts if len(p) > 1 for t in p}))}
        found = [F.max(length).alias("length")]
        found += [F.max(F.when((F.col("field") == c) & (F.col("term") == t), F.col("positions"))).alias(name) for (c, t), name in where.items()]
        found += [F.sum(F.when(F.col("term") == p[0], F.size("positions")).otherwise(0)).alias(f"tf{i}") for i, p in enumerate(parts) if len(p) == 1]
        hits = self.postings(terms, columns).groupBy("key").agg(*found)
        tf = []
        for i, part in enumerate(parts):
            tf.append(F.col(f"tf{i}") if len(part) == 1 else sum((_follow([F.col(where[c, t]) for t in part]) for c in columns), F.lit(0)))
        hits = hits.select("key", "length", *(t.alias(f"tf{i}") for i, t in enumerate(tf)))
        df = hits.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(parts))))
        score, every = F.lit(0.0), F.lit(True)
        for i in range(len(parts)):
            idf = F.greatest(F.lit(LEAST_IDF), F.log((F.lit(n) - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)))
            tf_i = F.col(f"tf{i}")
            score = score + idf * tf_i * (K1 + 1) / (tf_i + K1 * (1 - B + B * F.col("length") / F.lit(average)))
            every = every & (tf_i > 0)
        out = hits.filter(every).join(F.broadcast(df)).select(F.col("key").alias(self.key), F.round(score, 6).alias("score"))
        return out.orderBy(F.desc("score"), self.key).limit(limit) if limit is not None else out

    def matching(self, query: str, columns: list[str] | None = None) -> DataFrame:
        """The keys that match a query with operators (see parse), in no order.

        One pass over the postings of all its words; only a prefix makes that all buckets.
        """
        columns, segments, tree, leaves = columns or self.fields, self._segments(), parse(query), []

        def number(node: tuple) -> tuple | int:
            if node[0] in ("phrase", "prefix"):
                leaves.append(node)
                return len(leaves) - 1
            return (node[0], number(node[1]), number(node[2]))

        tree = number(tree)
        if not segments:
            return self.spark.createDataFrame([], f"`{self.key}` long")
        words = sorted({t for kind, ts in leaves if kind == "phrase" for t in ts})
        starts = sorted({t for kind, t in leaves if kind == "prefix"})
        wanted = F.col("term").isin(words) if words else F.lit(False)
        wanted = reduce(lambda a, t: a | F.col("term").startswith(t), starts, wanted)
        if not starts:
            wanted = wanted & F.col("bucket").isin(sorted({bucket_of(t, self.buckets) for t in words}))
        wanted = wanted & F.col("field").isin(columns)
        rows = self._live("postings", segments, lambda df: df.filter(wanted).select("key", "field", "term", "positions"))
        long = {(c, t) for kind, ts in leaves if kind == "phrase" and len(ts) > 1 for t in ts for c in columns}
        place = {x: f"p{i}" for i, x in enumerate(sorted(long))}
        found = [F.max(F.when((F.col("field") == c) & (F.col("term") == t), F.col("positions"))).alias(name) for (c, t), name in place.items()]
        for i, (kind, t) in enumerate(leaves):
            if kind == "prefix" or len(t) == 1:
                found.append(F.bool_or(F.col("term").startswith(t) if kind == "prefix" else F.col("term") == t[0]).alias(f"has{i}"))
        hits = rows.groupBy("key").agg(*found)

        def holds(node: tuple | int) -> Column:
            if isinstance(node, int):
                kind, t = leaves[node]
                if kind == "prefix" or len(t) == 1:
                    return F.col(f"has{node}")
                return reduce(lambda a, b: a | b, (_follow([F.col(place[c, x]) for x in t]) > 0 for c in columns))
            left, right = holds(node[1]), holds(node[2])
            return left & right if node[0] == "and" else left | right if node[0] == "or" else left & ~right

        return hits.filter(holds(tree)).select(F.col("key").alias(self.key))


def _sorted(words: Column) -> Column:
    """(term, position) of a text's tokens, by term and position."""
    return F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("position"))))


def _starts(words: Column) -> Column:
    """Where a term begins in _sorted tokens."""
    new = lambda i: (i == 0) | (words[i]["term"] != F.get(words, i - 1)["term"])
    return F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(0), F.size(words) - 1), new)).otherwise(F.array().cast("array<int>"))


def _runs(words: Column, starts: Column) -> Column:
    """(term, positions) of each term of _sorted tokens."""
    run = lambda at, j: F.slice(words, at + 1, F.coalesce(F.get(starts, j + 1), F.size(words)) - at)
    return F.transform(starts, lambda at, j: F.struct(words[at]["term"].alias("term"), F.transform(run(at, j), lambda x: x["position"]).alias("positions")))


def _follow(places: list[Column]) -> Column:
    """How often tokens with these positions follow each other."""
    starts = places[0]
    for j, p in enumerate(places[1:], 1):
        back = F.lit(j)
        starts = F.array_intersect(starts, F.transform(p, lambda x: x - back))  # noqa: B023
    return F.when(starts.isNotNull(), F.size(starts)).otherwise(0)


# ---- queries with operators

_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()])|([^\s()"]+))')


def parse(query: str) -> tuple:
    """A query with AND, OR, NOT (as in `a NOT b`), parentheses, "phrases" and prefixes (word*) as a tree.

    Neighbours without an operator are both wanted. NOT binds closest, then AND, then OR. A tree is
    ("and" | "or" | "not", left, right), ("phrase", tokens), or ("prefix", token). What can't be read is a ValueError.
    """
    words, at = [], 0
    text = query.strip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"a quote without its end: {query}")
        words.append(("phrase", m[1].replace('""', '"')) if m[1] is not None else ("op", m[2]) if m[2] else ("op", m[3]) if m[3] in ("AND", "OR", "NOT") else ("word", m[3]))
        at = m.end()
    words.append(("end", ""))

    def primary() -> tuple:
        kind, value = words.pop(0)
        if (kind, value) == ("op", "("):
            tree = either()
            if words.pop(0) != ("op", ")"):
                raise ValueError(f"a parenthesis without its end: {query}")
            return tree
        if kind not in ("word", "phrase"):
            raise ValueError(f"a word is missing before {value or 'the end'!r}: {query}")
        prefix = kind == "word" and value.endswith("*")
        found = [t for p in query_parts(value, True) for t in p]
        if not found or (prefix and len(found) > 1):
            raise ValueError(f"no word in {value!r}: {query}")
        return ("prefix", found[0]) if prefix else ("phrase", found)

    def chain(name: str, next_: Callable[[], tuple], goes_on: Callable[[], bool]) -> tuple:
        tree = next_()
        while goes_on():
            if words[0] == ("op", name.upper()):
                words.pop(0)
            tree = (name, tree, next_())
        return tree

    def without() -> tuple:
        return chain("not", primary, lambda: words[0] == ("op", "NOT"))

    def both() -> tuple:
        return chain("and", without, lambda: words[0] == ("op", "AND") or words[0][0] in ("word", "phrase") or words[0] == ("op", "("))

    def either() -> tuple:
        return chain("or", both, lambda: words[0] == ("op", "OR"))

    tree = either()
    if words[0][0] != "end":
        raise ValueError(f"unexpected {words[0][1]!r}: {query}")
    return tree
