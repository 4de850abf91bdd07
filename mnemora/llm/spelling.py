"""Spelling variants: words one edit apart, by two-dimensional range reporting.

1. Tasks count the words of their texts and pass on sums; a word counts over all documents.
2. A word x of length l and one of length l or l - 1 that becomes x by one replaced or inserted code point at i have the
   same first i code points and the same last l - 1 - i. So words meet that agree outside a range [lo, hi) of
   places: at first the two halves of a word. Where more than BUCKET words agree, their range is halved until fewer
   do; words that agree but at one place are as many as there are letters, so this ends.
3. What lands in a task is laid out by length and range: words in forward order, and in order of their reversals; a
   wavelet tree over the permutation between the two. For each place of each word the interval of its prefix in
   forward order and that of its suffix in reverse order are intersected by one walk of the tree for all of them.
   A pair counts at one place only: where the code points differ.
4. Only a word's number of neighbours and its most frequent one leave a task. Forms are followed by pointer
   doubling; as a form is five times as frequent as its word, chains are short.

Defined results. A null or empty text has no words; a null doc_id counts as ''. Repeated rows count each. Words of any
length are compared whole. Of equally frequent neighbours the first in code-point order is the form. Other columns
are not read, whatever their names. An empty table has no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm._shared import remove, small_batches, written

#: Runs of letters, after A-Z were lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Fewest code points and occurrences of a word; how much more frequent a form is; of so many runs one loses a letter.
LEAST_SIZE, LEAST_N, RATIO, SLIPS = 6, 5, 5, 199
#: Words that may agree outside a range before it is halved; distinct words that a task adds up before it passes them on.
BUCKET, HELD_WORDS = 20_000, 200_000


def words(docs: DataFrame, slips: int = SLIPS, least_size: int = LEAST_SIZE, least_n: int = LEAST_N) -> DataFrame:
    """word, n of the words of docs (doc_id, text) that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        held: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not text:
                    continue
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter(RUN.findall(text.encode().lower().decode())).items():  # bytes: only A-Z change
                    h = zlib.crc32(word.encode(), start)
                    if h % slips == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_size:
                        held[word] = held.get(word, 0) + n
            if len(held) >= HELD_WORDS:
                yield sums()
                held = {}
        yield sums()

    small_batches(docs.sparkSession)
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return found.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


class WaveletTree:
    """A permutation of 0..n-1, bit by bit from the highest, as levels with counts of ones."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.ones, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1
            self.ones.append(np.r_[0, np.cumsum(one)])
            self.zeros.append(len(values) - self.ones[-1][-1])
            values = np.concatenate([values[one == 0], values[one == 1]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries of places [a, b) and values [c, d): the number of a query and a value, of all that are there."""
        query, low, high = np.arange(len(a)), a, b
        node = np.zeros(len(a), np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            one_low, one_high = self.ones[level][low], self.ones[level][high]
            query = np.concatenate([query, query])
            node = np.concatenate([node, node + (1 << bit)])
            low, high = np.concatenate([low - one_low, self.zeros[level] + one_low]), np.concatenate([high - one_high, self.zeros[level] + one_high])
            kept = np.flatnonzero((low < high) & (node < d[query]) & (node + (1 << bit) > c[query]))
            query, node, low, high = query[kept], node[kept], low[kept], high[kept]
        return query, node


class _Order:
    """Words in the order of their letters: for a depth, the interval of data words that share a word's first letters."""

    def __init__(self, texts: list[str], letters: np.ndarray, data: np.ndarray):
        order = np.array(sorted(range(len(texts)), key=texts.__getitem__), np.int64)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        differ = letters[order[1:]] != letters[order[:-1]]
        self.common = np.r_[-1, np.where(differ.any(1), differ.argmax(1), letters.shape[1])]
        self.before = np.r_[0, np.cumsum(data[order])]
        #: Of data words, the rank among data words.
        self.rank = self.before[self.place]

    def interval(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last data rank of each word's interval."""
        first = np.flatnonzero(self.common < depth)
        run = (np.cumsum(self.common < depth) - 1)[self.place]
        return self.before[first][run], self.before[np.r_[first[1:], len(self.place)]][run]


def neighbours(texts: list[str], n: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of its neighbours by an edit at low <= place < high, and the best one's index (or -1).

    Texts are distinct and of length size, or size - 1; edits turn any of them into one of length size.
    """
    count, best = np.zeros(len(texts), np.int64), np.full(len(texts), -1, np.int64)
    data = np.array([len(x) == size for x in texts])
    if not data.any():
        return count, best
    letters = np.frombuffer("".join(x.ljust(size, "\0") for x in texts).encode("utf-32-le"), "<u4").reshape(-1, size)
    forward = _Order(texts, letters, data)
    turned = [x[::-1] for x in texts]
    reverse = _Order(turned, np.frombuffer("".join(x.ljust(size, "\0") for x in turned).encode("utf-32-le"), "<u4").reshape(-1, size), data)
    own = np.flatnonzero(data)
    permutation, of_rank = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
    permutation[forward.rank[own]] = reverse.rank[own]
    of_rank[reverse.rank[own]] = own
    tree = WaveletTree(permutation)
    # the larger the better: by frequency, then by the first in code-point order
    worth, by = np.empty(len(texts), np.int64), np.lexsort((-forward.place, n))
    worth[by] = np.arange(len(texts))
    top = np.full(len(texts), -1, np.int64)
    for place in range(low, high):
        a, b = forward.interval(place)
        c, d = reverse.interval(size - 1 - place)
        asked = np.flatnonzero(np.minimum(b - a, d - c) > data)  # a data word meets itself
        for at in range(0, len(asked), 100_000):
            some = asked[at : at + 100_000]
            query, value = tree.report(a[some], b[some], c[some], d[some])
            source, target = some[query], of_rank[value]
            other = letters[source, place] != letters[target, place]
            source, target = source[other], target[other]
            added = ~data[source]  # the longer word has the shorter as a neighbour too
            source, target = np.concatenate([source, target[added]]), np.concatenate([target, source[added]])
            np.add.at(count, source, 1)
            np.maximum.at(top, source, worth[target])
    best[top >= 0] = by[top[top >= 0]]
    return count, best


def _agreeing(rows: DataFrame) -> DataFrame:
    """rows (word, n, size, low, high) with key: what is left of the word outside the range."""
    word, shift = F.col("word"), F.col("size") - F.char_length("word")
    key = F.concat(word.substr(F.lit(1), F.col("low")), F.lit("\0"), word.substr(F.col("high") - shift + 1, F.col("size")))
    return rows.withColumn("key", key)


def _halved(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """rows (word, n, size) once for each half of the range."""
    middle = F.floor((low + high) / 2).cast("int")
    parts = F.array(F.struct(low.alias("low"), middle.alias("high")), F.struct(middle.alias("low"), high.alias("high")))
    return _agreeing(rows.select("word", "n", "size", F.explode(parts).alias("part")).select("word", "n", "size", "part.low", "part.high"))


def near(counts: DataFrame) -> DataFrame:
    """word, n_near, near, near_n: of each word of counts (word, n) that has neighbours, their number and the best one."""
    spark, used = counts.sparkSession, []
    size = F.char_length("word")
    roles = counts.select("word", "n", F.explode(F.array(size, size + 1)).alias("size"))
    rows = written(_halved(roles, F.lit(0), F.col("size")), "agreeing", used)
    group, parts = ["size", "low", "high", "key"], []
    while True:
        # words alone in their bucket have no neighbour there
        met = written(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_met")).filter("n_met > 1"), "buckets", used)
        large = (F.col("n_met") > BUCKET) & (F.col("high") - F.col("low") > 1)
        parts.append(rows.join(met.filter(~large).select(*group), group))
        if met.filter(large).isEmpty():
            break
        rest = rows.join(met.filter(large).select(*group), group)
        rows = written(_halved(rest, F.col("low"), F.col("high")), "agreeing", used)
    ready = parts[0]
    for part in parts[1:]:
        ready = ready.unionByName(part)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [x for x in batches if x.num_rows]
        if not some:
            return
        table = pa.Table.from_batches(some)
        layout = np.column_stack([np.asarray(table.column(c), np.int64) for c in ("size", "low", "high")])
        kinds, kind = np.unique(layout, axis=0, return_inverse=True)
        order = np.argsort(kind.reshape(-1), kind="stable")
        ends = np.r_[0, np.cumsum(np.bincount(kind.reshape(-1), minlength=len(kinds)))]
        for k, (size, low, high) in enumerate(kinds.tolist()):
            own = table.take(pa.array(order[ends[k] : ends[k + 1]]))
            texts, n = own.column("word").to_pylist(), np.asarray(own.column("n"), np.int64)
            count, best = neighbours(texts, n, size, low, high)
            found = np.flatnonzero(count)
            if len(found):
                whole = own.column("word").combine_chunks()
                yield pa.RecordBatch.from_arrays([whole.take(pa.array(found)), pa.array(count[found]), whole.take(pa.array(best[found])), pa.array(n[best[found]])], ["word", "n_near", "near", "near_n"])

    dealt = ready.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *group)
    found = dealt.select("word", "n", "size", "low", "high").mapInArrow(solve, "word string, n_near long, near string, near_n long")
    first = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    out = written(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")), "near")
    remove(spark, used)
    return out.select("word", "n_near", F.col("first.near").alias("near"), (-F.col("first.n")).alias("near_n"))


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of counts (word, n), which is read more than once."""
    spark, used = counts.sparkSession, []
    is_form = F.col("near_n") >= ratio * F.col("n")
    rows = counts.join(near(counts), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")
    )
    rows = written(rows, "forms")
    links = written(rows.filter("form is not null").select("word", F.col("form").alias("root")), "links", used)
    while True:
        next_ = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if links.join(next_, "root", "left_semi").isEmpty():
            break
        links = written(links.join(next_, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "links", used)
    out = written(rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    remove(spark, used)
    return out


def variant_groups(docs: DataFrame) -> DataFrame:
    """`variants` of the words of docs (doc_id, text)."""
    return variants(written(words(docs), "words"))
