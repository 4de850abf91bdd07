"""Language ID by prediction by partial matching (PPM) with frozen statistics.

Each language has a tree of byte contexts up to max_order bytes, with counts of the bytes that followed.
A byte's code length is taken in the longest context that the language knows: -log2(count / (n + d)) if the
byte was seen there, where n is the context's total and d its number of different bytes; else the cost of an
escape, -log2(d / (n + d)), and the same in the next shorter context; after the empty context, 8 bits. A
text's score in a language is the sum over all its bytes; the statistics do not change while coding, nor are
bytes excluded after an escape. The shortest code wins. A text is coded in lower case, each ASCII byte that
is no letter as a space.

The trees of all languages share one table of byte strings, so that a text is coded by array lookups: the
known string of n + 1 bytes that ends at a place follows from the one of n bytes before it and the byte. For
contexts of up to DENSE bytes that step is a plain table of all contexts and bytes; for longer ones, of which
few are followed by many bytes, a hash table of the strings that occur, so it grows with these alone.

What is bounded: the sample of labelled documents that the trees are learnt from (docs_per_language whole
texts, chosen by a hash of doc_id). Every string of the sample is kept, and every document is coded whole.

Defined results of a prediction are in `predict`, of a sample in `learn`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm._shared import small_batches

#: Bytes that are coded together; longer texts are coded in several pieces, each with its left context.
CHUNK = 1 << 18
UNKNOWN = "und"
#: Longest contexts whose steps are a plain table: at most 256 ** 3 entries.
DENSE = 2
#: Longest contexts there can be: a string is one byte longer and kept as a number of 64 bits.
MOST_ORDER = 6


def byte_classes() -> np.ndarray:
    """Maps a byte of a lower-cased text to the byte that is coded."""
    out = np.arange(256, dtype=np.uint8)
    ascii_ = out < 128
    out[ascii_ & ~((out >= 97) & (out <= 122))] = 32
    return out


_CODED = byte_classes()


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.string())).cast(pa.large_binary())


def held_out(doc_id) -> F.Column:
    """crc32(doc_id as text) mod 5 is 0; a row without an id is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


class Steps:
    """(string of k bytes, symbol) to string of k + 1 bytes, 0 if unknown, in an open-addressing hash table."""

    def __init__(self, before: np.ndarray, symbol: np.ndarray, symbols: int):
        self.symbols = symbols
        keys = before.astype(np.int64) * symbols + symbol
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):  # each round, the first of those that want an empty slot gets it
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.keys[slot[own]] = keys[left[own]]
            self.values[slot[own]] = left[own] + 1
            rest = np.ones(len(left), bool)
            rest[own] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        keys = at[0].astype(np.int64) * self.symbols + at[1]
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], 0)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot_left = slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot_left]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot_left[hit]]
            left = left[~hit & (found >= 0)]
        return out.astype(np.int32, copy=False)


class Trees:
    """The context trees of all languages as lookup tables. Built on the driver from bounded counts."""

    def __init__(self, languages: list[str], counts: list[tuple[int, int, int, int]], max_order: int):
        """counts: (language number, length, string as a number, how often). Every string's beginning occurs too."""
        if not 0 <= max_order <= MOST_ORDER:
            raise ValueError(f"max_order is from 0 to {MOST_ORDER}")
        self.languages, self.max_order = languages, max_order
        L = len(languages)
        table = np.array(counts, np.int64).reshape(-1, 4)
        seen = np.unique(table[table[:, 1] == 1][:, 2])
        #: Byte to symbol; 0 stands for every byte that no tree knows.
        self.symbol = np.zeros(256, np.int32)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        A = self.A = len(seen) + 1
        self.next: list[np.ndarray | Steps] = []  # [k]: (string of k bytes, symbol) to string of k + 1 bytes; 0: unknown
        self.cost: list[np.ndarray] = []  # [k]: code length of the last byte of a string of k + 1 bytes
        self.escape: list[np.ndarray] = []  # [k]: cost of leaving a context of k bytes
        known = np.zeros(1, np.int64)  # strings of k bytes in order, numbered from 1; the empty one to begin with
        for k in range(max_order + 1):
            own = table[table[:, 1] == k + 1]
            names, where = np.unique(own[:, 2], return_inverse=True)
            before = np.searchsorted(known, names >> 8) + 1 if k else np.ones(len(names), np.int64)
            symbol = self.symbol[names & 255]
            if k <= DENSE:
                step = np.zeros((len(known) + 1, A), np.int32)
                step[before, symbol] = np.arange(1, len(names) + 1)
            else:
                step = Steps(before, symbol, A)
            count = np.zeros((len(names) + 1, L))
            np.add.at(count, (where + 1, own[:, 0]), own[:, 3])
            n = np.zeros((len(known) + 1, L))
            d = np.zeros((len(known) + 1, L))
            np.add.at(n, before, count[1:])
            np.add.at(d, before, count[1:] > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(n > 0, -np.log2(d / (n + d)), 0)
                own_cost = -np.log2(count[1:] / (n + d)[before])
            self.next.append(step)
            self.escape.append(escape.astype(np.float32))
            # what the byte costs in the contexts that are one byte shorter and less
            lower = self._of_strings(names, k)
            cost = np.zeros((len(names) + 1, L), np.float32)
            cost[1:] = np.where(count[1:] > 0, own_cost, escape[before] + lower)
            self.cost.append(cost)
            known = names

    def _of_strings(self, names: np.ndarray, k: int) -> np.ndarray:
        """Code length of the last byte of strings of k + 1 bytes, with contexts of k - 1 bytes at most."""
        if k == 0 or not len(names):
            return np.full((len(names), len(self.languages)), 8.0, np.float32)
        letters = np.stack([(names >> (8 * (k - i))) & 255 for i in range(k + 1)], 1)[:, 1:]
        flat = self.symbol[letters.reshape(-1)]
        starts = np.arange(0, len(flat), k)
        return self.code(flat, starts, upto=k - 1)[k - 1 :: k]

    def code(self, symbols: np.ndarray, starts: np.ndarray, upto: int | None = None) -> np.ndarray:
        """Code length of each symbol in each language. starts: where texts begin; contexts don't cross these."""
        upto = self.max_order if upto is None else upto
        n = len(symbols)
        ctx = np.ones(n, np.int32)  # the empty context is known everywhere
        contexts, found = [], []
        for k in range(upto + 1):
            string = self.next[k][ctx, symbols]
            contexts.append(ctx)
            found.append(string)
            if k < upto:
                ctx = np.empty(n, np.int32)
                ctx[1:] = string[:-1]
                ctx[0] = 0
                ctx[starts] = 0
        out = np.empty((n, len(self.languages)), np.float32)
        longest = np.full(n, -1, np.int8)
        for k, string in enumerate(found):
            longest[string > 0] = k
        for k in range(-1, upto + 1):
            at = np.flatnonzero(longest == k)
            if len(at):
                cost = self.cost[k][found[k][at]] if k >= 0 else np.full((len(at), len(self.languages)), 8.0, np.float32)
                for j in range(k + 1, upto + 1):
                    cost = cost + self.escape[j][contexts[j][at]]
                out[at] = cost
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text data[offsets[i]:offsets[i + 1]] (lower-cased bytes) by language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        data = self.symbol[_CODED[data]]
        row = 0
        while row < len(offsets) - 1:
            stop = row + 1
            while stop < len(offsets) - 1 and offsets[stop + 1] - offsets[row] <= CHUNK:
                stop += 1
            base, end = offsets[row], offsets[stop]
            if end - base <= CHUNK:
                some = np.flatnonzero(offsets[row + 1 : stop + 1] > offsets[row:stop]) + row
                if len(some):
                    cost = self.code(data[base:end], offsets[some] - base)
                    out[some] = np.add.reduceat(cost, offsets[some] - base, axis=0, dtype=np.float64)
            else:  # one long text
                for at in range(base, end, CHUNK):
                    left = max(base, at - self.max_order)
                    out[row] += self.code(data[left : min(end, at + CHUNK)], np.zeros(1, np.int64))[at - left :].sum(0, dtype=np.float64)
            row = stop
        return out


def learn(docs: DataFrame, docs_per_language: int = 400, max_order: int = 4) -> Trees:
    """Trees from the rows of docs (doc_id, text, lang) that aren't held out and have a language and a text.

    About docs_per_language whole documents of each language are read, or all if it has fewer; what comes to
    the driver are the counts of the different strings in these. Rows that repeat count each. Nothing is learnt
    from an empty table.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    have = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(have)
    if not languages:
        return Trees([], [], max_order)
    scale = 1 << 20
    share = F.create_map(*(F.lit(x) for l in languages for x in (l, min(scale, scale * docs_per_language // have[l] + 1))))
    number = F.create_map(*(F.lit(x) for i, l in enumerate(languages) for x in (l, i)))
    picked = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_numpy()
            texts = _lower(batch.column(0)).to_pylist()
            for lang in np.unique(langs):
                own = [_CODED[np.frombuffer(t, np.uint8)].astype(np.int64) for t, l in zip(texts, langs) if l == lang]
                string = [np.zeros(len(x), np.int64) for x in own]
                for k in range(max_order + 1):
                    string = [(s[:-1] if k else s) << 8 | x[k:] for s, x in zip(string, own)]
                    names, n = np.unique(np.concatenate(string), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), lang, np.int32)), pa.array(np.full(len(n), k + 1, np.int32)), pa.array(names), pa.array(n.astype(np.int64))], ["lang", "size", "string", "n"])

    counts = picked.select("text", number[F.col("lang")].cast("int").alias("lang")).mapInArrow(count, "lang int, size int, string long, n long")
    found = counts.groupBy("lang", "size", "string").agg(F.sum("n").alias("n")).toArrow()
    return Trees(languages, np.stack([found.column(c).to_numpy().astype(np.int64) for c in range(4)], 1) if found.num_rows else [], max_order)


def predict(docs: DataFrame, trees: Trees, carry: list[str] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every row of docs, and its columns named in carry.

    lang_pred is the language of the shortest code (the first by name of equal ones), or "und" with score 0
    if the text is null or has no letter or no language was learnt. score is that language's probability
    if the code lengths are taken as log-likelihoods and languages as equally likely.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(trees)
    kind = dict(docs.dtypes)
    names = [f"__carry_{i}" for i in range(len(carry))]
    text = F.col("text").cast("string")
    rows = docs.select(text.alias("__text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letters"), F.col("doc_id").alias("__id"), *(F.col(c).alias(n) for c, n in zip(carry, names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        languages = np.array([*trees.languages, UNKNOWN], object)
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                text = pc.fill_null(_lower(batch.column(0)), b"")
                offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                best, score, rate = np.full(len(text), -1), np.zeros(len(text)), np.zeros(len(text))
                if trees.languages:
                    bits = trees.bits(data, offsets - offsets[0])
                    best = bits.argmin(1)
                    least = bits.min(1)
                    score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                    rate = least / np.maximum(np.diff(offsets), 1)
                none = ~batch.column(1).to_numpy(zero_copy_only=False) | (best < 0)
                best, score, rate = np.where(none, -1, best), np.where(none, 0, score), np.where(none, 0, rate)
                yield pa.RecordBatch.from_arrays([pa.array(languages[best], pa.string()), pa.array(score), pa.array(rate), *batch.columns[2:]], ["lang_pred", "score", "bits_per_byte", "__id", *names])

    schema = f"lang_pred string, score double, bits_per_byte double, __id {kind['doc_id']}" + "".join(f", {n} {kind[c]}" for c, n in zip(carry, names))
    out = rows.mapInArrow(run, schema)
    return out.select(F.col("__id").alias("doc_id"), held_out(F.col("__id")).alias("held_out"), "lang_pred", "score", "bits_per_byte", *(F.col(n).alias(c) for c, n in zip(carry, names)))
