"""Packing documents into sequences: dominance reduction after Martello and Toth, then best fit.

1. Documents are encoded and cut into pieces of at most `capacity` tokens. A task numbers the pieces that it
   writes, by length.
2. A packing depends on the lengths alone, and there are at most `capacity` of them: their counts, so many
   numbers whatever the input, are the instance. While a set of up to three lengths dominates every other set that
   holds its longest one, as many sequences as there are such sets are fixed and their pieces taken out:
   - the longest alone, if nothing fits beside it;
   - with its longest partner, if the two fill a sequence, or nothing fits beside two of them, or no two others
     that fit are longer together than that partner;
   - with two others that fill it, the longer of them being its longest partner and no length lying between them.
   None of these can cost a sequence. Best fit, longest first, packs the remainder into patterns with counts.
3. The number of a piece among all of its length, from counts by task, gives its place in the patterns. Pieces are
   never gathered by length, so a length that most documents share is no hot spot.

The driver gets the counts of lengths, and the patterns, a few for each length, go to all tasks.

Defined results. A null or empty text has the end mark alone. Repeated rows are packed each. Texts of any length are
encoded whole; only a document longer than a sequence is cut. A null length, or one that is not from 1 to
capacity, is an error. Equal lengths go by the place in the written table. Other columns are not read, whatever
their names. An empty table has no pieces.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemora.llm import bpe
from mnemora.llm._shared import remove, small_batches, written

CAPACITY = 2048
#: The id behind each document.
END_ID = 0
#: A pattern: pairs of length and copies, longest first.
Pattern = tuple[tuple[int, int], ...]


class _Lengths:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int]):
        self.count = {length: n for length, n in counts.items() if n}
        self.sizes = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            del self.sizes[bisect_left(self.sizes, length)]

    def left(self, length: int, but: tuple[int, ...] = ()) -> int:
        return self.count.get(length, 0) - but.count(length)

    def longest(self, room: int, but: tuple[int, ...]) -> int:
        """The longest of at most `room`, those in `but` set aside; 0 if there is none."""
        at = bisect_right(self.sizes, room)
        while at:
            at -= 1
            if self.left(self.sizes[at], but):
                return self.sizes[at]
        return 0

    def fitting(self, room: int, but: tuple[int, ...], most: int) -> int:
        """How many of the shortest fit into room together, counted up to `most`."""
        n = 0
        for length in self.sizes:
            k = min(self.left(length, but), room // length, most - n)
            n, room = n + k, room - k * length
            if n == most or k < self.left(length, but):
                break
        return n

    def best_pair(self, room: int, but: tuple[int, ...]) -> tuple[int, int]:
        """The longer and the shorter of two that together are longest within room; zeros if no two fit."""
        found, high = (0, 0), bisect_right(self.sizes, room)
        for at in range(high):
            short = self.sizes[at]
            if 2 * short > room:
                break
            if self.left(short, but):
                long = self.longest(room - short, (*but, short))
                if long >= short and long + short > sum(found):
                    found = (long, short)
        return found


def _dominating(left: _Lengths, length: int, capacity: int) -> tuple[int, ...]:
    """A set with `length` that dominates every set with it; empty if none of at most three is found."""
    room, own = capacity - length, (length,)
    partner = left.longest(room, own)
    if not partner:
        return own
    if partner == room or left.fitting(room, own, 2) == 1:
        return (length, partner)
    few = left.fitting(room, own, 3) == 2
    long, short = left.best_pair(room, own)
    if few and partner >= long + short:
        return (length, partner)
    between = bisect_left(left.sizes, long) - bisect_right(left.sizes, short)
    if few and long + short == room and long == partner and between <= 0:
        return (length, long, short)
    return ()


def reduce(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Patterns that are fixed, with how often, and the counts that are left."""
    left, fixed, again = _Lengths(counts), [], True
    while again:
        again = False
        for length in sorted(left.count, reverse=True):
            while left.left(length):
                found = _dominating(left, length, capacity)
                if not found:
                    break
                pattern = tuple((x, found.count(x)) for x in sorted(set(found), reverse=True))
                n = min(left.left(x) // k for x, k in pattern)
                for x, k in pattern:
                    left.take(x, n * k)
                fixed.append((pattern, n))
                again = True
    return fixed, left.count


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Best fit of the lengths, longest first, for all pieces of a length at once."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(pattern: Pattern, n: int, room: int) -> None:
        if n:
            if room not in open_:
                rooms.insert(bisect_left(rooms, room), room)
            open_.setdefault(room, []).append((pattern, n))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                pattern, bins, room = (), -(-n // (capacity // length)), capacity
            else:
                room = rooms[at]
                pattern, bins = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            # one sequence is filled before the next one, as its room is the least
            each = room // length
            full = min(bins, n // each)
            put((*pattern, (length, each)), full, room - full // max(full, 1) * each * length)
            n, bins = n - full * each, bins - full
            if bins and n:
                put((*pattern, (length, n)), 1, room - n * length)
                n, bins = 0, bins - 1
            put(pattern, bins, room)
    return [x for room in sorted(open_) for x in open_[room]]


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used, for pieces of these lengths."""
    fixed, rest = reduce(counts, capacity)
    return fixed + best_fit(rest, capacity)


class Places:
    """The sequence and offset of the k-th piece of a length."""

    def __init__(self, plan: list[tuple[Pattern, int]]):
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        first, taken = 0, {}
        for pattern, n in plan:
            offset = 0
            for length, copies in pattern:
                runs.setdefault(length, []).append((taken.get(length, 0), copies, first, offset))
                taken[length] = taken.get(length, 0) + n * copies
                offset += length * copies
            first += n
        self.sequences = first
        self.runs = {length: np.array(x, np.int64) for length, x in runs.items()}

    def of(self, length: int, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        runs = self.runs[length]
        start, copies, first, offset = runs[np.searchsorted(runs[:, 0], nth, "right") - 1].T
        return first + (nth - start) // copies, offset + (nth - start) % copies * length


#: What a text must not have for its words to be those between white space: other than plain letters, marks and spaces.
_ODD = re.compile("[^\t-\r -\x7fÀ-ÖØ-öø-ɏ]")


class _Packer:
    """Texts to their ids as little-endian unsigned 32-bit numbers, with the words and pieces seen of late.

    The text's pieces are those of `bpe`; a piece that is new is encoded by the tokenizers library's model.
    """

    def __init__(self, coder: bpe.BacktrackingBPE, file: bytes):
        self.coder, self.model = coder, Tokenizer.from_str(file.decode()).model
        #: Ids of pieces and of words; a word that is one piece has that piece's.
        self.known: dict[str, bytes] = {}
        # the coder's tables stay: the collector needn't go through them again and again
        gc.collect()
        gc.freeze()

    def _keep(self, text: str, ids: bytes) -> bytes:
        if len(text) <= 64:
            if len(self.known) >= 3 * bpe.CACHE_PIECES:
                self.known.clear()
            self.known[text] = ids
        return ids

    def _new(self, piece: str) -> bytes:
        letters = self.coder.letters
        word = piece if piece.isascii() and piece.isprintable() else "".join([letters[b] for b in piece.encode("utf-8", "surrogatepass")])
        return self._keep(piece, array("I", [x.id for x in self.model.tokenize(word)]).tobytes())

    def _of_pieces(self, pieces: list[str]) -> bytes:
        known = self.known
        return b"".join([known.get(x) or self._new(x) for x in pieces])

    def _of_words(self, words: list[str]) -> bytes:
        """A piece never goes over white space, so the ids of a text are those of its words."""
        found = list(map(self.known.get, words))
        if None in found:
            plain = self.coder.plain
            for at, (word, ids) in enumerate(zip(words, found)):
                if ids is None:
                    found[at] = self._new(word) if word.isalpha() else self._keep(word, self._of_pieces(plain.findall(word)))
        return b"".join(found)

    def ids(self, text: str) -> bytes:
        out = []
        for k, part in enumerate(self.coder.added_split.split(text) if self.coder.added_split else [text]):
            if k % 2:
                out.append(array("I", [self.coder.added[part]]).tobytes())
                continue
            lower = part.lower()
            out.append(self._of_pieces(self.coder.pieces(part)) if _ODD.search(lower) else self._of_words(lower.split()))
        return b"".join(out)


_packers: dict[str, _Packer] = {}


def pieces(docs: DataFrame, vocabulary, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, nth, and if asked for ids, of the pieces of docs (doc_id, text).

    part and nth number a task's pieces of a length. Write the table before it is used: only then do these stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = vocabulary.value
        if path not in _packers:
            _packers[path] = _Packer(bpe._coder(vocabulary), file)
        packer = _packers[path]
        part, seen = TaskContext.get().partitionId(), {}
        end = np.array([END_ID], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *(["ids"] if ids else [])]
        for whole in batches:
            for k in range(0, whole.num_rows, bpe.BATCH_ROWS):
                batch = whole.slice(k, bpe.BATCH_ROWS)
                rows, found = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    raw = packer.ids(text or "") + end
                    for start in range(0, len(raw), 4 * capacity):
                        own = raw[start : start + 4 * capacity]
                        length = len(own) // 4
                        seen[length] = nth = seen.get(length, -1) + 1
                        rows.append((i, start // (4 * capacity), start // 4, length, zlib.crc32(own), part, nth))
                        if ids:
                            found.append(np.frombuffer(own, "<u4").astype(np.int32))
                m = np.array(rows, np.int64).reshape(-1, 7)
                out = [batch.column(0).take(pa.array(m[:, 0])), pa.array(m[:, 1].astype(np.int32)), *(pa.array(m[:, c]) for c in (2, 3, 4)), pa.array(m[:, 5].astype(np.int32)), pa.array(m[:, 6])]
                yield pa.RecordBatch.from_arrays(out + ([pa.array(found, pa.list_(pa.int32()))] if ids else []), names)

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + (", ids array<int>" if ids else "")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (a written table with length, part, nth) with sequence_id and offset instead of part and nth."""
    spark = rows.sparkSession
    used: list[str] = []
    tally = written(rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "tally", used)
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).limit(capacity + 2).collect()}
    if any(x is None or not 1 <= x <= capacity for x in counts):
        raise ValueError(f"a piece's length is not from 1 to {capacity}")
    places = spark.sparkContext.broadcast(Places(patterns(counts, capacity)))
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = written(tally.select("part", "length", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long").alias("before")), "before")
    remove(spark, used)
    numbered = rows.join(before, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before", "part")
    names = [c for c in numbered.columns if c != "nth"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = (np.asarray(batch.column(c), np.int64) for c in ("length", "nth"))
            sequence, offset = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                sequence[at], offset[at] = places.value.of(int(x), nth[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = {f.name: f.dataType.simpleString() for f in numbered.schema}
    return numbered.mapInArrow(place, ", ".join(f"`{c}` {fields[c]}" for c in names) + ", sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, and if asked for ids, of every piece of docs."""
    rows = pack(written(pieces(docs, vocabulary, capacity, ids), "pieces"), capacity)
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if ids else []))


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id, ids, starts: the tokens of each sequence and where its pieces begin, from `packed` with ids."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = rows.groupBy("sequence_id").agg(own.alias("own"))
    return whole.select("sequence_id", F.flatten(F.col("own.ids")).alias("ids"), F.col("own.offset").alias("starts"))
