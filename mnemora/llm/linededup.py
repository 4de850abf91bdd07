"""Line dedup over range-partitioned line hashes; its result is a keep bitmap per document, not text.

1. Each document gives one row per distinct line key: the key's 128-bit hash and where it stands.
2. These rows are range-partitioned by (hash, document) and sorted; ranges have about equal rows, so the
   rows of one very common line are spread over as many partitions as they fill.
3. Each partition is streamed once. A run (all rows of a hash) that lies inside the partition is decided at
   once. The first and the last run may go on in a neighbour; of these only a few rows per partition wait.
4. What the partitions say about waiting runs (at most two each) is summed up and decides the waiting rows.
5. The dropped places are gathered by document into a zlib-compressed bitmap of its lines.

A key found in min_docs documents or more loses its lines in every document; with keep_first, its first
occurrence, by document and position, stays. With min_docs 1 and keep_first only first occurrences stay.

Defined results. A document is a distinct (doc_id, text): rows that repeat both count once and are decided
alike; rows that share only the id, or have no id, are documents of their own. A null or empty text is one
empty line. Lines whose key is shorter than min_chars are always kept. Other columns are not read. A
document without a dropped line has no bitmap row, which means: keep all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm._shared import small_batches, written

_SPACES = b" \t\n\x0b\x0c\r"
_DROP, _WAIT, _COUNT = 0, 1, 2
#: Documents whose lines are put together for one output batch.
BATCH_ROWS = 256


def _documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _key_rows(min_chars: int):
    """One row per document and distinct line key, with all of the key's positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(k, BATCH_ROWS)
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                doc, n_lines, hashes, places = [], [], [], []
                for row, text in enumerate(texts):
                    found: dict[bytes, list[int]] = {}
                    at = -1
                    for at, line in enumerate(text.split(b"\n")):
                        key = line.strip(_SPACES).lower()
                        if len(key) >= min_chars and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars):
                            found.setdefault(key, []).append(at)
                    hashes += [xxhash.xxh3_128_digest(x) for x in found]
                    places += found.values()
                    doc += [row] * len(found)
                    n_lines += [at + 1] * len(found)
                two = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
                doc = pa.array(doc, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(two[:, 0]), pa.array(two[:, 1]), batch.column(0).take(doc), batch.column(2).take(doc), pa.array(n_lines, pa.int32()), pa.array(places, pa.list_(pa.int32()))],
                    ["h1", "h2", "doc_id", "text_hash", "n_lines", "places"],
                )

    return run


class _Stream:
    """Decides the runs of one sorted partition as its rows go by; holds fewer than min_docs rows and one."""

    def __init__(self, min_docs: int, keep_first: bool):
        self.min_docs, self.keep_first = min_docs, keep_first
        self.run = None  # the hash of the current run
        self.runs = 0  # runs that began before the current one
        self.n = 0  # documents of the current run
        self.doc = None
        self.first: tuple = ()
        self.held: list[tuple] = []  # further rows of the current run that aren't decided yet
        self.out: list[tuple] = []

    def close(self, at_end: bool) -> None:
        """Ends the current run. The partition's first and last run may have a part elsewhere."""
        if self.run is None:
            return
        if self.runs == 0 or at_end:
            self.out += [(_WAIT, 0, *x) for x in (self.first, *self.held)]
            self.out.append((_COUNT, self.n, *self.run, None, None, 0, []))
        elif self.n >= self.min_docs:
            self.out.append((_DROP, 0, *self.first[:5], self.first[5][self.keep_first :]))
        self.held = []

    def row(self, row: tuple) -> None:
        if row[:2] != self.run:
            self.close(False)
            self.runs += self.run is not None
            self.run, self.n, self.doc = row[:2], 0, None
        if self.n and self.doc == row[2:4]:
            return  # a repeated row of the table
        self.n, self.doc = self.n + 1, row[2:4]
        if self.n == 1:
            self.first = row
        elif self.n < self.min_docs:
            self.held.append(row)
        else:
            self.out += [(_DROP, 0, *x) for x in (*self.held, row)]
            self.held = []


def _decide(min_docs: int, keep_first: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Stream(min_docs, keep_first)

        def flush() -> pa.RecordBatch:
            rows, state.out = state.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                state.row(row)
                if len(state.out) >= 20_000:
                    yield flush()
            if state.out:
                yield flush()
        state.close(True)
        if state.out:
            yield flush()

    return run


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, keep (zlib-compressed bits, 1: keep) per document that loses lines."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    keys = _documents(docs).mapInArrow(_key_rows(max(1, min_chars)), f"h1 long, h2 long, doc_id {kind}, text_hash long, n_lines int, places array<int>")
    order = ["h1", "h2", "doc_id", "text_hash"]
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"kind int, n long, h1 long, h2 long, doc_id {kind}, text_hash long, n_lines int, places array<int>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    staged = written(ranged.mapInArrow(_decide(min_docs, keep_first, arrow), schema), "line-decisions")
    waiting = staged.filter(F.col("kind") == _WAIT)
    # at most two runs of each partition, with min_docs rows each at most, wait
    mine = F.struct("doc_id", "text_hash")
    runs = staged.filter(F.col("kind") != _DROP).groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.min(F.when(F.col("kind") == _WAIT, mine)).alias("first"))
    late = waiting.join(runs.filter(F.col("total") >= min_docs).select("h1", "h2", "first"), ["h1", "h2"])
    if keep_first:
        late = late.withColumn("places", F.when(mine == F.col("first"), F.slice("places", F.lit(2), F.size("places"))).otherwise(F.col("places")))
    columns = ["doc_id", "text_hash", "n_lines", "places"]
    drops = staged.filter(F.col("kind") == _DROP).select(columns).unionByName(late.select(columns)).filter(F.size("places") > 0)
    by_doc = drops.groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("places")).alias("places"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, bits, dropped = batch.column(2).to_pylist(), [], []
            for n, places in zip(lines, batch.column(3).to_pylist()):
                keep = np.ones(n, np.uint8)
                keep[places] = 0
                bits.append(zlib.compress(np.packbits(keep).tobytes()))
                dropped.append(len(places))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(dropped, pa.int32()), pa.array(bits, pa.binary())], ["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])

    return by_doc.mapInArrow(pack, f"doc_id {kind}, text_hash long, n_lines int, n_dropped int, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, carry: list[str] = ()) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped of every row of docs, and the columns of docs named in carry."""
    kind = dict(docs.dtypes)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("__text"), F.xxhash64(text).alias("__hash"), *(F.col(c).alias(f"__carry_{i}") for i, c in enumerate(carry)))
    maps = bitmaps.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__map_hash"), "keep")
    joined = rows.join(maps, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__map_hash")), "left")
    kept = ["doc_id", *(f"__carry_{i}" for i in range(len(carry)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(k, BATCH_ROWS)
                texts, n_lines, n_dropped = [], [], []
                for text, bits in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                    lines = text.split(b"\n")
                    n = len(lines)
                    if bits is not None:
                        keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n)
                        lines = [x for x, y in zip(lines, keep.tolist()) if y]
                        text = b"\n".join(lines)
                    texts.append(text)
                    n_lines.append(n)
                    n_dropped.append(n - len(lines))
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), *batch.columns[2:]], ["kept_text", "n_lines", "n_dropped", *kept])

    schema = "kept_text string, n_lines long, n_dropped long, doc_id " + kind["doc_id"] + "".join(f", __carry_{i} {kind[c]}" for i, c in enumerate(carry))
    out = joined.select("__text", "keep", *kept).mapInArrow(run, schema)
    return out.select("doc_id", "kept_text", "n_lines", "n_dropped", *(F.col(f"__carry_{i}").alias(c) for i, c in enumerate(carry)))


def digests(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of docs with keys of min_docs documents dropped everywhere."""
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
