"""Near-dedup with HyperMinHash sketches; links are confirmed on full shingle sets.

1. A document's set holds the hashes of its distinct shingles. The hash's first bits choose one of 256
   buckets; of the least remainder in each bucket the register keeps the number of leading zeros and the
   ten bits behind the first one (2 bytes). An empty bucket borrows the register of the first bucket that
   isn't empty in a fixed order of its own, so small sets band as well as large ones.
2. Documents with equal sets form a class, named by its least doc_id. All that follows is on classes, and
   only on those whose set is large enough to be 0.8 similar to another one (four shingles).
3. Bands of six registers are hashed; classes that share a band key meet. Of 42 bands, two sets of
   similarity 0.8 share none with a probability of 3e-6.
4. Instead of all pairs of a key, its members are compared with one hub: the member that shares most keys
   with others. A pair goes on if sizes allow 0.8 and the registers' similarity, less the equal registers
   expected by chance, comes near enough.
5. Texts of the classes in such pairs are written once. Members' texts go to their hub, in parts of at most
   256 members, each with a copy of the hub's text; there full sets are compared.
6. Components of the confirmed links (alternating large and small stars; every round is written out).
7. Only where a key's members are still in several components, those outside the key's largest component
   are compared with all others, so no link between components is lost. They meet in blocks of bounded
   size, first with their registers alone: each pair is looked at under the first of its common keys only,
   and a block gives the members with a partner near enough in another component. Only those go on to blocks
   of the same kind with their texts, where full sets are compared. A block gives no pairs but links, and of
   these one fewer than members at most. Components are then joined by these links.

No step holds a group in one task: groups are aggregated before a shuffle, or joined with one row per key,
which Spark splits where it is skewed. Intermediate tables are removed as soon as nothing reads them.

Defined results. Shingles are of k words `[^\\x20\\x09-\\x0D]+` after A-Z became a-z; a text with fewer words
has one shingle, all of it; a null text or one without words has an empty set, which links with nothing.
A row without a doc_id links with nothing and is kept. Rows that share a doc_id are one document: it has
the links of all their texts. A doc_id may be of any type that Spark orders (whole numbers to the least
long, strings); the least is the one that Spark's min gives. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mnemora.llm._shared import remove, small_batches, written
from mnemora.operators.joins import with_groups

BUCKET_BITS, MANTISSA_BITS = 8, 10
BUCKETS = 1 << BUCKET_BITS
ROWS, BANDS = 6, 42
#: Members of a key that meet in one block: those outside its largest component, and all.
BLOCK_X, BLOCK_Y = 128, 512
#: Members of a hub that are compared in one part.
STAR_PART = 256
BATCH_ROWS = 512

_REST_BITS = 64 - BUCKET_BITS
#: For each bucket the order in which it looks for a bucket that isn't empty.
_DONORS = np.stack([np.random.RandomState(1000 + j).permutation(BUCKETS) for j in range(BUCKETS)])
_BAND_MIX = np.random.RandomState(7).randint(1, 1 << 62, (BANDS, ROWS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text in UTF-8."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(k, len(one))
    out = np.full(len(one) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + one[i : len(one) - n + 1 + i])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of a set that isn't empty; hashes are sorted."""
    bucket = (hashes >> np.uint64(_REST_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted, so the first in a bucket is its least
    rest = (hashes[first] & np.uint64((1 << _REST_BITS) - 1)).astype(np.float64) + 1
    mantissa, exponent = np.frexp(rest)  # rest = mantissa * 2 ** exponent, 0.5 <= mantissa < 1
    zeros = _REST_BITS + 1 - exponent
    out = np.zeros(BUCKETS, np.uint16)
    full = np.zeros(BUCKETS, bool)
    full[bucket[first]] = True
    out[bucket[first]] = zeros.astype(np.uint16) << MANTISSA_BITS | ((mantissa - 0.5) * (1 << (MANTISSA_BITS + 1))).astype(np.uint16)
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _DONORS[empty]
        out[empty] = out[order[np.arange(len(empty)), full[order].argmax(1)]]
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity from equal registers, less those that are equal by chance (by leading zeros and mantissa)."""
    equal = (a == b).sum(-1)
    most, least = np.maximum(n_a, n_b).astype(float), np.minimum(n_a, n_b)
    ratio = least / most
    by_chance = 0.169919487159739093975315012348 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0, equal - by_chance) / (BUCKETS - by_chance)


def near_enough(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether corrected register similarity doesn't speak against 0.8.

    The least is 0.8 less about five standard deviations; sets that fill fewer buckets deviate more.
    """
    n = np.minimum(n_a, n_b)
    return estimate(a, b, n_a, n_b) >= np.where(n < 64, 0.6, np.where(n < 256, 0.65, 0.68))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (the set's 128-bit hash) and registers of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                sets = [shingles(t, k) for t in batch.column(1).cast(pa.binary()).to_pylist()]
                two = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").astype(np.int64).reshape(-1, 2)
                regs = [registers(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(regs, pa.binary())], ["doc_id", "n", "h1", "h2", "regs"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n int, h1 long, h2 long, regs binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys of every class; size and band share one number, as this is the largest table of all."""
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH_ROWS):
            batch = whole.slice(at, BATCH_ROWS)
            regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, BUCKETS)[:, : BANDS * ROWS]
            keys = _mix((_mix(regs.reshape(-1, BANDS, ROWS).astype(np.uint64) + _BAND_MIX) * _BAND_MIX).sum(2, dtype=np.uint64)).view(np.int64)
            each = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            sizes = np.repeat(batch.column(1).to_numpy().astype(np.int64), BANDS) * BANDS + np.tile(np.arange(BANDS), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), batch.column(0).take(each), pa.array(sizes)], ["key", "cid", "nb"])


def _similar(percent: int):
    """Of pairs with both registers, those that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("regs_member", "regs_hub"))
                n, m = (b.column(c).to_numpy().astype(np.int64) for c in ("n_member", "n_hub"))
                keep = (n * 100 >= m * percent) & (m * 100 >= n * percent) & near_enough(x, y, n, m)
                yield pa.RecordBatch.from_arrays([b.column("member"), b.column("hub")], ["member", "hub"]).filter(pa.array(keep))

    return run


def _stars(k: int, percent: int):
    """Of rows (hub, part, order, cid, text), a hub's own texts first in each part, the links (a, b)."""

    def linked(sets: list[np.ndarray], other: np.ndarray) -> bool:
        for known in sets:
            both = len(np.intersect1d(known, other, assume_unique=True))
            if both and 100 * both >= percent * (len(known) + len(other) - both):
                return True
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sets = None, []
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                keep = []
                texts = batch.column(4).cast(pa.binary()).to_pylist()
                for row, text in enumerate(texts):
                    now = (batch.column(0)[row].as_py(), batch.column(1)[row].as_py())
                    if now != unit:
                        unit, sets = now, []
                    own = shingles(text, k)
                    if batch.column(2)[row].as_py() == 0:
                        sets.append(own)
                    elif linked(sets, own):
                        keep.append(row)
                found = pa.array(keep, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(3).take(found), batch.column(0).take(found)], ["a", "b"])

    return run


def _units(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, dict]]:
    """Of rows sorted by (key, xb, yb), the other columns of each unit of equal ones as lists; a unit is bounded."""
    held, unit = None, None
    for batch in batches:
        parts = [c.cast(pa.binary()) if name == "text" else c for name, c in zip(batch.schema.names, batch.columns)]
        for row in zip(*(c.to_pylist() for c in parts)):
            if row[:3] != unit:
                if held is not None:
                    yield unit, held
                unit, held = row[:3], {c: [] for c in columns}
            for c, value in zip(columns, row[3:]):
                held[c].append(value)
    if held is not None:
        yield unit, held


def _partners(regs: np.ndarray, n: np.ndarray, x: np.ndarray, root: np.ndarray, band: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each left member of a block the right ones of other components that come near enough.

    Pairs that met under an earlier band are left out, as they have been looked at there.
    """
    right = np.flatnonzero(~x)
    for i in np.flatnonzero(x):
        other = right[(root[right] != root[i]) & (n[right] * 100 >= n[i] * percent) & (n[i] * 100 >= n[right] * percent)]
        other = other[near_enough(regs[other], regs[i], n[other], n[i])]
        if band and len(other):
            other = other[~(regs[other, : band * ROWS] == regs[i, : band * ROWS]).reshape(len(other), band, ROWS).all(2).any(1)]
        yield i, other


def _open(percent: int, schema: pa.Schema):
    """Of a block's rows (key, xb, yb, part, x, cid, root, band, n, regs) those with a partner, by registers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, rows in _units(batches, ["part", "x", "cid", "root", "band", "n", "regs"]):
            regs, n = np.frombuffer(b"".join(rows["regs"]), np.uint16).reshape(-1, BUCKETS), np.array(rows["n"], np.int64)
            with_partner = np.zeros(len(n), bool)
            for i, other in _partners(regs, n, np.array(rows["x"]), np.array(rows["root"]), rows["band"][0], percent):
                with_partner[other] = True
                with_partner[i] |= len(other) > 0
            found = np.flatnonzero(with_partner)
            columns = [[value] * len(found) for value in unit] + [[rows[c][i] for i in found] for c in ("part", "x", "cid", "root", "band")]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _bridges(k: int, percent: int, id_type: pa.DataType):
    """Of a block's rows (key, xb, yb, x, cid, root, band, text) links between components, enough to join them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _units(batches, ["x", "cid", "root", "band", "text"]):
            sets = [shingles(t, k) for t in rows["text"]]
            full = [i for i, s in enumerate(sets) if len(s)]  # of rows that share a doc_id one may be empty
            sets = [sets[i] for i in full]
            x, root = (np.array([rows[c][i] for i in full]) for c in ("x", "root"))
            found = []
            if sets:
                regs, n = np.stack([registers(s) for s in sets]), np.array([len(s) for s in sets])
                part = root.copy()  # the component of each row, as far as known here
                for i, others in _partners(regs, n, x, root, rows["band"][0], percent):
                    for j in others:
                        if part[i] != part[j]:
                            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                            if both and 100 * both >= percent * (n[i] + n[j] - both):
                                a, b = rows["root"][full[i]], rows["root"][full[j]]
                                found.append((min(a, b), max(a, b)))
                                part[part == part[j]] = part[i]
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], id_type) for c in (0, 1)], ["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node that it reaches) for every node of links (a, b) with a <> b.

    Alternating large stars and small stars. Minima are aggregated before the shuffle and joined back, so a
    node with very many links is spread. A round's links are written; rounds grow with the logarithm of the
    longest path.
    """
    spark = links.sparkSession

    def count(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()

    used: list[str] = []
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links", used)
    before = count(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are written: joined as they are, they'd keep Spark from splitting the links of one node
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", used)
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large", used)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least", used)
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        edges = written(small, "links", used)
        remove(spark, used[:-1])
        del used[:-1]
        now = count(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _star_links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) of distinct pairs (member, hub), confirmed on full sets.

    A member's text goes to one part of each of its hubs, a hub's text to all of its parts.
    """
    kind = dict(pairs.dtypes)["hub"]
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STAR_PART).cast("int").alias("parts"))
    as_member = with_groups(pairs, parts, ["hub"], nulls=False).select("hub", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("order"), F.col("member").alias("cid"))
    as_hub = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("order"), F.col("hub").alias("cid"))
    dealt = as_hub.unionByName(as_member).join(texts.hint("merge"), "cid").select("hub", "part", "order", "cid", "text")
    dealt = dealt.repartition("hub", "part").sortWithinPartitions("hub", "part", "order")
    return dealt.mapInArrow(_stars(k, percent), f"a {kind}, b {kind}")


def _by_block(rows: DataFrame, n: int) -> DataFrame:
    """n rows of blocks (key, xb, yb, part), a block's together, in as many partitions as there may be full blocks."""
    return rows.repartitionById(n // (BLOCK_X + BLOCK_Y) + 1, "part").sortWithinPartitions("key", "xb", "yb")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    spark, used = docs.sparkSession, []
    small_batches(spark)
    sketch = written(sketches(docs, k), "sketches")
    real = sketch.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = written(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("cid")), "classes")
    # a set of n is at best n / (n + 1) similar to another one
    reps = real.filter(F.col("n") * (100 - percent) >= percent).withColumnRenamed("doc_id", "cid").join(classes.hint("merge"), ["cid", "h1", "h2"]).dropDuplicates(["cid", "h1", "h2"])
    reps = written(reps.select("cid", "n", "regs"), "class-sketches", used)
    kind, id_type = dict(reps.dtypes)["cid"], to_arrow_type(reps.schema["cid"].dataType)
    bands = reps.mapInArrow(_bands, f"key long, cid {kind}, nb long")
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    active = with_groups(bands, shared.hint("merge"), ["key"], nulls=False).select("key", "cid", "c", F.expr(f"nb div {BANDS}").alias("n"), (F.col("nb") % BANDS).cast("int").alias("band"))
    active = written(active, "shared-bands", used)

    # the first by weight, then by id, as a struct that is least: no arithmetic on ids
    centre = active.groupBy("cid").agg((-F.sum("c")).alias("light"))
    hubs = active.join(centre, "cid").groupBy("key").agg(F.min(F.struct("light", F.col("cid").alias("id"), "n")).alias("hub")).select("key", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"))
    fits = lambda x, y: F.col(x) * 100 >= F.col(y) * percent
    stars = with_groups(active, hubs, ["key"], nulls=False).filter((F.col("cid") != F.col("hub")) & fits("n", "hub_n") & fits("hub_n", "n"))
    pairs = stars.select(F.col("cid").alias("member"), "hub").distinct()
    registers_of = written(reps.join(active.select("cid").distinct().hint("merge"), "cid", "left_semi"), "active-sketches", used)
    side = lambda c: registers_of.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}")).hint("merge")
    near = written(pairs.join(side("member"), "member").join(side("hub"), "hub").mapInArrow(_similar(percent), f"member {kind}, hub {kind}").distinct(), "star-pairs", used)
    plain = docs.select(F.col("doc_id").alias("cid"), F.col("text").cast("string").alias("text"))
    texts = written(plain.join(near.select(F.explode(F.array("member", "hub")).alias("cid")).distinct().hint("merge"), "cid", "left_semi"), "star-texts", used)
    roots = components(_star_links(near, texts, k, percent))

    # keys of three or more whose members are still apart; a key of two had its only pair compared
    now = active.filter("c > 2").join(roots, F.col("cid") == F.col("node"), "left").select("key", "cid", "band", F.coalesce("root", "cid").alias("root"))
    sizes = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    parts = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.sum("size").alias("all"), F.min(F.struct((-F.col("size")).alias("less"), F.col("root").alias("id"))).alias("main"))
    parts = parts.filter("roots > 1").select("key", "all", (F.col("all") + F.col("main.less")).alias("others"), F.col("main.id").alias("main"))
    apart = written(with_groups(now, parts, ["key"], nulls=False), "keys-apart", used)
    # every member goes to the blocks of the others, and these again to the blocks of all
    block = lambda size: F.pmod(F.xxhash64("cid"), F.col(size)).cast("int")
    sized = apart.withColumn("bx", F.ceil(F.col("others") / BLOCK_X).cast("int")).withColumn("by", F.ceil(F.col("all") / BLOCK_Y).cast("int"))
    as_y = F.transform(F.sequence(F.lit(0), F.col("bx") - 1), lambda i: F.struct(i.alias("xb"), block("by").alias("yb"), F.lit(False).alias("x")))
    as_x = F.when(F.col("root") != F.col("main"), F.transform(F.sequence(F.lit(0), F.col("by") - 1), lambda i: F.struct(block("bx").alias("xb"), i.alias("yb"), F.lit(True).alias("x"))))
    dealt = sized.select("key", F.explode(F.concat(as_y, F.coalesce(as_x, F.array().cast("array<struct<xb:int,yb:int,x:boolean>>")))).alias("b"), "by", "cid", "root", "band")
    # the blocks of a key go to one partition after the other, so that a large key's are spread evenly
    part = F.pmod(F.xxhash64("key"), F.lit(1 << 30)).cast("int") + F.pmod(F.col("b.xb").cast("long") * F.col("by") + F.col("b.yb"), F.lit(1 << 30)).cast("int")
    dealt = dealt.join(registers_of.hint("merge"), "cid").select("key", "b.xb", "b.yb", part.alias("part"), "b.x", "cid", "root", "band", "n", "regs")
    n_dealt = sized.agg(F.sum(F.col("bx") + F.when(F.col("root") != F.col("main"), F.col("by")).otherwise(0))).first()[0] or 0
    dealt = _by_block(dealt, n_dealt)
    schema = f"key long, xb int, yb int, part int, x boolean, cid {kind}, root {kind}, band int"
    fields = pa.schema([("key", pa.int64()), ("xb", pa.int32()), ("yb", pa.int32()), ("part", pa.int32()), ("x", pa.bool_()), ("cid", id_type), ("root", id_type), ("band", pa.int32())])
    unsolved = written(dealt.mapInArrow(_open(percent, fields), schema), "open-blocks", used)
    named = classes.join(roots, F.col("cid") == F.col("node"), "left").select("h1", "h2", F.coalesce("root", "cid").alias("component_id"))
    n_unsolved = unsolved.count()
    if n_unsolved:
        texts = plain.join(unsolved.select("cid").distinct().hint("merge"), "cid", "left_semi")
        whole = _by_block(unsolved.join(texts.hint("merge"), "cid"), n_unsolved).select("key", "xb", "yb", "x", "cid", "root", "band", "text")
        # only components are joined now, so the graph is that of the new links between them
        joined = components(whole.mapInArrow(_bridges(k, percent, id_type), f"a {kind}, b {kind}")).select(F.col("node").alias("component_id"), F.col("root").alias("least"))
        named = named.join(joined, "component_id", "left").select("h1", "h2", F.coalesce("least", "component_id").alias("component_id"))
    remove(spark, used)
    result = sketch.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return result.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
