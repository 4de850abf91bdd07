"""Pareto layers of offers by branch and bound over packed R-trees.

1. Lines become offers: sums and counts of each item and vendor, combined before they are shuffled. Measures
   are exact whole numbers. Offers of equal measures share a layer, so layers are found for distinct points.
2. Every task peels the points that it has, by group: a packed R-tree is walked best first, by the sum of a
   node's lower corner. A node or point whose corner the current layer dominates is put off whole to the next
   layer, unopened. What is beyond the last layer among some of the points is so among all of them, and goes.
3. What is left is dealt to blocks and peeled again there. A group of one block is done. Where a group has more,
   each point asks the other blocks for the deepest layer that dominates it there; blocks are peeled anew with
   these least layers until nothing rises, which takes as many rounds as there are layers at most.

The driver sees counts only. Tables are joined after they were written, so that Spark can split a sale or item
that holds much of the rows.

Defined results. Lines without item_id or vendor_id are no offers. Of repeated rows of an item or sale the
smallest price, kind and time count; one that is missing leaves its inputs null. A non-finite number is lacking.
A price is null as well if the quantities add up to nothing. Null measures are worse than numbers and
equal to each other. Other columns are not read, whatever their names. An empty table has no offers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm._shared import remove, written

#: Layers that are told apart, entries of a node, points that are peeled together, blocks of a group at most.
LAYERS, FANOUT, BLOCK, MOST_BLOCKS = 12, 32, 50_000, 64
#: Points of a task that are peeled together before anything is shuffled.
CHUNK = 200_000
#: Stands for null in a cost: worse than any number.
WORST = (1 << 62) - 1
MEASURES = ["price", "discount", "delay", "quantity"]
COSTS = ["c0", "c1", "c2", "c3"]


class PackedTree:
    """Points in tiles of about equal size, FANOUT to a node, and the lower corner of every node."""

    def __init__(self, points: np.ndarray):
        n, d = points.shape
        tile = np.zeros(n, np.int64)
        for k in range(d):
            order = np.lexsort((points[:, k], tile))
            ordered = tile[order]
            first = np.r_[0, np.flatnonzero(np.diff(ordered)) + 1]
            size = np.diff(np.r_[first, n])
            cuts = np.maximum(1, np.ceil((size / FANOUT) ** (1 / (d - k)))).astype(np.int64)
            at = np.arange(n) - np.repeat(first, size)
            tile[order] = np.repeat(np.cumsum(cuts) - cuts, size) + at * np.repeat(cuts, size) // np.repeat(size, size)
        #: Of each level the lower corners; level 0 are the points, in the order of `home`.
        self.home = np.argsort(tile, kind="stable")
        self.levels = [points[self.home]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.minimum.reduceat(below, np.arange(0, len(below), FANOUT)))


def _dominated(corners: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Whether each corner is dominated by one of the points `by`."""
    out = np.zeros(len(corners), bool)
    for at in range(0, len(by), 4096):
        some = by[at : at + 4096, None]
        out |= ((some <= corners).all(2) & (some < corners).any(2)).any(0)
    return out


def peel(points: np.ndarray, least: np.ndarray | None = None, most: int = LAYERS) -> np.ndarray:
    """The layer of each of the distinct points (lower is better), from 1 to most, or 0 beyond.

    least: no point is in an earlier layer than this, as others that are not here dominate it.
    """
    n, d = points.shape
    out = np.zeros(n, np.int64)
    if not n:
        return out
    # ranks, so that sums are small and a dominating point's is less
    tree = PackedTree(np.column_stack([np.unique(points[:, k], return_inverse=True)[1] for k in range(d)]))
    least = np.ones(n, np.int64) if least is None else least
    top = len(tree.levels) - 1
    heap = [(int(tree.levels[top][0].sum()), top, 0)]
    for layer in range(1, most + 1):
        later: list[tuple[int, int, int]] = []
        front, size = np.empty((256, d), np.int64), 0
        while heap:
            entry = heapq.heappop(heap)
            _, level, i = entry
            corner = tree.levels[level][i]
            if size and _dominated(corner[None], front[:size])[0]:
                later.append(entry)
            elif level:
                low, high = i * FANOUT, min((i + 1) * FANOUT, len(tree.levels[level - 1]))
                below = tree.levels[level - 1][low:high]
                for k, (s, off) in enumerate(zip(below.sum(1).tolist(), _dominated(below, front[:size]).tolist())):
                    later.append((s, level - 1, low + k)) if off else heapq.heappush(heap, (s, level - 1, low + k))
            else:
                if size == len(front):
                    front = np.concatenate([front, np.empty_like(front)])
                front[size] = corner
                size += 1
                if least[tree.home[i]] > layer:  # stays for a later layer, and so do those that it dominates
                    later.append(entry)
                else:
                    out[tree.home[i]] = layer
        heap = later
        heapq.heapify(heap)
        if not heap:
            break
    return out


def deepest(points: np.ndarray, layer: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each asked point the deepest layer of the points that dominate it; 0 if none does."""
    out = np.zeros(len(asked), np.int64)
    if not len(points) or not len(asked):
        return out
    tree = PackedTree(points)
    layer = layer[tree.home]
    corners = tree.levels[1] if len(tree.levels) > 1 else tree.levels[0]
    deep = np.maximum.reduceat(layer, np.arange(0, len(layer), FANOUT)) if len(tree.levels) > 1 else layer
    for i in np.argsort(-deep, kind="stable"):
        hit = np.flatnonzero((out < deep[i]) & (corners[i] <= asked).all(1))
        some = slice(i * FANOUT, (i + 1) * FANOUT) if len(tree.levels) > 1 else slice(i, i + 1)
        for at in range(0, len(hit), 8192):
            rows = hit[at : at + 8192]
            p, x = tree.levels[0][some][:, None], asked[rows]
            over = (p <= x).all(2) & (p < x).any(2)
            out[rows] = np.maximum(out[rows], (over * layer[some][:, None]).max(0))
    return out


def _matrix(table: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([np.asarray(table.column(c), np.int64) for c in names])


def layers(points: DataFrame, group: str, costs: list[str], most: int = LAYERS) -> DataFrame:
    """group, costs, layer (1 to most) of distinct points; those beyond are left out.

    The group is a string that is not null, costs are longs that are not null; lower is better.
    """
    spark, used = points.sparkSession, []
    fields = f"{group} string, " + "".join(f"{c} long, " for c in costs)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def peeled(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(some)
            m, names = _matrix(table, costs), np.asarray(table.column(group).to_pylist(), object)
            for name in np.unique(names):
                own = m[names == name]
                layer = peel(own, most=most)
                own, layer = own[layer > 0], layer[layer > 0]
                arrays = [pa.array([name] * len(own), pa.string()), *(pa.array(own[:, k]) for k in range(len(costs))), pa.array(layer)]
                yield pa.RecordBatch.from_arrays(arrays, [group, *costs, "layer"])

        some, n = [], 0
        for batch in batches:
            some.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield from peeled(some)
                some, n = [], 0
        if n:
            yield from peeled(some)

    rows = written(points.select(group, *costs).mapInArrow(local, fields + "layer long"), "fronts", used)
    sizes = rows.groupBy(group).agg(F.least(F.lit(MOST_BLOCKS), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("blocks"))
    dealt = rows.join(written(sizes, "blocks", used), group)
    dealt = dealt.select(group, F.pmod(F.xxhash64(*costs), F.col("blocks")).cast("int").alias("block"), "blocks", *costs, F.lit(1).cast("long").alias("layer"))
    home = fields + "block int, blocks int, layer long"

    def settle(table: pa.Table) -> pa.Table:
        layer = peel(_matrix(table, costs), np.asarray(table.column("layer"), np.int64), most)
        kept = layer > 0
        out = table.filter(pa.array(kept)).select([group, *costs, "block", "blocks"])
        return out.append_column("layer", pa.array(layer[kept]))

    now = written(dealt.groupBy(group, "block").applyInArrow(settle, home), "layers", used)
    while not now.filter("blocks > 1").isEmpty():
        many = now.filter("blocks > 1")
        asked = many.select(group, *costs, F.col("block").alias("home"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).filter("block <> home")

        def ask(own: pa.Table, others: pa.Table) -> pa.Table:
            found = deepest(_matrix(own, costs), np.asarray(own.column("layer"), np.int64), _matrix(others, costs)) + 1
            return others.select([group, *costs]).append_column("found", pa.array(found))

        found = many.groupBy(group, "block").cogroup(asked.groupBy(group, "block")).applyInArrow(ask, fields + "found long")
        found = written(found.filter("found > 1").groupBy(group, *costs).agg(F.max("found").alias("found")), "found", used)
        raised = many.join(found, [group, *costs], "left").select(group, *costs, "block", "blocks", F.greatest("layer", F.coalesce("found", F.lit(1).cast("long"))).alias("layer"), F.col("layer").alias("was"))
        raised = written(raised, "raised", used)
        if raised.filter("layer > was").isEmpty():
            break
        again = raised.drop("was").groupBy(group, "block").applyInArrow(settle, home)
        now = written(again.unionByName(now.filter("blocks <= 1")), "layers", used)
    out = written(now.select(group, *costs, "layer"), "layered")
    remove(spark, used)
    return out


def _cents(x: Column) -> Column:
    """floor(100 x + 0.5) in doubles; null if that is no long."""
    return F.floor(F.when(F.abs(x) < 1e15, x).cast("double") * 100 + 0.5).cast("long")


def _floor_ratio(a: Column, b: Column) -> Column:
    """floor(a / b) of whole numbers, exactly, as long; null if b is null or 0."""
    a, b = a.cast("decimal(38,0)"), F.when(b != 0, b).cast("decimal(38,0)")
    rest = a % b
    down = (rest != 0) & ((rest < 0) != (b < 0))
    return ((a - rest) / b).cast("decimal(38,0)").try_cast("long") - down.cast("int")


def offers(lines: DataFrame, items: DataFrame, sales: DataFrame, temporary: list[str] | None = None) -> DataFrame:
    """item_id, vendor_id, part_type, price, discount, delay, quantity: an offer for each item and vendor that lines have."""
    sold = sales.filter(F.col("sale_id").isNotNull()).groupBy("sale_id").agg(F.min(F.to_date("sold_at")).alias("__sold"))
    sold = written(sold, "sold", temporary)
    priced = items.filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(_cents(F.min("price")).alias("__p"), F.min("kind").alias("part_type"))
    priced = written(priced, "priced", temporary)
    days = lambda c: F.unix_date(F.to_date(c))
    c, d, q = _cents(F.col("amount")), _cents(F.col("discount")), F.col("quantity").cast("long")
    whole = c.isNotNull() & d.isNotNull() & q.isNotNull()
    rows = lines.filter(F.col("item_id").isNotNull() & F.col("vendor_id").isNotNull()).select(
        "sale_id", "item_id", "vendor_id", F.when(whole, c).alias("__c"), d.alias("__d"), q.alias("__q"), days("shipped_at").alias("__shipped")
    )
    late = F.col("__shipped") - F.unix_date("__sold")
    spent = (F.col("__c").cast("decimal(19,0)") * (100 - F.col("__d")).cast("decimal(19,0)")).cast("decimal(38,0)")
    sums = rows.join(sold, "sale_id", "left").groupBy("item_id", "vendor_id").agg(
        F.sum(spent).alias("__spent"),
        F.sum(F.when(F.col("__c").isNotNull(), F.col("__q"))).alias("__n"),
        F.sum("__d").alias("__d"),
        F.count("__d").alias("__nd"),
        F.sum(late.cast("long")).alias("__late"),
        F.count(late).alias("__nlate"),
        F.max("__q").alias("quantity"),
    )
    paid = F.when(F.col("__p") >= 1, F.col("__p")).cast("decimal(19,0)") * F.col("__n").cast("decimal(19,0)")
    return sums.join(priced, "item_id", "left").select(
        "item_id",
        "vendor_id",
        "part_type",
        _floor_ratio(F.col("__spent"), paid).alias("price"),
        _floor_ratio(F.col("__d"), F.col("__nd")).alias("discount"),
        _floor_ratio(F.col("__late"), F.col("__nlate")).alias("delay"),
        "quantity",
    )


def layered_offers(lines: DataFrame, items: DataFrame, sales: DataFrame, most: int = LAYERS) -> DataFrame:
    """Every offer with type_layer, global_layer (0 beyond `most`) and n_equal, the offers with the same measures."""
    spark, used = lines.sparkSession, []
    cost = [F.coalesce(x, F.lit(WORST)).cast("long") for x in (F.col("price"), -F.col("discount"), F.col("delay"), -F.col("quantity"))]
    kind = F.coalesce(F.concat(F.lit("="), F.col("part_type")), F.lit(""))
    found = written(offers(lines, items, sales, used).select("*", kind.alias("kind"), *(c.alias(n) for c, n in zip(cost, COSTS))), "offers")
    typed = written(found.groupBy("kind", *COSTS).agg(F.count(F.lit(1)).alias("n")), "points", used)
    whole = written(typed.groupBy(*COSTS).agg(F.sum("n").alias("n_equal")), "points", used)
    # '' alone is the group of all offers: types begin with a mark
    points = typed.select(F.concat(F.lit("t"), "kind").alias("group"), *COSTS).unionByName(whole.select(F.lit("").alias("group"), *COSTS))
    layer = layers(points, "group", COSTS, most)
    of_all = layer.filter("`group` = ''").select(*COSTS, F.col("layer").alias("global_layer"))
    of_type = layer.filter("`group` <> ''").select(F.expr("substr(`group`, 2)").alias("kind"), *COSTS, F.col("layer").alias("type_layer"))
    whole = written(whole.join(of_all, COSTS, "left"), "points", used)
    typed = written(typed.drop("n").join(of_type, ["kind", *COSTS], "left").join(whole, COSTS), "layered")
    remove(spark, used)
    zero = F.lit(0).cast("long")
    return found.join(typed, ["kind", *COSTS]).select(
        "item_id", "vendor_id", "part_type", *MEASURES, F.coalesce("type_layer", zero).alias("type_layer"), F.coalesce("global_layer", zero).alias("global_layer"), "n_equal"
    )
