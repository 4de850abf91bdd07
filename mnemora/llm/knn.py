"""Exact top-k search by inner product as a Voronoi join.

1. Pivots, a share of the rows that grows with the square root of their number, divide queries and rows into
   cells. A vector is assigned in two steps: to the nearest of a few coarse pivots, and there to the nearest of
   its pivots. Any assignment is right, as bounds use the distance to the pivot that a vector was given.
2. Each cell of rows is summed up: rows, the largest distance to its pivot (R) and a few landmark vectors, the
   longest of the cell. The queries of neighbouring cells form a group, GROUP queries on average; it is summed up
   by number, the largest distance to the group's pivot (r) and a bound (t) that no query's k-th best score in it
   can be under: the least, over its queries, of their k-th best score among the landmarks.
3. For a group with pivot p and a cell with pivot c, no score is above p.c + |p| R + r (|c| + R); a cell under
   t is not looked at. Of the other cells a row x goes to the group only if p.x + r |x| reaches t.
4. A group's rows are dealt to chunks of about CHUNK rows and its queries to blocks of about BLOCK, so a large
   group is spread; each chunk meets each block and is scored there as matrices. k rows of each query leave a
   chunk; the best k of these are the result.

What comes to the driver or is broadcast: pivots, landmarks and the summaries of cells and groups, some
sqrt(n) / 4 numbers or vectors each.

Defined results. A component x counts as floor(256 * x). Vectors that are null, or hold a null or non-finite
component, take no part, nor do rows without an id. Of vectors of different lengths the shorter ones count
as filled up with zeros. Rows with the query's own id are no candidates; a candidate that repeats is one
each time; queries that share an id are one, with the best scores of all of them. Equal scores go by smaller vec_id; a score beyond
a long is the nearest long. Other columns are not read. An empty table has no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.llm._shared import written

#: Rows of a group that are scored together, and queries that are.
CHUNK, BLOCK = 4096, 8192
#: Queries of a group on average: with fewer, bounds are closer, but more rows go to several groups.
GROUP = 512
#: Rows for a pivot, in square roots of all rows; landmarks of all cells together, one a cell at least.
PIVOT_SHARE, LANDMARKS = 4, 2048
BATCH_ROWS = 1024
SCALE = 256


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as the rows of a matrix, filled up with zeros; no list or number is null."""
    ends = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(sizes.sum()) - np.repeat(ends[:-1] - ends[0], sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _whole(df: DataFrame) -> DataFrame:
    """vec_id and v, the components as whole numbers, of the rows that take part."""
    v = F.col("embedding")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    return df.filter(F.col("vec_id").isNotNull() & sound).select("vec_id", whole.alias("v"))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; one beyond a long is the nearest long."""
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    if width * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < 2.0**53:
        return (q @ x.T).astype(np.int64)
    least, most = -(2**63), 2**63 - 1
    exact = [[min(most, max(least, sum(int(a) * int(b) for a, b in zip(r, s)))) for s in x] for r in q]
    return np.array(exact, np.int64).reshape(len(q), len(x))


def _best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of each row's k largest scores, the first ones of equal; own ones are left out."""
    if np.abs(scores.astype(np.float64)).max(initial=0) >= 2**53:
        # sorted as whole numbers, from the last place, so that of equal ones the first comes last and is taken
        order = np.argsort(scores[:, ::-1], axis=1, kind="stable")[:, ::-1]
        place = scores.shape[1] - 1 - order
        mine = np.take_along_axis(own, place, 1)
        taken = ~mine & ((~mine).cumsum(1) <= k)
        return np.nonzero(taken)[0], place[taken]
    left, place, taken = scores.astype(np.float64), np.zeros((len(scores), k), np.int64), np.zeros((len(scores), k), bool)
    left[own] = -np.inf
    each = np.arange(len(left))
    for i in range(k):
        place[:, i] = left.argmax(1)
        taken[:, i] = left[each, place[:, i]] > -np.inf  # not if a row has run out
        left[each, place[:, i]] = -np.inf
    return np.nonzero(taken)[0], place[taken]


class Cells:
    """Pivots in two levels, and the cell of each vector. Built on the driver, used by all tasks."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.norm = np.sqrt((pivots * pivots).sum(1))
        self.coarse = pivots[: int(np.ceil(np.sqrt(len(pivots))))]
        home = self._nearest(pivots, self.coarse)
        home[: len(self.coarse)] = np.arange(len(self.coarse))  # equal pivots too have a cell each
        self.fine = [np.flatnonzero(home == i) for i in range(len(self.coarse))]

    @staticmethod
    def _nearest(m: np.ndarray, p: np.ndarray) -> np.ndarray:
        return ((p * p).sum(1) - 2 * m @ p.T).argmin(1)

    def padded(self, m: np.ndarray) -> np.ndarray:
        """m as wide as the pivots at least."""
        return np.pad(m, ((0, 0), (0, max(0, self.pivots.shape[1] - m.shape[1]))))

    def groups(self, n: int) -> np.ndarray:
        """The group of each cell: the nearest of the first n pivots."""
        out = self._nearest(self.pivots, self.pivots[:n])
        out[:n] = np.arange(n)
        return out

    def far(self, m: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Distance of each vector to the pivot of a cell. Components that no pivot has only add to it."""
        width = self.pivots.shape[1]
        return np.sqrt(((self.padded(m)[:, :width] - self.pivots[cell]) ** 2).sum(1) + (m[:, width:] ** 2).sum(1))

    def assign(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each vector and the distance to its pivot."""
        own = self.padded(m)[:, : self.pivots.shape[1]]
        home, cell = self._nearest(own, self.coarse), np.zeros(len(m), np.int64)
        for i in np.unique(home):
            at = np.flatnonzero(home == i)
            cell[at] = self.fine[i][self._nearest(own[at], self.pivots[self.fine[i]])]
        return cell, self.far(m, cell)


class Groups:
    """Bounds of query groups against cells of rows and against rows. A group is named by its pivot's cell."""

    def __init__(self, cells: Cells, radius: np.ndarray, group: np.ndarray, reach: np.ndarray, least: np.ndarray):
        """radius of all cells; of each group of queries its cell, the largest distance and the least bound."""
        self.cells, self.radius, self.reach, self.least = cells, radius, reach, least
        self.pivot, self.norm = cells.pivots[group], cells.norm[group]

    @staticmethod
    def _room(most: np.ndarray) -> np.ndarray:
        return most + 1 + 1e-9 * np.abs(most)  # rounding must not lose a row

    def of_cells(self, cell: np.ndarray) -> np.ndarray:
        """For each cell whether a row in it can be among the best of each group."""
        far = self.radius[cell][:, None]
        return self._room(self.cells.pivots[cell] @ self.pivot.T + self.norm * far + self.reach * (self.cells.norm[cell][:, None] + far)) >= self.least

    def of_rows(self, m: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """For each row whether it can be among the best of each group."""
        own, where = np.unique(cell, return_inverse=True)
        norm = np.sqrt((m * m).sum(1))[:, None]
        most = self._room(m[:, : self.pivot.shape[1]] @ self.pivot.T + self.reach * norm)
        return (most >= self.least) & self.of_cells(own)[where]

    def candidates(self, rows: np.ndarray) -> np.ndarray:
        """How many rows each group can get at most, from the rows of every cell."""
        out = np.zeros(len(self.reach), np.int64)
        for at in range(0, len(rows), BATCH_ROWS):
            cell = np.arange(at, min(len(rows), at + BATCH_ROWS))
            out += (self.of_cells(cell) * rows[cell][:, None]).sum(0)
        return out


def _collected(df: DataFrame, column: str, ids: str | None = None) -> np.ndarray:
    """A column of vectors as a matrix on the driver; of rows that share an id, the first. The caller bounds df."""
    table = df.toArrow()
    if not table.num_rows:
        return np.zeros((0, 1))
    if ids:
        first = {x: i for i, x in reversed(list(enumerate(table.column(ids).to_pylist())))}
        table = table.take(sorted(first.values()))
    return _matrix(table.column(column).combine_chunks())


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows. Both tables have vec_id, embedding."""
    spark = rows.sparkSession
    rows = written(_whole(rows), "vectors")
    n = rows.count()
    picked = rows.orderBy(F.xxhash64("vec_id", "v")).limit(int(np.ceil(np.sqrt(n) / PIVOT_SHARE)) + 1)
    pivots = _collected(picked, "v")
    cells = Cells(pivots if len(pivots) else np.zeros((1, 1)))
    kind, asked_kind = dict(rows.dtypes)["vec_id"], dict(queries.dtypes)["vec_id"]
    shared = spark.sparkContext.broadcast(cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(1))
                cell, far = shared.value.assign(m)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far), pa.array(np.sqrt((m * m).sum(1)))], ["vec_id", "v", "cell", "far", "norm"])

    data = written(rows.mapInArrow(assign, f"vec_id {kind}, v array<double>, cell int, far double, norm double"), "cells")
    radius, size = np.zeros(len(cells.pivots)), np.zeros(len(cells.pivots), np.int64)
    for r in data.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("far").alias("far")).collect():
        radius[r["cell"]], size[r["cell"]] = r["far"], r["rows"]
    # the longest of each cell, first of 16 parts of it
    each = max(1, LANDMARKS // len(cells.pivots))
    parts = Window.partitionBy("cell", F.pmod(F.xxhash64("vec_id", "v"), F.lit(16))).orderBy(F.desc("norm"), "vec_id")
    marks = data.select("cell", "vec_id", "v", "norm").withColumn("n", F.row_number().over(parts)).filter(F.col("n") <= each)
    marks = marks.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("norm"), "vec_id"))).filter(F.col("n") <= each)
    marks = _collected(marks.select("vec_id", "v"), "v", "vec_id")
    shared_marks = spark.sparkContext.broadcast(marks if len(marks) > k else None)

    queries = _whole(queries)
    group_of = cells.groups(min(len(cells.pivots), -(-queries.count() // GROUP) or 1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                m = _matrix(batch.column(1))
                group = group_of[shared.value.assign(m)[0]]
                # one of the landmarks may be the query itself, so the bound is the (k + 1)-th best
                marks = shared_marks.value
                least = np.full(len(m), -np.inf) if marks is None else np.partition(_products(m, marks).astype(float), -(k + 1), axis=1)[:, -(k + 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group.astype(np.int32)), pa.array(shared.value.far(m, group)), pa.array(least)], ["vec_id", "v", "cell", "far", "least"])

    asked = written(queries.mapInArrow(ask, f"vec_id {asked_kind}, v array<double>, cell int, far double, least double"), "queries")
    found = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("queries"), F.max("far").alias("far"), F.min("least").alias("least")).orderBy("cell").collect()
    group = np.array([r["cell"] for r in found], np.int64)
    groups = Groups(cells, radius, group, np.array([r["far"] for r in found], float), np.array([r["least"] for r in found], float))
    chunks = np.maximum(1, -(-groups.candidates(size) // CHUNK))
    blocks = np.maximum(1, -(-np.array([r["queries"] for r in found], np.int64) // BLOCK))
    number = np.zeros(len(cells.pivots), np.int64)
    number[group] = np.arange(len(group))
    shared_groups = spark.sparkContext.broadcast((groups, chunks, blocks, number))

    def dealt(of_rows: bool):
        """Rows to their chunk in every block of the groups that need them; queries to every chunk in their block.

        The place in the written table decides chunk and block, so a task that runs again deals the same.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups, chunks, blocks, number = shared_groups.value
            own, copies = (chunks, blocks) if of_rows else (blocks, chunks)
            at = TaskContext.get().partitionId() * 1_000_003
            for whole in batches:
                for start in range(0, whole.num_rows if len(own) else 0, BATCH_ROWS):
                    batch = whole.slice(start, BATCH_ROWS)
                    cell = batch.column(2).to_numpy()
                    if of_rows:
                        row, to = np.nonzero(groups.of_rows(groups.cells.padded(_matrix(batch.column(1))), cell))
                    else:
                        row, to = np.arange(len(cell)), number[cell]
                    place = (at + row) % own[to]
                    at += batch.num_rows
                    n = copies[to]
                    copy = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    row, to, place = (np.repeat(x, n) for x in (row, to, place))
                    chunk, block = (place, copy) if of_rows else (copy, place)
                    for some in range(0, len(row), BATCH_ROWS):  # a row may go to many groups
                        part = slice(some, some + BATCH_ROWS)
                        take = pa.array(row[part])
                        yield pa.RecordBatch.from_arrays([*(pa.array(x[part].astype(np.int32)) for x in (to, chunk, block)), batch.column(0).take(take), batch.column(1).take(take)], ["group", "chunk", "block", "vec_id", "v"])

        return run

    schema = "group int, chunk int, block int, vec_id {}, v array<double>"
    left = asked.select("vec_id", "v", "cell").mapInArrow(dealt(False), schema.format(asked_kind))
    right = data.select("vec_id", "v", "cell").mapInArrow(dealt(True), schema.format(kind))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", left.schema.field("vec_id").type), ("vec_id", right.schema.field("vec_id").type), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.sort_by("vec_id")
        q, x = (_matrix(t.column("v").combine_chunks()) for t in (left, right))
        q_id, x_id = (t.column("vec_id").combine_chunks() for t in (left, right))
        out = []
        for at in range(0, len(q), 512):
            scores = _products(q[at : at + 512], x)
            ids = np.asarray(x_id)
            own = np.asarray(q_id)[at : at + 512, None] == ids
            row, place = _best(scores, own, min(k, len(x)))
            out.append(pa.table([q_id.take(pa.array(row + at)), x_id.take(pa.array(place)), pa.array(scores[row, place], pa.int64())], schema=schema))
        return pa.concat_tables(out)

    keys = ["group", "chunk", "block"]
    near_rows = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, f"query_id {asked_kind}, vec_id {kind}, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near_rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
