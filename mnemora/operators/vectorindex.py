"""Semantic search on vectors stored by cell: cells are read best first, until none can hold a better one.

A cell's vectors are of length 1 and lie within its radius of its centre, so none has a cosine with a query above that
of the centre plus the radius. Cells are written as folders, so what isn't read costs nothing. Results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.operators.vectors import cosine_top_k, decode_vector_id

#: Cells at most; vectors of a cell on average, of which so many as cells are looked at to find centres.
MOST_CELLS, CELL_SIZE = 4096, 512
#: Cells that a search reads first; then twice as many each time.
FIRST_CELLS = 4


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(norm == 0, 1, norm)


def _nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * m @ centres.T).argmin(1)


class VectorIndex:
    """An index at path of rows (key, vector). Vectors are of one length; null ones, or ones with a null or no number, are left out."""

    def __init__(self, spark: SparkSession, path: str, key: str = "vector_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.cells_read = 0

    def build(self, rows: DataFrame, vector: str) -> VectorIndex:
        sound = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
        rows = rows.filter(F.col(self.key).isNotNull() & sound).select(F.col(self.key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
        n = rows.count()
        cells = max(1, min(MOST_CELLS, -(-n // CELL_SIZE)))
        # centres: rows that a hash picks, moved to the mean of those that are near, as far as they were picked
        picked = np.array([r.v for r in rows.orderBy(F.xxhash64("key")).limit(8 * cells).collect()] or [[0.0]])
        unit = _unit(picked)
        centres = unit[:cells]
        for _ in range(5):
            home = _nearest(unit, centres)
            centres = np.array([unit[home == c].mean(0) if (home == c).any() else centres[c] for c in range(len(centres))])
        shared = self.spark.sparkContext.broadcast(centres)
        kind = dict(rows.dtypes)["key"]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    m = _unit(np.stack(batch.column(1).to_numpy(zero_copy_only=False)))
                    cell = _nearest(m, shared.value)
                    far = np.sqrt(((m - shared.value[cell]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(m), pa.list_(pa.float64())), pa.array(cell.astype(np.int32)), pa.array(far)], ["key", "v", "cell", "far"])

        schema = f"key {kind}, v array<double>, cell int, far double"
        found = rows.mapInArrow(assign, schema)
        found.repartitionByRange("cell", "key").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/vectors")
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/vectors")
        places = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).join(places, "cell").write.mode("overwrite").parquet(f"{self.path}/cells")
        return self

    def top_k(self, query: list[float], k: int) -> DataFrame:
        """key, similarity (5 places) of the k nearest rows, best first, ties by key. The driver holds k rows and the cells."""
        cells = self.spark.read.parquet(f"{self.path}/cells").collect()
        self.cells_read = 0
        if not cells:
            return self.spark.createDataFrame([], f"`{self.key}` long, similarity double")
        kind = dict(self.spark.read.parquet(f"{self.path}/vectors").dtypes)["key"]
        schema = f"`{self.key}` {kind}, similarity double"
        q = np.asarray(query, float)
        q = q / (np.linalg.norm(q) or 1.0)
        most = np.array([np.dot(c.centre, q) + c.radius for c in cells]) + 1e-9
        order, best, step = np.argsort(-most, kind="stable"), [], FIRST_CELLS
        stored = self.spark.read.parquet(f"{self.path}/vectors")
        while self.cells_read < len(cells):
            # similarities are compared at 5 places, so one that might round up still counts
            if len(best) == k and most[order[self.cells_read]] < best[-1][1] - 1e-5:
                break
            some = [cells[i].cell for i in order[self.cells_read : self.cells_read + step]]
            found = cosine_top_k(stored.filter(F.col("cell").isin(some)), "key", "v", query, k).collect()
            best = sorted([*best, *((r.key, r.similarity) for r in found)], key=lambda r: (-r[1], r[0]))[:k]
            self.cells_read += len(some)
            step *= 2
        return self.spark.createDataFrame(best, schema)


def hydrated(hits: DataFrame, entities: dict[str, DataFrame], limit: int, places: int = 4) -> DataFrame:
    """rank, type, entity, title, summary, date, similarity (to so many places) of the best hits (vector_id, similarity).

    entities: by kind (email, attachment, thread, conversation) a table of entity, title, summary, date. The cut to
    limit comes first; hits without an entity are dropped then, and keep their rank from others.
    """
    top = hits.orderBy(F.desc("similarity"), "vector_id").limit(limit)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), "vector_id"))
    top = top.select("vector_id", F.round("similarity", places).alias("similarity"), place.alias("rank"), decode_vector_id(F.col("vector_id")).alias("d")).select("rank", "similarity", "d.kind", "d.entity")
    out = None
    for kind, rows in entities.items():
        own = rows.join(F.broadcast(top.filter(F.col("kind") == kind)), "entity")  # at most limit rows
        part = own.select("rank", F.lit(kind).alias("type"), F.col("entity").cast("long").alias("entity"), F.col("title").cast("string").alias("title"), F.col("summary").cast("string").alias("summary"), F.col("date").cast("string").alias("date"), "similarity")
        out = part if out is None else out.unionByName(part)
    return out
