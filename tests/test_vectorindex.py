import numpy as np
import pytest

from mnemora.operators import vectorindex, vectors
from mnemora.operators.vectorindex import VectorIndex, hydrated


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_search_equals_a_scan(spark, tmp_path, monkeypatch, spread):
    monkeypatch.setattr(vectorindex, "CELL_SIZE", 20)
    rng = np.random.RandomState(7)
    centres = rng.normal(0, 1, (12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(0, spread, 16)).tolist()) for i in range(800)]
    rows += [(1000, [0.0] * 16), (1001, rows[0][1]), (1002, None), (1003, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vector_id long, v array<double>")
    index = VectorIndex(spark, f"{tmp_path}/i").build(df, "v")
    for probe, k in ((rows[5][1], 10), (centres[3].tolist(), 40), (rng.normal(0, 1, 16).tolist(), 3), ([0.0] * 16, 5)):
        want = [(r.vector_id, r.similarity) for r in vectors.cosine_top_k(df.filter("vector_id is not null"), "vector_id", "v", probe, k).collect()]
        assert [(r.vector_id, r.similarity) for r in index.top_k(probe, k).collect()] == want
    index.top_k(rows[5][1], 10)
    cells = spark.read.parquet(f"{tmp_path}/i/cells").count()
    assert index.cells_read <= cells / 3 if spread < 0.1 else index.cells_read <= cells
    assert VectorIndex(spark, f"{tmp_path}/none").build(df.limit(0), "v").top_k([1.0], 3).collect() == []


def test_hits_by_kind(spark):
    hits = spark.createDataFrame([(5, 0.9), (-3, 0.8), (-2_000_007, 0.7), (-10_000_002, 0.6), (6, 0.5), (8, 0.4)], "vector_id long, similarity double")
    table = lambda *ids: spark.createDataFrame([(i, f"t{i}", None, "2024") for i in ids], "entity long, title string, summary string, date string")
    got = hydrated(hits, {"email": table(5, 8), "attachment": table(3), "conversation": table(7), "thread": table(1)}, 5).orderBy("rank").collect()
    assert [(r["rank"], r.type, r.entity, r.title) for r in got] == [(1, "email", 5, "t5"), (2, "attachment", 3, "t3"), (3, "conversation", 7, "t7")]
