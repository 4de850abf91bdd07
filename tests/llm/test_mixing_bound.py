import random
from collections import defaultdict

from pyspark.sql import functions as F

from mnemora.llm import mixing


def test_a_leaf_leaves_less_than_one_document(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("aaabc"), rng.choice([1, 5, 9, 400])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, p string, n long").withColumn("text", F.lit(""))
    budget = F.floor(F.sum("tokens") * 8 / 10)
    got = mixing.mix(df, {"p": F.col("p")}, [{}], budget, 1, 3, F.col("n"))
    leaves = got.groupBy("p").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    total = {r.p: r.total for r in mixing.leaf_budgets(leaves, ["p"], [{}], budget, 1).collect()}
    taken, out = defaultdict(int), defaultdict(list)
    for r in got.collect():
        taken[r.p] += r.tokens * r.copies
        if not r.copies:
            out[r.p].append(r.tokens)
    assert all(taken[p] == t if not out[p] else 0 <= t - taken[p] < max(out[p]) for p, t in total.items())
    assert any(t > taken[p] for p, t in total.items())
