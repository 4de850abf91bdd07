"""Joins with aggregates where one key holds most rows."""

import pytest
from pyspark.sql import functions as F

from mnemora.operators import people as P
from mnemora.operators.joins import with_groups

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def skewed(spark):
    old = {k: spark.conf.get(k) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def spread(df):
    sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
    return sizes[-1], sizes[len(sizes) // 2]


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_rows_and_nulls(spark, how):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a"), (5, "z")], "id int, k string")
    groups = rows.filter("k in ('a', 'b')").groupBy("k").agg(F.count("*").alias("n"))
    got = {tuple(r) for r in with_groups(rows, groups, ["k"], how).select("id", *(["n"] if how != "left_anti" else [])).collect()}
    assert got == {"left": {(1, 2), (2, 1), (3, None), (4, 2), (5, None)}, "inner": {(1, 2), (2, 1), (4, 2)}, "left_anti": {(3,), (5,)}}[how]


def test_a_hot_key_goes_to_several_tasks(skewed):
    rows = skewed.range(200_000).select("id", F.when(F.col("id") % 4 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    out = with_groups(rows, rows.groupBy("k").agg(F.count("*").alias("n")), ["k"], "left")
    most, middle = spread(out)
    assert most <= 2 * middle + 4000, (most, middle)
    assert out.filter("k = 'hot' and n = 150000").count() == 150_000


@pytest.mark.parametrize("phase", [P.into_addressed, P.unaddressed, P.address_as_name])
def test_people_that_a_phase_leaves_alone_are_no_hot_key(skewed, phase):
    n = 40_000
    people = skewed.range(0, n, 1, 8).select("id", F.concat(F.lit("Ann Lee"), F.col("id") % 3000).alias("name"), F.when(F.col("id") % 10 > 0, F.concat(F.lit("a"), "id", F.lit("@x"))).alias("email"))
    stay, _ = phase(people)
    most, _ = spread(stay)
    assert most < n / 4, most
