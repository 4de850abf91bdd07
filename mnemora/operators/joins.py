"""Joins of rows with what was aggregated from them, where a few keys may hold most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner", nulls: bool = True) -> DataFrame:
    """rows joined with groups, which has one row a key; rows that have a null among the keys meet nothing.

    nulls: whether there may be such rows.

    Spark splits a hot key only where both sides come from a shuffle made for the join, and an aggregate already
    lies by its key. Joining by the keys and their hash has it shuffled once more (it is the small side), so that the
    rows of a hot key can go to several tasks. Rows without a key pass by the join, so they are no hot key either.
    """
    nulls = nulls and any(f.nullable for f in rows.schema.fields if f.name in keys)
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]) if nulls else F.lit(True)
    left = rows.filter(whole).withColumn("__hash", F.xxhash64(*keys))
    right = groups.withColumn("__hash", F.xxhash64(*keys))
    out = left.join(right, [*keys, "__hash"], how).drop("__hash")
    if how == "inner" or not nulls:
        return out
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in groups.schema.fields if f.name not in keys]
    missed = rows.filter(~whole)
    return out.unionByName(missed.select("*", *added) if how == "left" else missed)
