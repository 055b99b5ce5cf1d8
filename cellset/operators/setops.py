"""Set operations on keys and rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def missing(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    return expected.select(key).join(observed.select(key), key, "left_anti").distinct()


def overlap(df: DataFrame, key: str, by: str) -> DataFrame:
    """Keys that occur under more than one value of ``by``, with the values."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(by)).alias("_v")).where(F.size("_v") > 1).select(
        key, F.array_join("_v", ",").alias("found_in"))


def intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def set_relation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Size of both key sets, what each misses, equality and inclusion, from one full outer join."""
    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).distinct().withColumn("_b", F.lit(True))
    out = left.join(right, key, "full_outer").agg(
        F.count("_a").alias("first"), F.count("_b").alias("second"),
        F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second"))
    return out.withColumns({"equal": (F.col("only_first") == 0) & (F.col("only_second") == 0),
                            "subset": F.col("only_first") == 0})
