"""Data-quality gates. Every gate is a one-row frame ``check, observed, expected``; a gate passes when both agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellset.functions import vectors as V
from cellset.operators.windows import check_ranges


def gate(df: DataFrame, name: str, observed: Column, expected: Column | int) -> DataFrame:
    """Gate over a whole frame from aggregate expressions."""
    wanted = F.lit(expected) if isinstance(expected, int) else expected
    return df.agg(observed.cast("long").alias("observed"), wanted.cast("long").alias("expected")).select(
        F.lit(name).alias("check"), "observed", "expected")


def run_checks(checks: list[DataFrame], strict: bool = False) -> DataFrame:
    """All gates as rows with ``passed``; ``strict`` fails the job on the first gate that does not pass."""
    table = reduce(lambda a, b: a.unionByName(b), checks).withColumn(
        "passed", F.col("observed").eqNullSafe(F.col("expected")))
    if strict:
        message = F.concat(F.lit("check failed: "), "check")
        table = table.where(F.assert_true(F.col("passed"), message).isNull())
    return table


def none_of(df: DataFrame, name: str, bad: Column | None = None) -> DataFrame:
    """No row of ``df`` (or none where ``bad`` holds)."""
    return gate(df, name, F.count("*") if bad is None else F.count_if(bad), 0)


def unique_key(df: DataFrame, key: str, name: str) -> DataFrame:
    return gate(df, name, F.count_distinct(key), F.count("*"))


def contiguous_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """Keys are exactly 0..n-1."""
    seen = df.groupBy(key).agg(F.count("*").alias("_c"))
    whole = (F.min(key) == 0) & (F.max(key) == F.sum("_c") - 1)
    return gate(seen, name, F.when(whole, F.count("*")).otherwise(-1), F.sum("_c"))


def ranges_back_to_back(ranges: DataFrame, order: list[str], name: str) -> DataFrame:
    return gate(check_ranges(ranges, order), name,
                F.max(F.col("broken") + F.col("wrong_length") + F.abs("first_start")), 0)


def no_key_in_two(df: DataFrame, key: str, by: str, name: str) -> DataFrame:
    return none_of(df.groupBy(key).agg(F.count_distinct(by).alias("_n")).where("_n > 1"), name)


def keys_known(df: DataFrame, reference: DataFrame, key: str, name: str) -> DataFrame:
    return none_of(df.join(reference.select(key), key, "left_anti"), name)


def covered_once(planned: DataFrame, observed: DataFrame, key: str, name: str) -> DataFrame:
    """Every planned index observed exactly once and nothing else: counts of planned minus faulty keys."""
    seen = observed.groupBy(key).agg(F.count("*").alias("_n"))
    both = planned.select(key, F.lit(True).alias("_want")).join(seen, key, "full_outer")
    return gate(both, name, F.count_if(F.col("_want") & (F.col("_n") == 1)) - F.count_if(
        F.col("_want").isNull() | (F.col("_n") > 1)), F.count("_want"))


def vectors_finite(df: DataFrame, column: str, name: str) -> DataFrame:
    return gate(df, name, F.count_if(V.all_finite(F.col(column))), F.count("*"))


def vectors_signed(df: DataFrame, column: str, name: str) -> DataFrame:
    """Both signs occur in the table."""
    v = F.col(column)
    return gate(df, name, F.max(F.exists(v, lambda x: x < 0).cast("int")) + F.max(
        F.exists(v, lambda x: x > 0).cast("int")), 2)


def vectors_nonnegative(df: DataFrame, column: str, name: str) -> DataFrame:
    return gate(df, name, F.count_if(F.forall(column, lambda x: x >= 0)), F.count("*"))


def set_sizes(sets: DataFrame, keys: list[str], member: str, size: int, name: str) -> DataFrame:
    """Every set has exactly ``size`` members, all different."""
    per = sets.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_distinct(member).alias("_d"))
    return gate(per, name, F.count_if((F.col("_n") == size) & (F.col("_d") == size)), F.count("*"))


def row_count(df: DataFrame, expected: int, name: str) -> DataFrame:
    return gate(df, name, F.count("*"), expected)


def allowed_values(df: DataFrame, column: str, values: list, name: str) -> DataFrame:
    return none_of(df, name, ~F.coalesce(F.col(column).isin(values), F.lit(False)))


def evaluation_complete(rows: DataFrame, condition: str, repeat: str, repeats: list[int], metric: str, name: str
                        ) -> DataFrame:
    """Every condition has exactly the wanted repeats once, and a finite metric on each."""
    good = F.col(metric).isNotNull() & ~F.isnan(metric) & (F.abs(metric) != F.lit(float("inf")))
    per = rows.groupBy(condition).agg(
        F.array_sort(F.collect_set(repeat)).alias("_r"), F.count("*").alias("_n"), F.count_if(good).alias("_g"))
    wanted = F.array(*[F.lit(r).cast(rows.schema[repeat].dataType) for r in sorted(repeats)])
    ok = (F.col("_r") == wanted) & (F.col("_n") == len(repeats)) & (F.col("_g") == len(repeats))
    return gate(per, name, F.count_if(ok), F.count("*"))


def spot_check(cache: DataFrame, recomputed: DataFrame, key: str, column: str, name: str, tolerance: float = 0.0
               ) -> DataFrame:
    """Recomputed rows equal the cached ones; a recomputed row missing in the cache counts as wrong."""
    joined = recomputed.select(key, F.col(column).alias("_new")).join(
        cache.select(key, F.col(column).alias("_old")), key, "left")
    gap = F.array_max(F.zip_with("_new", "_old", lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    return gate(joined, name, F.count_if(F.coalesce(gap <= tolerance, F.lit(False))), F.count("*"))


def manifest_current(manifest: DataFrame, inventory: DataFrame, statuses: list[str], name: str) -> DataFrame:
    """Listed artifacts still have the recorded hash and size, and the manifest is in an accepted state."""
    now = inventory.select("path", F.col("sha256").alias("_s"), F.col("size_bytes").alias("_b"))
    joined = manifest.join(now, "path", "left")
    good = (F.col("sha256").eqNullSafe(F.col("_s")) & F.col("size_bytes").eqNullSafe(F.col("_b"))
            & F.col("status").isin(statuses))
    return gate(joined, name, F.count_if(good), F.count("*"))


def aligned(tables: list[DataFrame], key: str, name: str) -> DataFrame:
    """Several matrices share exactly the same row keys."""
    tagged = reduce(lambda a, b: a.unionByName(b), [
        df.select(key, F.lit(i).alias("_t")) for i, df in enumerate(tables)])
    per = tagged.groupBy(key).agg(F.count("*").alias("_n"), F.count_distinct("_t").alias("_d"))
    whole = (F.col("_n") == len(tables)) & (F.col("_d") == len(tables))
    return gate(per, name, F.count_if(whole), F.count("*"))


def no_constant_features(sets: DataFrame, keys: list[str], column: str, dim: int, name: str) -> DataFrame:
    """Features that do not vary inside a set, summed over sets."""
    spans = [F.when(F.min(F.col(column)[i]) == F.max(F.col(column)[i]), 1).otherwise(0) for i in range(dim)]
    per = sets.groupBy(*keys).agg(F.array(*spans).alias("_f"))
    return gate(per, name, F.sum(F.aggregate("_f", F.lit(0), lambda s, x: s + x)), 0)
