"""Ordered operators: indexes, ranges, ranks, running results, caps and selections by order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellset.functions.hashing import SEED, seeded_hash
from cellset.operators.scale import first_in_order, place_in_group, running_total, top_per_group, with_previous
from cellset.session import materialize


def coverage_rounds(pool: DataFrame, strata: list[str], order: list[str]) -> DataFrame:
    """How often the row's drug, and its control pool, came earlier in its stratum; the round is the larger one."""
    by_drug = place_in_group(pool, [*strata, "drug"], order, "drug_round")
    both = place_in_group(by_drug, [*strata, "control_pool_id"], order, "control_round")
    return both.withColumn("coverage_round", F.greatest("drug_round", "control_round"))


def assign_ranges(owners: DataFrame, order: list[str], count: str = "cells") -> DataFrame:
    """Back-to-back half-open ranges on one cursor in the given order."""
    table = running_total(owners, [], order, F.col(count), "stop")
    return table.withColumn("start", F.col("stop") - F.col(count))


def csr_offsets(cells: DataFrame, order: list[str], column: str = "genes") -> DataFrame:
    """Begin and end of each row's entries in the concatenated list."""
    table = running_total(cells.select(*order, F.size(column).cast("long").alias("length")), [], order,
                          F.col("length"), "offset_end")
    return table.withColumn("offset_begin", F.col("offset_end") - F.col("length"))


def avg_rank(df: DataFrame, by: list[str], column: str, name: str = "rank") -> DataFrame:
    """1-based average rank with ties. Ranks are computed once per distinct value, then joined back."""
    copies = df.groupBy(*by, column).agg(F.count("*").alias("_ties"))
    before = running_total(copies, by, [column], F.col("_ties"), "_before", inclusive=False)
    ranks = before.select(*by, column, (F.col("_before") + (F.col("_ties") + 1) / 2.0).alias(name))
    return df.join(ranks, [*by, column])


def row_rank(by: list[str], column: Column) -> Column:
    """Average rank inside a group that one row set bounds (the genes of one comparison)."""
    w = Window.partitionBy(*by).orderBy(column)
    ties = F.count("*").over(Window.partitionBy(*by, column))
    return F.rank().over(w) + (ties - 1) / 2.0


def average_precision(df: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Area under the precision-recall steps; tied scores form one step. NULL when labels have one class.

    Tied scores are merged first, so the window holds one row per distinct score of one comparison.
    """
    steps = df.groupBy(*by, score).agg(F.sum(label).alias("_hits"), F.count("*").alias("_n"))
    down = Window.partitionBy(*by).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    curve = steps.withColumns({
        "_tp": F.sum("_hits").over(down), "_seen": F.sum("_n").over(down),
        "_pos": F.sum("_hits").over(whole), "_all": F.sum("_n").over(whole)})
    gain = F.try_divide(F.col("_hits"), F.col("_pos")) * F.col("_tp") / F.col("_seen")
    out = curve.groupBy(*by).agg(F.sum(gain).alias("_ap"), F.max("_pos").alias("positives"), F.max("_all").alias("_all"))
    mixed = (F.col("positives") > 0) & (F.col("positives") < F.col("_all"))
    return out.select(*by, "positives", F.when(mixed, F.col("_ap")).alias("auprc"),
                      F.when(mixed, "").otherwise("single_class_true_labels").alias("reason"))


def check_ranges(ranges: DataFrame, order: list[str]) -> DataFrame:
    """First start 0, every start equal to the stop before it, stop - start equal to the count."""
    seen = with_previous(ranges, order, "stop", "_stop")
    return seen.agg(
        F.count("*").alias("ranges"), F.min("start").alias("first_start"), F.max("stop").alias("last_stop"),
        F.count_if(F.col("start") != F.coalesce(F.col("_stop"), F.lit(0))).alias("broken"),
        F.count_if(F.col("stop") - F.col("start") != F.col("cells")).alias("wrong_length"))


def best_so_far(history: DataFrame, run: list[str], step: str, loss: str, patience: int, tolerance: float = 0.0
                ) -> DataFrame:
    """Running best of a loss per run, whether each step improved it, steps since, and the stop flag."""
    w = Window.partitionBy(*run).orderBy(step)
    before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = history.withColumns({"_best": before, "_n": F.row_number().over(w)}).withColumn(
        "improved", F.col("_best").isNull() | (F.col(loss) < F.col("_best") - tolerance))
    last = F.max(F.when(F.col("improved"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("best", F.least(F.col(loss), F.coalesce("_best", F.col(loss)))).withColumn(
        "since_best", (F.col("_n") - last).cast("long"))
    return out.withColumn("stop", F.col("since_best") >= patience).drop("_best", "_n")


def bh_adjust(df: DataFrame, by: list[str], p: str, tie: str) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values over the genes of one comparison."""
    group = Window.partitionBy(*by)
    rank = F.row_number().over(group.orderBy(p, tie))
    scaled = df.withColumns({"_rank": rank, "_m": F.count("*").over(group)}).withColumn(
        "_q", F.col(p) * F.col("_m") / F.col("_rank"))
    up = group.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return scaled.withColumn("p_adjusted", F.least(F.min("_q").over(up), F.lit(1.0))).drop("_rank", "_m", "_q")


def stable_sort(df: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Total order; callers must end ``keys`` with a unique column because Spark's sort is not stable."""
    return df.orderBy(*keys)


def top_variance_panel(stats: DataFrame, k: int) -> DataFrame:
    """``k`` genes of highest variance, ties by gene index, with their rank in gene order of the selection."""
    best = stats.orderBy(F.col("variance").desc(), "gene_index").limit(k)
    ranked = best.agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("variance")).alias("key"), "gene_index", "mean", "variance", "detection_rate"))).alias("g"))
    return ranked.select(F.posexplode("g").alias("panel_rank", "e")).select(
        F.col("panel_rank").cast("long").alias("panel_rank"), "e.gene_index", "e.mean", "e.variance", "e.detection_rate")


def hash_top_k(df: DataFrame, by: list[str], cap: int, salt: str, key: str, seed: int = SEED) -> DataFrame:
    """Keep the ``cap`` rows of each group with the smallest seeded hash (the pool cap)."""
    hashed = df.withColumn("_hash", seeded_hash(salt, *[F.col(c) for c in by], F.col(key), seed=seed))
    return top_per_group(hashed, by, [F.col("_hash"), F.col(key)], cap, F.col(key)).drop("_hash")


def fill_quota(pool: DataFrame, strata: list[str], order: list[Column], key: str, need: str = "need") -> DataFrame:
    """First ``need`` rows of each stratum in coverage order."""
    return top_per_group(pool, strata, order, F.col(need), F.col(key))


def top_n_variable(df: DataFrame, by: list[str], magnitude: Column, tie: str, n: str) -> DataFrame:
    """First ``n`` genes of each comparison by magnitude; ``n`` is a column of the comparison."""
    w = Window.partitionBy(*by).orderBy(magnitude.desc(), F.col(tie))
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= F.col(n)).drop("_place")


def arg_best(df: DataFrame, value: str, largest: bool, ties: list[Column], by: list[str] | None = None) -> DataFrame:
    """Row with the best value; ties by the given columns."""
    sign = -F.col(value) if largest else F.col(value)
    row = F.struct(*df.columns)
    return df.groupBy(*(by or [])).agg(F.min_by(row, F.struct(sign, *ties)).alias("_r")).select("_r.*")


def cap_rows(df: DataFrame, order: list[str], total: int | None = None, per_shard: int | None = None,
             per_block: int | None = None) -> DataFrame:
    """First rows of each shard and of each block inside it, then of the whole, in physical order.

    The cap of the whole is a boundary and a filter; only what the other caps left is written before it.
    """
    table = df
    if per_block is not None:
        table = top_per_group(table, ["shard", "block"], [F.col(c) for c in order], per_block, F.col(order[-1]))
    if per_shard is not None:
        table = top_per_group(table, ["shard"], [F.col(c) for c in order], per_shard, F.col(order[-1]))
    if total is not None:
        table = first_in_order(materialize(table) if table is not df else table, order, total)
    return table


def spot_indices(n: Column, k: int) -> Column:
    """At most ``k`` distinct evenly spaced positions of 0..n-1, first and last included."""
    even = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / F.lit(float(max(k - 1, 1)))))
    return F.array_distinct(even)


def physical_order(plan: DataFrame, columns: list[str]) -> DataFrame:
    """Range-partitioned and sorted by storage place, so every file region is read by one task in order."""
    return plan.repartitionByRange(*columns).sortWithinPartitions(*columns)


def canonical_order(sets: DataFrame, by: list[str], member: str = "cell_index") -> DataFrame:
    """Members of each (bounded) set as an ascending list."""
    return sets.groupBy(*by).agg(F.array_sort(F.collect_list(member)).alias("members"))
