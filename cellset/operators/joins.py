"""Keyed, ranged and agreement joins. No side is broadcast by force: the planner decides from measured sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellset.functions import vectors as V
from cellset.operators.scale import with_last

GRID = 1 << 16  # cells of an index range handled as one unit


def lookup_strict(df: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """Attach ``value``; a key that the dimension lacks fails the job."""
    joined = df.join(dim.select(key, F.col(value).alias("_found")), key, "left")
    message = F.concat(F.lit(f"no {value} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    known = F.assert_true(F.col("_found").isNotNull(), message).isNull()  # a filter, so it is checked whatever is read
    return joined.where(known).withColumn(value, F.col("_found")).drop("_found")


def attach_controls(conditions: DataFrame, pools: DataFrame, agree: list[str]) -> DataFrame:
    """Many-to-one join on the pool with ``pool_found`` and one ``<column>_agrees`` flag per shared column.

    A condition without a pool is kept; nothing of it agrees.
    """
    side = pools.select("control_pool_id", "control_cells", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in agree])
    joined = conditions.join(side, "control_pool_id", "left").withColumn("pool_found", F.coalesce("_hit", F.lit(False)))
    flags = {f"{c}_agrees": F.col("pool_found") & F.col(c).eqNullSafe(F.col(f"_{c}")) for c in agree}
    return joined.withColumns(flags).drop("_hit", *[f"_{c}" for c in agree])


def unique_side(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself, after the check that ``keys`` are unique; only the keys are read for it, and a repeated one raises at once."""
    if not df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        raise ValueError(f"join key {keys} is not unique")
    return df


def join_validated(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
                   cardinality: str = "many_to_one") -> DataFrame:
    """Join that verifies which sides have unique keys; unmatched left rows are kept with ``matched`` false."""
    many_left, many_right = [side == "many" for side in cardinality.split("_to_")]
    left = left if many_left else unique_side(left, on)
    right = (right if many_right else unique_side(right, on)).withColumn("_hit", F.lit(True))
    joined = left.join(right, on, how)
    return joined.withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def compare_dimensions(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer comparison: ``membership`` and one match flag per column."""
    left = a.select(key, *[F.col(c).alias(f"first_{c}") for c in columns], F.lit(True).alias("_a"))
    right = b.select(key, *[F.col(c).alias(f"second_{c}") for c in columns], F.lit(True).alias("_b"))
    joined = left.join(right, key, "full_outer")
    membership = F.when(F.col("_b").isNull(), "first_only").when(F.col("_a").isNull(), "second_only").otherwise("both")
    flags = {f"{c}_match": F.coalesce(F.col(f"first_{c}") == F.col(f"second_{c}"), F.lit(False)) for c in columns}
    return joined.withColumn("membership", membership).withColumns(flags).drop("_a", "_b")


def compatibility(compared: DataFrame, columns: list[str]) -> DataFrame:
    """A: same keys and values; B: same keys, other values; C: different key sets."""
    both = F.col("membership") == "both"
    same = reduce(lambda x, y: x & y, [F.col(f"{c}_match") for c in columns])
    counts = compared.agg(
        F.count_if(both).alias("both"), F.count_if(F.col("membership") == "first_only").alias("first_only"),
        F.count_if(F.col("membership") == "second_only").alias("second_only"),
        F.count_if(both & ~same).alias("changed"))
    differs = (F.col("first_only") > 0) | (F.col("second_only") > 0)
    return counts.withColumn("case", F.when(differs, "C").when(F.col("changed") > 0, "B").otherwise("A"))


def diff_results(a: DataFrame, b: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Largest absolute difference per column over matching keys, and the keys that only one side has."""
    left = a.select(*key, F.lit(True).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    joined = left.join(b.select(*key, F.lit(True).alias("_b"), *columns), key, "full_outer")
    return joined.agg(
        F.count_if(F.col("_a") & F.col("_b")).alias("rows"), F.count_if(F.col("_b").isNull()).alias("only_first"),
        F.count_if(F.col("_a").isNull()).alias("only_second"),
        *[F.max(F.abs(F.col(f"_a_{c}") - F.col(c))).alias(f"max_abs_{c}") for c in columns])


def restrict_plan(plan: DataFrame, selected: DataFrame) -> DataFrame:
    """Keep planned rows whose source index was selected; attach the new index and whether owners agree."""
    chosen = selected.select("source_index", "new_index", F.col("owner_id").alias("_owner"))
    joined = plan.join(chosen, "source_index")
    return joined.withColumn("owner_agrees", F.col("owner_id").eqNullSafe(F.col("_owner"))).drop("_owner")


def reindex_plan(plan: DataFrame, ranges: DataFrame, fixed: DataFrame) -> DataFrame:
    """New index of each planned row: treated rows keep their offset in the owner's range, fixed rows are looked up.

    Rows outside their owner's range, without a range or without a fixed index stay, with a NULL index.
    """
    treated = plan.where("owner_type = 0").join(
        ranges.select("owner_id", "old_start", "old_stop", "new_start"), "owner_id", "left")
    inside = (F.col("source_index") >= F.col("old_start")) & (F.col("source_index") < F.col("old_stop"))
    moved = treated.withColumn("new_index", F.when(inside, F.col("new_start") + F.col("source_index") - F.col("old_start")))
    kept = plan.where("owner_type = 1").join(fixed.select("source_index", "new_index"), "source_index", "left")
    columns = [*plan.columns, "new_index"]
    return moved.select(*columns).unionByName(kept.select(*columns))


def verify_owner(cells: DataFrame, owners: DataFrame, columns: list[str]) -> DataFrame:
    """Cells whose owner is unknown or disagrees with them: equal columns, and the sample in the owner's pipe list."""
    side = owners.select("owner_id", F.lit(True).alias("_hit"), F.col("samples").alias("_samples"),
                         *[F.col(c).alias(f"_{c}") for c in columns])
    joined = cells.join(side, "owner_id", "left")
    known = F.coalesce("_hit", F.lit(False))
    flags = {"owner_known": known, **{f"{c}_ok": known & F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns}}
    flags["sample_ok"] = F.coalesce(F.array_contains(F.split("_samples", r"\|"), F.col("sample_id")), F.lit(False))
    good = reduce(lambda a, b: a & b, [F.col(name) for name in flags])
    return joined.withColumns(flags).where(~good).select("cell_id", "owner_id", *flags)


def expand_ranges(ranges: DataFrame, keys: list[str], name: str = "cell_index", chunk: int = GRID) -> DataFrame:
    """One row per index of each half-open range; long ranges are cut and spread before they are expanded."""
    pieces = ranges.where("stop > start").select(*keys, "start", "stop", F.explode(
        F.sequence("start", F.col("stop") - 1, F.lit(chunk).cast("long"))).alias("_from"))
    spread = pieces.repartition(F.col("_from"))
    last = F.least(F.col("_from") + chunk, F.col("stop")) - 1
    return spread.select(*keys, F.explode(F.sequence("_from", last)).alias(name))


def range_join(cells: DataFrame, ranges: DataFrame, index: str = "cell_index", grid: int = GRID) -> DataFrame:
    """Attach to each cell the range that owns its index.

    Both sides meet on grid numbers, so the join is by equality; a long range touches many grid units and a unit
    holds at most ``grid`` distinct indexes.
    """
    pieces = ranges.where("stop > start").withColumn("_unit", F.explode(F.sequence(
        F.floor(F.col("start") / grid), F.floor((F.col("stop") - 1) / grid))))
    joined = cells.withColumn("_unit", F.floor(F.col(index) / grid)).join(pieces, "_unit")
    return joined.where((F.col(index) >= F.col("start")) & (F.col(index) < F.col("stop"))).drop("_unit")


def owner_join(cells: DataFrame, ranges: DataFrame, index: str = "cell_index") -> DataFrame:
    """Attach to each cell the one of the disjoint half-open ``ranges`` that owns its index; cells of no range are left out.

    Cells and range starts are put in one order; each cell takes the last start before it, which crosses the heads of the sort's
    partitions where a range is longer than one. Nothing depends on how long or how many the ranges are. Empty ranges are
    ignored; ranges that overlap fail the job (``range_join`` takes those).
    """
    own = [c for c in ranges.columns if c not in ("start", "stop")]
    heads = ranges.where("stop > start").select(
        F.col("start").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col("stop").cast("long").alias("_tie"),
        F.struct("start", "stop", *own).alias("_range"), F.lit(None).cast(T.StructType(cells.schema.fields)).alias("_cell"))
    rows = cells.where(F.col(index).isNotNull()).select(
        F.col(index).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_tie"),
        F.lit(None).cast(heads.schema["_range"].dataType).alias("_range"), F.struct(*cells.columns).alias("_cell"))
    known = with_last(heads.unionByName(rows), ["_at", "_kind", "_tie"], "_range", "_owner")
    apart = F.assert_true(F.col("_owner").isNull() | (F.col("_owner.stop") <= F.col("_at")), F.lit("ranges overlap"))
    # one condition for both kinds of rows, so that no filter passes the check by
    owned = F.when(F.col("_kind") == 0, apart.isNotNull()).otherwise(F.col("_at") < F.col("_owner.stop"))
    return known.where(owned).select("_cell.*", *[F.col(f"_owner.{c}").alias(c) for c in ("start", "stop", *own)])


def gather(sets: DataFrame, vectors: DataFrame, key: str = "cell_index") -> DataFrame:
    """Vectors of set members; a member without a vector stays, with NULL."""
    return sets.join(vectors, key, "left")


def keep_seen(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    return df.join(reference.select(key), key, "left_semi")


def unseen(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    return df.join(reference.select(key), key, "left_anti")


def paired_cells(plan: DataFrame, latent: DataFrame, target: DataFrame, split: str) -> DataFrame:
    """Latent and target of every planned cell of one split; ``complete`` is false where either is missing."""
    left = latent.withColumn("_l", F.lit(True))
    right = target.withColumn("_t", F.lit(True))
    joined = plan.where(F.col("split") == split).join(left, "cell_index", "left").join(right, "cell_index", "left")
    return joined.withColumn("complete", F.coalesce(F.col("_l") & F.col("_t"), F.lit(False))).drop("_l", "_t")


def assert_same(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: rows only on one side and mismatches per column; all zero means the tables agree."""
    compared = compare_dimensions(a, b, key, columns)
    both = F.col("membership") == "both"
    return compared.agg(
        F.count_if(F.col("membership") == "first_only").alias("only_first"),
        F.count_if(F.col("membership") == "second_only").alias("only_second"),
        *[F.count_if(both & ~F.col(f"{c}_match")).alias(f"{c}_differs") for c in columns])


def align_branches(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two result tables side by side; rows of one table only, or drawn from different members, are flagged."""
    left = a.select(*keys, F.col(value).alias(f"first_{value}"), F.col("digest").alias("_d1"))
    right = b.select(*keys, F.col(value).alias(f"second_{value}"), F.col("digest").alias("_d2"))
    same = F.coalesce(F.col("_d1") == F.col("_d2"), F.lit(False))
    return left.join(right, keys, "full_outer").withColumn("same_members", same).drop("_d1", "_d2")


def parity(a: DataFrame, b: DataFrame, key: str, column: str, rtol: float, atol: float,
           thresholds: dict[str, float]) -> DataFrame:
    """Element-wise and row-wise agreement of two vector tables with a verdict.

    A row that one table lacks is counted as ``missing``, and tables with such rows aren't consistent.
    """
    joined = a.select(key, F.col(column).alias("_a")).join(b.select(key, F.col(column).alias("_b")), key, "full_outer")
    x, y = F.col("_a"), F.col("_b")
    gap = F.zip_with(x, y, lambda p, q: F.abs(p.cast("double") - q.cast("double")))
    close = F.forall(F.arrays_zip(x, y), lambda e: F.abs(e["_a"].cast("double") - e["_b"].cast("double"))
                     <= F.lit(atol) + F.lit(rtol) * F.abs(e["_b"].cast("double")))
    rows = joined.select(
        (x.isNull() | y.isNull()).alias("missing"), F.array_max(gap).alias("gap"), V.total(gap).alias("gap_sum"), F.size(x).alias("n"),
        (V.l2_distance(x, y) / F.greatest(V.l2_norm(y), F.lit(V.FLOOR))).alias("rel"),
        V.cosine(x, y).alias("cos"), close.alias("close"))
    out = rows.agg(
        F.count_if(~F.col("missing")).alias("rows"), F.count_if("missing").alias("missing"), F.max("gap").alias("max_abs"), (F.sum("gap_sum") / F.sum("n")).alias("mean_abs"),
        F.max("rel").alias("max_relative_l2"), F.min("cos").alias("min_cosine"), F.bool_and("close").alias("allclose"))
    verdict: Column = ((F.col("missing") == 0) & (F.col("max_abs") <= thresholds["max_abs"]) & (F.col("mean_abs") <= thresholds["mean_abs"])
                       & (F.col("max_relative_l2") <= thresholds["max_relative_l2"])
                       & (F.col("min_cosine") >= thresholds["min_cosine"]))
    return out.withColumn("consistent", verdict)
