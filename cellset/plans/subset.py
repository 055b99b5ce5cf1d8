"""Balanced, coverage-first choice of conditions and the cell plan that follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellset.functions.hashing import seeded_hash
from cellset.operators import clean
from cellset.operators.joins import keep_seen, lookup_strict, unseen
from cellset.operators.scale import dense_index
from cellset.operators.setops import union_all
from cellset.operators.windows import assign_ranges, coverage_rounds, fill_quota, hash_top_k
from cellset.session import materialize

STRATUM = ["cell_line_id", "dose_um"]


def stratum_quotas(candidates: DataFrame, totals: DataFrame) -> DataFrame:
    """Quota of each (split, cell line, dose): equal shares, the remainder to the first strata in hash order.

    ``totals`` has ``split, total``. A stratum with fewer candidates than its quota fails the job. The windows run
    over strata, whose number is the product of two small dimensions.
    """
    strata = candidates.groupBy("split", *STRATUM).agg(F.count("*").alias("capacity")).join(totals, "split")
    order = Window.partitionBy("split").orderBy(
        seeded_hash("stratum", F.col("cell_line_id"), F.col("dose_um")), *STRATUM)
    every = F.count("*").over(Window.partitionBy("split"))
    ranked = strata.withColumns({"_rank": F.row_number().over(order), "_n": every})
    quota = F.floor(F.col("total") / F.col("_n")) + (F.col("_rank") <= F.col("total") % F.col("_n")).cast("long")
    table = ranked.withColumn("quota", quota)
    fits = F.assert_true(F.col("capacity") >= F.col("quota"), F.lit("a stratum cannot fill its quota")).isNull()
    return table.where(fits).select("split", *STRATUM, "capacity", "quota")


def required_picks(candidates: DataFrame, quotas: DataFrame) -> DataFrame:
    """One condition per drug of each split: rarest drug first, into the stratum with most quota left, ties by hash.

    The choice depends on candidates only through the best hash of each (drug, stratum), so it is made on that
    aggregate, whose size is drugs x strata however many conditions there are.
    """
    hashed = candidates.withColumn("_pick", seeded_hash(
        "required-pick", F.col("split"), F.col("drug"), F.col("pair_id")))
    best = hashed.groupBy("split", "drug", *STRATUM).agg(
        F.min_by("pair_id", "_pick").alias("pair_id"), F.min("_pick").alias("pick"), F.count("*").alias("n"))
    table = best.withColumn("drug_hash", seeded_hash("required-drug", F.col("split"), F.col("drug"))).join(
        quotas.select("split", *STRATUM, "quota"), ["split", *STRATUM])

    def place(rows):
        left = {(r.cell_line_id, r.dose_um): r.quota for r in rows.itertuples()}
        sizes = rows.groupby(["drug", "drug_hash"])["n"].sum().reset_index().sort_values(["n", "drug_hash"])
        options = {drug: list(group.itertuples()) for drug, group in rows.groupby("drug")}
        chosen = []
        for drug in sizes["drug"]:
            ranked = sorted((-left[(o.cell_line_id, o.dose_um)], o.pick, o.pair_id, (o.cell_line_id, o.dose_um))
                            for o in options[drug] if left[(o.cell_line_id, o.dose_um)] > 0)
            if not ranked:
                raise RuntimeError(f"no stratum left for required drug {drug}")
            left[ranked[0][3]] -= 1
            chosen.append(ranked[0][2])
        return rows.head(0)[["pair_id"]].reindex(range(len(chosen))).assign(pair_id=chosen)

    return table.groupBy("split").applyInPandas(place, "pair_id string")


def select_conditions(candidates: DataFrame, totals: DataFrame) -> DataFrame:
    """Coverage-first balanced selection: every drug of a split once, then each stratum up to its quota."""
    candidates = materialize(candidates.withColumn("selection_hash", seeded_hash(
        "condition", F.col("split"), F.col("pair_id"))))
    quotas = materialize(stratum_quotas(candidates, totals))
    picked = materialize(required_picks(candidates, quotas))
    first = candidates.join(picked, "pair_id", "left_semi")
    placed = first.groupBy("split", *STRATUM).agg(F.count("*").alias("_placed"))
    need = quotas.join(placed, ["split", *STRATUM], "left").select(
        "split", *STRATUM, (F.col("quota") - F.coalesce("_placed", F.lit(0))).alias("need"))
    pool = candidates.join(picked, "pair_id", "left_anti").join(need, ["split", *STRATUM])
    rounds = coverage_rounds(pool, ["split", *STRATUM], ["selection_hash", "pair_id"])
    order = [F.col(c) for c in ("coverage_round", "drug_round", "control_round", "selection_hash", "pair_id")]
    filled = fill_quota(rounds, ["split", *STRATUM], order, "pair_id")
    columns = candidates.columns
    return union_all(first.select(*columns), filled.select(*columns))


def build_subset(conditions: DataFrame, pools: DataFrame, totals: DataFrame, size: int, cap: int,
                 splits: list[str]) -> tuple[DataFrame, DataFrame]:
    """Eligibility, unseen-drug exclusion, selection, contiguous indexes, controls and cell ranges.

    Returns (conditions, pools) with half-open ranges on one cursor: all treated cells first, then the pools.
    """
    vocab = clean.drug_vocabulary(conditions)
    usable = lookup_strict(clean.eligible(conditions, size), vocab, "drug", "drug_id")
    train = usable.where("split = 'train'")
    chosen = materialize(select_conditions(keep_seen(usable, train, "drug"), totals))
    place = F.array_position(F.lit(splits), F.col("split"))
    selected = dense_index(chosen.withColumn("_split", place), ["_split", *STRATUM, "plate", "pair_id"],
                           "condition_index").drop("_split")
    used = dense_index(pools.join(selected.select("control_pool_id"), "control_pool_id", "left_semi"),
                       ["plate", "cell_line_id", "control_pool_id"], "control_pool_index")
    used = used.withColumn("cached_cells", F.least(F.col("control_cells"), F.lit(cap)))
    treated = selected.select(F.lit(0).alias("owner_type"), F.col("condition_index").alias("owner_index"),
                              F.col("treated_cells").alias("cells"))
    control = used.select(F.lit(1).alias("owner_type"), F.col("control_pool_index").alias("owner_index"),
                          F.col("cached_cells").alias("cells"))
    ranges = assign_ranges(treated.unionByName(control), ["owner_type", "owner_index"])
    side = lambda kind, key: ranges.where(F.col("owner_type") == kind).select(
        F.col("owner_index").alias(key), "start", "stop")
    pools_out = materialize(used.join(side(1, "control_pool_index"), "control_pool_index"))
    conditions_out = selected.join(side(0, "condition_index"), "condition_index").join(
        pools_out.select("control_pool_id", "control_pool_index", F.col("cached_cells").alias("control_cached_cells"),
                         F.col("start").alias("control_start"), F.col("stop").alias("control_stop")), "control_pool_id")
    return conditions_out, pools_out


def excluded_unseen(conditions: DataFrame, size: int) -> DataFrame:
    usable = clean.eligible(conditions, size)
    return unseen(usable.where("split <> 'train'"), usable.where("split = 'train'"), "drug")


def build_cell_plan(conditions: DataFrame, pools: DataFrame, source: DataFrame, cap: int) -> DataFrame:
    """Planned cells ``cell_index, source_index, owner_type, owner_index``.

    Treated cells keep their order inside the condition's range; of each pool the ``cap`` cells with the smallest
    hash are kept, again in source order. ``source`` has ``source_index, owner_type, owner_id, place``, place being
    the 0-based position of the cell in its owner.
    """
    treated = source.where("owner_type = 0").join(
        conditions.select(F.col("pair_id").alias("owner_id"), F.col("condition_index").alias("owner_index"), "start"),
        "owner_id").withColumn("cell_index", F.col("start") + F.col("place"))
    kept = hash_top_k(source.where("owner_type = 1").join(
        pools.select(F.col("control_pool_id").alias("owner_id")), "owner_id", "left_semi"),
        ["owner_id"], cap, "control-cell", "source_index")
    # at most ``cap`` rows per pool are left, so this window is small
    order = F.row_number().over(Window.partitionBy("owner_id").orderBy("source_index")) - 1
    control = kept.withColumn("_i", order).join(
        pools.select(F.col("control_pool_id").alias("owner_id"), F.col("control_pool_index").alias("owner_index"),
                     "start"), "owner_id").withColumn("cell_index", F.col("start") + F.col("_i"))
    columns = ["cell_index", "source_index", "owner_type", "owner_index"]
    return treated.select(*columns).unionByName(control.select(*columns))


def rank_groups(conditions: DataFrame, splits: list[str]) -> DataFrame:
    """Rank cell lines by smallest split coverage, edges, conditions (all descending), then id."""
    edges = [F.count_distinct(F.when(F.col("split") == s, F.col("edge_id"))) for s in splits]
    stats = conditions.groupBy("cell_line_id").agg(
        F.least(*edges).alias("min_split_edges"), F.count_distinct("edge_id").alias("edges"),
        F.count("*").alias("conditions"))
    order = [F.col(c).desc() for c in ("min_split_edges", "edges", "conditions")]
    return dense_index(stats, [*order, "cell_line_id"], "rank")


def one_context_each(conditions: DataFrame) -> DataFrame:
    """One control pool per (cell line, split, dose), the one with most edges; then one condition per edge by hash."""
    group = ["cell_line_id", "split", "dose_um"]
    sizes = conditions.groupBy(*group, "control_pool_id").agg(F.count_distinct("edge_id").alias("edges"))
    key = F.struct((-F.col("edges")).alias("e"), seeded_hash("context", F.col("split"), F.col("dose_um"),
                                                            F.col("control_pool_id")).alias("h"))
    pools = sizes.groupBy(*group).agg(F.min_by("control_pool_id", key).alias("control_pool_id"))
    inside = conditions.join(pools, [*group, "control_pool_id"])
    priority = seeded_hash("one-per-edge", F.col("pair_id"))
    return inside.groupBy("edge_id").agg(F.min_by(F.struct("pair_id", "control_pool_id", *group), priority).alias("r")) \
        .select("edge_id", "r.*")


def set_sides(conditions: DataFrame) -> DataFrame:
    """Both sides of every condition as index ranges, the input of set sampling."""
    return conditions.select("pair_id", F.explode(F.array(
        F.struct(F.lit("treated").alias("side"), F.col("start").alias("start"), F.col("stop").alias("stop")),
        F.struct(F.lit("control").alias("side"), F.col("control_start").alias("start"),
                 F.col("control_stop").alias("stop")))).alias("s")).select("pair_id", "s.*")
