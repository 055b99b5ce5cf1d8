"""Set-level metrics and evaluation tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellset.functions import vectors as V
from cellset.functions.numbers import correlation, defined
from cellset.operators import tiles
from cellset.operators.scale import running_total
from cellset.operators.windows import avg_rank, bh_adjust, row_rank
from cellset.session import materialize


def one_pool(df: DataFrame) -> DataFrame:
    """Mark all rows as belonging to the same pool."""
    return df.withColumn("pool", F.lit("all"))


def set_pairs(a: DataFrame, b: DataFrame, keys: list[str], row_id: str, vector: str, dim: int,
              pool: list[str] | None = None) -> DataFrame:
    """Distances of all pairs (a, b) of each group, reduced block by block to count, sum, min and max.

    With ``pool`` the groups of ``a`` share the members of ``b`` that have the same pool keys.
    """
    pairs = tiles.block_pairs(tiles.blocks(a, keys, row_id, vector), tiles.blocks(b, pool or keys, row_id, vector), keys,
                              on=pool)
    return tiles.pair_moments(pairs, keys, dim)


def energy_distance(a: DataFrame, b: DataFrame, keys: list[str], row_id: str, vector: str, dim: int,
                    pool: list[str] | None = None) -> DataFrame:
    """``E d(x,y) - E d(x,x')/2 - E d(y,y')/2`` per group, Euclidean, all pairs including self.

    ``pool`` (a part of ``keys``) names the keys of ``b`` when several groups share it: its own term is computed once.
    """
    x = materialize(tiles.blocks(a, keys, row_id, vector))
    shared = pool or keys
    y = materialize(tiles.blocks(b, shared, row_id, vector))
    mean = lambda p, q, by, on, name: tiles.pair_moments(
        tiles.block_pairs(p, q, by, on=on), by, dim).select(*by, (F.col("total") / F.col("pairs")).alias(name))
    within = tiles.join_groups(mean(x, y, keys, shared, "_xy"), mean(x, x, keys, keys, "_xx"), keys)
    joined = tiles.join_groups(within, mean(y, y, shared, shared, "_yy"), shared)
    return joined.select(*keys, (F.col("_xy") - F.col("_xx") / 2 - F.col("_yy") / 2).alias("energy_distance"))


def pairwise_structure(vecs: DataFrame, keys: list[str], row_id: str, vector: str, dim: int,
                       metrics: tuple[str, ...] = ("cosine", "euclidean")) -> DataFrame:
    """min, median, mean, std and max of all pair distances (upper triangle) of each group and metric."""
    packed = materialize(tiles.blocks(vecs, keys, row_id, vector))
    pairs = tiles.block_pairs(packed, packed, keys, triangle=True)
    # inside different blocks every pair counts once because only a_block < b_block is kept
    out = None
    for metric in metrics:
        moments = materialize(tiles.pair_moments(pairs, keys, dim, metric, triangle=True))
        median = tiles.pair_median(pairs, moments, keys, dim, metric, triangle=True)
        mean = F.try_divide("total", "pairs")  # a group of one member has no pair
        table = tiles.join_groups(moments, median, keys, "left").select(
            *keys, F.lit(metric).alias("metric"), "pairs", "min", "median", mean.alias("mean"),
            F.when(mean.isNotNull(), F.sqrt(F.greatest(F.try_divide("squares", "pairs") - mean * mean, F.lit(0.0)))).alias("std"), "max")
        out = table if out is None else out.unionByName(table)
    return out


def structure_correlation(sets: DataFrame, keys: list[str], row_id: str, first: str, second: str) -> DataFrame:
    """Pearson and Spearman between two pairwise-distance triangles of the same sets, of any size.

    Exact average ranks are counted in parts of a triangle, against distances that are computed anew for each part: only sums leave a
    task, no pair is written or sent. NULL where a triangle is constant or has less than two pairs; repeated ids form no pair with
    themselves.
    """
    sizes = sets.select(F.size(first).alias("a"), F.size(second).alias("b")).first()
    groups = sets.select(*keys).distinct()
    if sizes is None:
        return groups.selectExpr(*keys, "0L as pairs", "cast(null as double) as pearson", "cast(null as double) as spearman")
    both = sets.where(F.col(row_id).isNotNull()).select(*keys, row_id, F.concat(first, second).alias("_v"))
    packed = materialize(tiles.blocks(both, keys, row_id, "_v"))
    parts = materialize(tiles.triangle_parts(packed, keys, sizes.a, sizes.a + sizes.b))
    flat = (F.min("x_min") == F.max("x_max")) | (F.min("y_min") == F.max("y_max")) | (F.sum("n") < 2)
    cosine = lambda p: F.when(~flat, F.try_divide(F.sum(f"{p}xy"), F.sqrt(F.sum(f"{p}xx") * F.sum(f"{p}yy"))))
    found = parts.groupBy(*keys).agg(F.sum("n").alias("pairs"), cosine("").alias("pearson"), cosine("rank_").alias("spearman"))
    return tiles.join_groups(groups, found, keys, "left").select(*keys, F.coalesce("pairs", F.lit(0).cast("long")).alias("pairs"), "pearson", "spearman")


def context_ranks(rows: DataFrame, context: list[str], row_id: str, prediction: str, truth: str,
                  block: int = tiles.BLOCK) -> DataFrame:
    """For every prediction: how many truths of its context lie closer (L1) than its own; ties by id.

    Predictions meet blocks of truths, and each meeting returns one count, never the pairs themselves.
    """
    sizes = rows.groupBy(*context).agg(F.count("*").alias("candidates"),
                                       F.ceil(F.count("*") / block).alias("_blocks"))
    own = rows.select(*context, row_id, prediction, V.l1_distance(F.col(prediction), F.col(truth)).alias("own_distance"))
    sized = own.join(sizes, context).withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    truths = rows.join(sizes, context).select(
        *context, F.pmod(F.xxhash64(row_id), F.col("_blocks")).alias("_b"),
        F.struct(F.col(row_id).alias("i"), F.col(truth).alias("t")).alias("_t"))
    packed = truths.groupBy(*context, "_b").agg(F.collect_list("_t").alias("_ts"))
    measured = F.transform("_ts", lambda m: F.struct(
        m.getField("i").alias("i"), V.l1_distance(F.col(prediction), m.getField("t")).alias("d")))
    closer = V.count_where(measured, lambda m: (m.getField("i") != F.col(row_id)) & (
        (m.getField("d") < F.col("own_distance"))
        | ((m.getField("d") == F.col("own_distance")) & (m.getField("i") < F.col(row_id)))))
    met = sized.join(packed, [*context, "_b"]).withColumn("_closer", closer)
    return met.groupBy(*context, row_id).agg(
        F.max("candidates").alias("candidates"), F.max("own_distance").alias("own_distance"),
        F.sum("_closer").alias("rank"))


def context_pds(rows: DataFrame, context: list[str], row_id: str, prediction: str, truth: str) -> DataFrame:
    """Context discrimination: mean of ``1 - rank / K``; contexts of one condition give no row."""
    ranks = context_ranks(rows, context, row_id, prediction, truth).where("candidates >= 2")
    return ranks.groupBy(*context).agg(
        F.max("candidates").alias("candidates"), F.avg(1 - F.col("rank") / F.col("candidates")).alias("context_score"))


def centroid_metrics(prediction: Column, truth: Column) -> dict[str, Column]:
    """Cosine and L2 error between predicted and true centroid deltas."""
    return {"centroid_cosine": V.cosine(prediction, truth), "centroid_l2": V.l2_distance(prediction, truth)}


def genes_long(rows: DataFrame, keys: list[str], prediction: str, truth: str, labels: str | None = None) -> DataFrame:
    """One row per (comparison, gene) from the vectors of a comparison."""
    parts = [F.col(prediction).alias("p"), F.col(truth).alias("t")]
    if labels:
        parts.append(F.col(labels).alias("y"))
    return rows.select(*keys, F.posexplode(F.arrays_zip(*parts)).alias("gene", "e")).select(*keys, "gene", "e.*")


def spearman(rows: DataFrame, keys: list[str], prediction: str, truth: str) -> DataFrame:
    """Rank correlation across genes; the windows hold the genes of one comparison."""
    long = genes_long(rows, keys, prediction, truth)
    ranked = long.select(*keys, row_rank(keys, F.col("p")).alias("rp"), row_rank(keys, F.col("t")).alias("rt"))
    return ranked.groupBy(*keys).agg(correlation(F.col("rp"), F.col("rt")).alias("spearman"))


def condition_metrics(rows: DataFrame, keys: list[str], prediction: str, truth: str, labels: str) -> DataFrame:
    """All per-condition metrics of one branch: errors, correlations, DES, AUPRC with reason, norms.

    Vector metrics are row expressions. Rank metrics share one exchange on the comparison keys.
    """
    p, t, y = F.col(prediction), F.col(truth), F.col(labels)
    base = rows.select(*keys, V.mean_abs_error(p, t).alias("mae"), V.mean_sq_error(p, t).alias("mse"),
                       V.pearson(p, t).alias("pearson_delta"), V.l2_norm(t).alias("true_delta_norm"),
                       V.l2_norm(p).alias("pred_delta_norm"),
                       F.aggregate(y, F.lit(0), lambda s, x: s + x.cast("int")).alias("true_deg_count"))
    size = F.abs("p")
    down = Window.partitionBy(*keys).orderBy(size.desc())
    tied = down.rangeBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy(*keys)
    long = genes_long(rows, keys, prediction, truth, labels).withColumn("y", F.col("y").cast("int"))
    ranked = long.withColumns({
        "rp": row_rank(keys, F.col("p")), "rt": row_rank(keys, F.col("t")),
        "_place": F.row_number().over(Window.partitionBy(*keys).orderBy(size.desc(), "gene")),
        "_tp": F.sum("y").over(tied), "_seen": F.count("*").over(tied),
        "_pos": F.sum("y").over(group), "_all": F.count("*").over(group)})
    hit = F.when(F.col("_place") <= F.col("_pos"), F.col("y"))
    rank_metrics = ranked.groupBy(*keys).agg(
        correlation(F.col("rp"), F.col("rt")).alias("spearman_delta"),
        F.try_divide(F.sum(hit), F.max("_pos")).alias("set_level_des"),
        F.when((F.max("_pos") > 0) & (F.max("_pos") < F.max("_all")),
               F.sum(F.col("y") * F.col("_tp") / F.col("_seen")) / F.max("_pos")).alias("auprc"))
    return base.join(rank_metrics, keys).withColumn(
        "auprc_reason", F.when(F.col("auprc").isNull(), "single_class_true_labels").otherwise(""))


def magnitude_spearman(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Rank correlation of predicted and true delta norms over the conditions of each group."""
    one = avg_rank(metrics, by, "pred_delta_norm", "_rp")
    both = avg_rank(one, by, "true_delta_norm", "_rt")
    return both.groupBy(*by).agg(correlation(F.col("_rp"), F.col("_rt")).alias("delta_magnitude_spearman"))


def de_scores(cells: DataFrame, condition: str, pool: str, gene: str, value: str, control: Column) -> DataFrame:
    """Mann-Whitney U and tie-corrected z of treated against pool cells, per (condition, gene).

    Works on counts of distinct values: controls are ranked once per pool however many conditions share it, and no
    group is sorted in one place. ``condition`` is ignored on control rows.
    """
    control_counts = cells.where(control).groupBy(pool, gene, value).agg(F.count("*").alias("c0"))
    treated = cells.where(~control).groupBy(pool, condition, gene, value).agg(F.count("*").alias("c1"))
    grid = control_counts.unionByName(treated.select(pool, gene, value, F.lit(0).cast("long").alias("c0"))).groupBy(
        pool, gene, value).agg(F.sum("c0").alias("c0"))
    before = running_total(grid, [pool, gene], [value], F.col("c0"), "below", inclusive=False)
    cube = lambda c: c * c * c - c
    pool_totals = control_counts.groupBy(pool, gene).agg(F.sum("c0").alias("n0"), F.sum(cube(F.col("c0"))).alias("t0"))
    met = treated.join(before, [pool, gene, value])
    both = F.col("c0") + F.col("c1")
    sums = met.groupBy(pool, condition, gene).agg(
        F.sum(F.col("c1") * (F.col("below") + F.col("c0") / 2.0)).alias("u"), F.sum("c1").alias("n1"),
        F.sum(cube(both) - cube(F.col("c0"))).alias("dt")).join(pool_totals, [pool, gene])
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    variance = n1 * n0 / 12.0 * ((n + 1) - (F.col("t0") + F.col("dt")) / (n * (n - 1)))
    return sums.select(condition, pool, gene, "n1", "n0", "u",
                       F.try_divide(F.col("u") - n1 * n0 / 2.0, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("z"))


SERIES, FRACTION = 60, 40  # terms of the series below 4, levels of the continued fraction above


def two_sided_p(z: Column) -> Column:
    """Two-sided normal tail probability as a plain expression; error below 1e-12.

    Below 4 one minus the series of the central probability, ``2 phi(z) z (1 + z2/3 (1 + z2/5 (...)))``; from 4 on the continued
    fraction ``2 phi(z) / (z + 1 / (z + 2 / (z + ...)))``. NULL and NaN give NULL.
    """
    def tail(x):
        square, series, fraction = x * x, F.lit(1.0), x
        for k in range(SERIES, 0, -1):
            series = 1 + square / (2 * k + 1) * series
        for k in range(FRACTION, 0, -1):
            fraction = x + k / fraction
        density = F.exp(-square / 2) * (2.0 / (2.0 * math.pi) ** 0.5)
        return F.when(x < 4, 1 - density * x * series).otherwise(density / fraction)

    return F.get(F.transform(F.array(F.abs(defined(z.cast("double")))), tail), F.lit(0))


def two_sided_p_sql(z: str) -> str:
    """The same for DuckDB; ``z`` is a column name."""
    x = f"abs({z})"
    series, fraction = "1.0::double", x
    for k in range(SERIES, 0, -1):
        series = f"(1 + {x} * {x} / {2 * k + 1} * {series})"
    for k in range(FRACTION, 0, -1):
        fraction = f"({x} + {k} / {fraction})"
    density = f"(exp(-{z} * {z} / 2) * {2.0 / (2.0 * math.pi) ** 0.5!r}::double)"
    return f"case when {x} < 4 then 1 - {density} * {x} * {series} else {density} / {fraction} end"


def de_test(cells: DataFrame, condition: str, pool: str, gene: str, value: str, control: Column,
            alpha: float = 0.05) -> DataFrame:
    """Labels per (condition, gene): adjusted p below ``alpha``. A gene without spread is not significant."""
    scored = de_scores(cells, condition, pool, gene, value, control)
    tested = scored.withColumn("p", F.coalesce(two_sided_p(F.col("z")), F.lit(1.0)))
    return bh_adjust(tested, [condition], "p", gene).withColumn("significant", F.col("p_adjusted") < alpha)


def compare_branches(summary: DataFrame, base: str, other: str, smaller_is_better: list[str]) -> DataFrame:
    """Metric differences between two branches and whether the second one improves."""
    wide = summary.groupBy("metric").pivot("branch", [base, other]).agg(F.first("mean"))
    gap = F.col(other) - F.col(base)
    better = F.when(F.col("metric").isin(smaller_is_better), gap < 0).otherwise(gap > 0)
    return wide.select("metric", F.col(base).alias("first"), F.col(other).alias("second"), gap.alias("difference"),
                       F.when(gap == 0, "same").when(better, "improved").otherwise("degraded").alias("verdict"))


def select_candidate(rows: DataFrame, names: list[str], truth: str) -> DataFrame:
    """Winner of two prediction columns.

    Higher mean Pearson over rows where it is defined for all; equal values go to lower MAE. If any candidate is
    constant where the truth varies, lower MAE over all rows decides. Without any row where Pearson is defined for all there is
    nothing to decide by, and the job fails.
    """
    a, b = names
    t = F.col(truth)
    varies = ~V.constant(t)
    shared = varies & ~V.constant(F.col(a)) & ~V.constant(F.col(b))
    out = []
    for name in names:
        out += [F.avg(V.mean_abs_error(F.col(name), t)).alias(f"mae_{name}"),
                F.avg(F.when(shared, V.pearson(F.col(name), t))).alias(f"pearson_{name}"),
                F.count_if(varies & V.constant(F.col(name))).alias(f"undefined_{name}")]
    stats = rows.agg(*out)
    lower_mae = F.when(F.col(f"mae_{a}") <= F.col(f"mae_{b}"), a).otherwise(b)
    fallback = (F.col(f"undefined_{a}") > 0) | (F.col(f"undefined_{b}") > 0)
    by_pearson = F.when(F.col(f"pearson_{a}") == F.col(f"pearson_{b}"), lower_mae).when(
        F.col(f"pearson_{a}") > F.col(f"pearson_{b}"), a).otherwise(b)
    decided = fallback | (F.col(f"pearson_{a}").isNotNull() & F.col(f"pearson_{b}").isNotNull())
    known = F.assert_true(decided, F.lit("no row has a defined Pearson for both candidates")).isNull()
    return stats.where(known).withColumns({"fallback": fallback, "selected": F.when(fallback, lower_mae).otherwise(by_pearson)})


def majority_winner(metrics: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Vote over metrics with direction; ties in votes go to lower MAE, then lower corpus MSE.

    ``metrics`` has ``metric, direction (up/down), primary, first, second``; MAE and corpus MSE are rows of it.
    """
    gap = F.col("first") - F.col("second")
    tie = F.abs(gap) <= tolerance
    first_wins = F.when(F.col("direction") == "up", gap > 0).otherwise(gap < 0)
    winner = F.when(tie, "tie").when(first_wins, "first").otherwise("second")
    voted = metrics.withColumn("winner", winner)
    pick = lambda name: F.max(F.when(F.col("metric") == name, F.col("winner")))
    vote = lambda side: F.count_if(F.col("primary") & (F.col("winner") == side))
    out = voted.agg(vote("first").alias("first_votes"), vote("second").alias("second_votes"), pick("mae").alias("mae"),
                    pick("corpus_mse").alias("corpus_mse"))
    selected = (F.when(F.col("first_votes") > F.col("second_votes"), "first")
                .when(F.col("first_votes") < F.col("second_votes"), "second")
                .when(F.col("mae") != "tie", F.col("mae"))
                .otherwise(F.when(F.col("corpus_mse") == "first", "first").otherwise("second")))
    return out.withColumn("selected", selected)


def rollup_with_undefined(metrics: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """Mean of a metric with its undefined rows counted; those not explained by zero true genes are unexpected."""
    x = defined(F.col(metric).cast("double"))
    undefined = x.isNull()
    return metrics.groupBy(*by).agg(
        F.avg(x).alias("mean"), F.count(x).alias("valid_n"), F.count_if(undefined).alias("undefined_n"),
        F.count_if(undefined & (F.col("true_deg_count") != 0)).alias("unexpected_undefined_n"))


def excluded_rows(metrics: DataFrame, metric: str) -> DataFrame:
    x = defined(F.col(metric).cast("double"))
    return metrics.where(x.isNull()).withColumn(
        "reason", F.when(F.col("true_deg_count") == 0, "no_true_genes").otherwise("unexpected"))


def vector_error(rows: DataFrame, prediction: str, truth: str) -> DataFrame:
    """Macro mean absolute and squared error over rows."""
    p, t = F.col(prediction), F.col(truth)
    return rows.agg(F.count("*").alias("rows"), F.avg(V.mean_abs_error(p, t)).alias("macro_mae"),
                    F.avg(V.mean_sq_error(p, t)).alias("macro_mse"))
