"""Evaluation plans composed from the metric operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellset.functions import vectors as V
from cellset.functions.numbers import correlation
from cellset.operators import aggregates as A
from cellset.operators import metrics as M
from cellset.operators.scale import dense_index, set_digest
from cellset.operators.tiles import join_groups
from cellset.operators.windows import row_rank
from cellset.session import materialize


def evaluation_plan(members: DataFrame, condition: str, member: str, column: str, dim: int) -> DataFrame:
    """Every condition and repeat with member count, member digest and ground-truth delta.

    Condition 0 is the control. Means and digests merge in one aggregate, so a set of any size is never gathered.
    """
    key = F.concat_ws("|", F.col(condition).cast("string"), F.col("repeat_epoch").cast("string"),
                      F.col(member).cast("string"))
    table = materialize(V.mean_vectors(members, ["repeat_epoch", condition], column, dim, "_mean", extra={
        "members": F.count("*"), "digest": set_digest(key)}))
    control = table.where(F.col(condition) == 0).select("repeat_epoch", F.col("_mean").alias("_control"))
    return table.where(F.col(condition) != 0).join(control, "repeat_epoch").select(
        "repeat_epoch", condition, "members", "digest", V.difference(F.col("_mean"), F.col("_control")).alias("true_delta"))


def drawn_plan(sets: DataFrame, expressions: DataFrame, conditions: DataFrame, n: int, column: str, dim: int,
               metadata: list[str]) -> DataFrame:
    """Evaluation plan on drawn sets: both member lists, their true delta and the condition's metadata, per condition and repeat.

    ``sets`` has ``pair_id, epoch, side, cell_index`` (see ``sample_sets``); each condition has its own control set. ``row_index``
    counts repeats first, then conditions. A side that is missing or hasn't ``n`` different members, a member without a
    finite vector and an unknown condition fail the job by name.
    """
    joined = sets.join(expressions.select("cell_index", F.col(column).alias("_v")), "cell_index", "left")
    known = F.coalesce(V.all_finite(F.col("_v")), F.lit(False))
    one = V.mean_vectors(joined, ["pair_id", "epoch", "side"], "_v", dim, "_mean", extra={
        "_members": F.array_sort(F.collect_list("cell_index")), "_undefined": F.count_if(~known)})  # n members a set
    side = lambda name, c: F.first(F.when(F.col("side") == name, F.col(c)), ignorenulls=True).alias(f"{name}{c}")
    both = one.groupBy("pair_id", "epoch").agg(*[side(s, c) for s in ("control", "treated") for c in ("_members", "_mean", "_undefined")])
    rows = both.join(conditions.select("pair_id", *metadata, F.lit(True).alias("_known")), "pair_id", "left")
    name = F.concat_ws(" ", F.lit(" of"), "pair_id", F.col("epoch").cast("string"))
    checks = [(F.coalesce("_known", F.lit(False)), "unknown condition")]
    for s in ("control", "treated"):
        members = F.col(f"{s}_members")
        checks += [(F.coalesce((F.size(members) == n) & (F.size(F.array_distinct(members)) == n), F.lit(False)), f"{s} set without {n} members"),
                   (F.col(f"{s}_undefined") == 0, f"{s} member without a finite vector")]
    sound = reduce(lambda a, b: a & b, [F.assert_true(test, F.concat(F.lit(what), name)).isNull() for test, what in checks])
    table = rows.where(sound).select(
        "pair_id", F.col("epoch").alias("repeat_epoch"), F.col("control_members").alias("control"), F.col("treated_members").alias("treated"),
        V.difference(F.col("treated_mean"), F.col("control_mean")).alias("true_delta"), *metadata)
    return dense_index(table, ["repeat_epoch", "pair_id"], "row_index")


def two_sided_metrics(rows: DataFrame, first: str, second: str, truth: str) -> DataFrame:
    """Metric table of two predictions for the vote: error, size, sharpness and corpus error."""
    t = F.col(truth)
    sides = {"first": F.col(first), "second": F.col(second)}
    stats = rows.agg(*[e.alias(f"{metric}_{side}") for side, p in sides.items() for metric, e in {
        "mae": F.avg(V.mean_abs_error(p, t)), "norm": F.avg(V.l2_norm(p)), "sharpness": F.avg(V.l2_norm(p)),
        "corpus_mse": F.avg(V.mean_sq_error(p, t))}.items()])
    rules = [("mae", "down", False), ("norm", "up", True), ("sharpness", "down", True), ("corpus_mse", "down", False)]
    return stats.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(d).alias("direction"), F.lit(p).alias("primary"),
                 F.col(f"{m}_first").alias("first"), F.col(f"{m}_second").alias("second")) for m, d, p in rules
    ])).alias("r")).select("r.*")


def context_diagnostics(cells: DataFrame, condition: str, column: str, dim: int, control: Column, predicted: Column,
                        context: list[str] | None = None) -> DataFrame:
    """Pearson and Spearman across genes of condition means and of their deltas to the control mean of their context.

    All control cells of a context count, whatever their condition; a context without control has undefined deltas.
    """
    keys = context or []
    width = [F.avg(F.col(column)[i].cast("double")) for i in range(dim)]
    part = [F.avg(F.when(predicted, F.col(column)[i].cast("double"))) for i in range(dim)]
    marked = cells.withColumn("_control", control).withColumn("_of", F.when(~F.col("_control"), F.col(condition)))
    means = materialize(marked.groupBy(*keys, "_control", "_of").agg(F.array(*width).alias("t"), F.array(*part).alias("p")))
    # true deltas are taken to the true control mean, predicted ones to the predicted control mean
    base = means.where("_control").select(*keys, F.col("t").alias("ct"), F.col("p").alias("cp"))
    treated = means.where("not _control").select(*keys, F.col("_of").alias(condition), "t", "p")
    rows = join_groups(treated, base, keys, "left") if keys else treated.withColumns(
        {c: base.select(c).scalar() for c in ("ct", "cp")})
    none = F.array_repeat(F.lit(None).cast("double"), dim)
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("ct", "cp")})
    long = rows.select(*keys, condition, F.explode(F.arrays_zip("t", "p", "ct", "cp")).alias("e")).select(
        *keys, condition, F.col("e.t").alias("t"), F.col("e.p").alias("p"), (F.col("e.t") - F.col("e.ct")).alias("dt"),
        (F.col("e.p") - F.col("e.cp")).alias("dp"))
    ranks = long.withColumns({f"r_{c}": row_rank([*keys, condition], F.col(c)) for c in ("t", "p", "dt", "dp")})
    return ranks.groupBy(*keys, condition).agg(
        correlation(F.col("p"), F.col("t")).alias("pearson_absolute"),
        correlation(F.col("dp"), F.col("dt")).alias("pearson_delta"),
        correlation(F.col("r_p"), F.col("r_t")).alias("spearman_absolute"),
        correlation(F.col("r_dp"), F.col("r_dt")).alias("spearman_delta"))


def latent_metrics(treated: DataFrame, control: DataFrame, deltas: DataFrame, keys: list[str], dim: int,
                   pool: list[str]) -> DataFrame:
    """Energy distance and centroid metrics per condition and repeat."""
    energy = M.energy_distance(treated, control, [*dict.fromkeys([*pool, *keys])], "vec_id", "v", dim, pool=pool)
    centroid = deltas.select(*keys, *[c.alias(n) for n, c in M.centroid_metrics(
        F.col("pred_delta"), F.col("true_delta")).items()])
    return centroid.join(energy, keys)


def latent_evaluation(treated: DataFrame, control: DataFrame, deltas: DataFrame, keys: list[str], dim: int,
                      pool: list[str]) -> DataFrame:
    """Mean and sample std over repeats of the per-repeat macro means."""
    columns = ["energy_distance", "centroid_cosine", "centroid_l2"]
    rows = latent_metrics(treated, control, deltas, keys, dim, pool)
    repeats = rows.groupBy("repeat_epoch").agg(*[F.avg(c).alias(c) for c in columns])
    return repeats.agg(*[e for c in columns for e in (
        F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"))])


def latent_report(raw: DataFrame, metrics: list[str]) -> dict[str, DataFrame]:
    """Report of a latent evaluation from rows per condition and repeat; the first metric is the one of the edges.

    ``repeats``: conditions, edges, mean over edges (hierarchy inside the repeat) and mean of each metric. ``summary``: mean and sample
    std of the edge means over repeats, edges and merged replicate groups. ``edges`` and ``conditions``: descriptions
    of the final edges (hierarchy over all repeats) and of each metric's condition means.
    """
    first = metrics[0]
    inside = A.hierarchical_mean(raw, first, ["repeat_epoch"])["edge"].groupBy("repeat_epoch").agg(
        F.count("*").alias("edges"), F.avg(first).alias(f"edge_{first}_mean"))
    repeats = materialize(raw.groupBy("repeat_epoch").agg(
        F.count("*").alias("conditions"), *[F.avg(m).alias(f"condition_{m}_mean") for m in metrics]).join(inside, "repeat_epoch"))
    levels = A.hierarchical_mean(raw, first)
    edges = materialize(levels["edge"])
    merged = levels["replicate"].agg(F.count_if(F.col("replicate_id") == "|".join(A.MERGED_PLATES)).alias("n")).scalar()
    summary = repeats.agg(
        F.count("*").alias("repeats"), F.avg(f"edge_{first}_mean").alias("edge_mean"), F.stddev_samp(f"edge_{first}_mean").alias("edge_std")
    ).withColumns({"final_edges": edges.agg(F.count("*")).scalar(), "merged_replicate_groups": merged})
    conditions = A.mean_over_repeats(raw, ["condition_id"], metrics)
    long = conditions.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("m")).select("m.*")
    return {"repeats": repeats, "summary": summary, "edges": A.describe_exact(edges, first),
            "conditions": A.describe_exact(long, "value", ["metric"])}


def decode_quality(pairs: DataFrame, plan: DataFrame, split: str) -> DataFrame:
    """Cell error of one split, with the check that every planned cell was decoded exactly once."""
    wanted = plan.where(F.col("split") == split)
    got = pairs.where(F.col("split") == split)
    cover = A.coverage(got, wanted, "cell_index").select("missing", "repeated")
    return A.corpus_mse(got).withColumns({c: cover.select(c).scalar() for c in cover.columns})
