"""Metric and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellset.catalog.aggregates import DESCRIBE, DESCRIBED, DIGEST, HIERARCHY, RAW, raw_rows, rounded_columns
from cellset.catalog.registry import query, r6
from cellset.catalog.selection import SIDES, sides
from cellset.functions import vectors as V
from cellset.functions.numbers import rounded
from cellset.operators import aggregates as A, metrics as M
from cellset.operators.sampling import sample_sets
from cellset.plans import evaluation as E
from cellset.session import materialize
from cellset.sources.surrogates import DIM, SET_SIZE, Tables

KEYS = ["repeat_epoch", "label"]
CUT = 0.02  # fixed value: a true delta larger than this counts as a changed gene on these vectors
LABELLED = f"d as (select *, case when abs(true_delta) > {CUT} then 1 else 0 end as y from fx_delta)"


def labelled(t: Tables):
    return t.deltas.withColumn("y", F.transform("true_delta", lambda x: (F.abs(x) > CUT).cast("int")))


def treated_and_control(t: Tables, repeats: bool = False):
    """Members of each condition, and the one control pool (per repeat) that the conditions share."""
    rows = M.one_pool(t.vec_repeats if repeats else t.vectors.withColumn("v", F.col("embedding")))
    pool = ["pool", "repeat_epoch"] if repeats else ["pool"]
    treated = rows.where("label <> 0").select(*pool, "label", "vec_id", "v")
    return treated, rows.where("label = 0").select(*pool, "vec_id", "v")


DIST = "sqrt(sum((a.v - b.v) * (a.v - b.v)))"
DISTANCES = f"""dd as (select a.label as la, b.label as lb, a.vec_id as ia, b.vec_id as ib, list_distance(a.e, b.e) as d
 from (select vec_id, label, cast(embedding as double[]) as e from embeddings) a
 join (select vec_id, label, cast(embedding as double[]) as e from embeddings) b on a.label = b.label or b.label = 0)"""


@query("j14_set_pairs", f"""
with {DISTANCES} select la as label, count(*) as pairs, {r6("sum(d)")} as total, {r6("min(d)")} as min, {r6("max(d)")} as max
from dd where la <> 0 and lb = 0 group by la""")
def j14(t: Tables):
    treated, control = treated_and_control(t)
    out = M.set_pairs(treated, control, ["pool", "label"], "vec_id", "v", DIM, pool=["pool"]).select("label", "pairs", "total", "min", "max")
    return rounded_columns(out, "total", "min", "max")


@query("m01_energy_distance", f"""
with {DISTANCES}, xy as (select la as label, avg(d) as m from dd where la <> 0 and lb = 0 group by la),
 xx as (select la as label, avg(d) as m from dd where la = lb group by la)
select xy.label, {r6("xy.m - x.m / 2 - y.m / 2")} as energy_distance from xy join xx x on x.label = xy.label join xx y on y.label = 0""")
def m01(t: Tables):
    treated, control = treated_and_control(t)
    out = M.energy_distance(treated, control, ["pool", "label"], "vec_id", "v", DIM, pool=["pool"])
    return rounded_columns(out.drop("pool"), "energy_distance")


REPEAT_ENERGY = """rl as (select r.repeat_epoch, f.label, f.vec_id, cast(embedding as double[]) as e
  from embeddings f cross join fx_repeats r where f.vec_id % 5 <> r.repeat_epoch),
 rd as (select a.repeat_epoch, a.label as la, b.label as lb, avg(list_distance(a.e, b.e)) as m from rl a join rl b
  on a.repeat_epoch = b.repeat_epoch and (a.label = b.label or b.label = 0) group by all),
 en as (select xy.repeat_epoch, xy.la as label, xy.m - x.m / 2 - y.m / 2 as energy from rd xy
  join rd x on x.repeat_epoch = xy.repeat_epoch and x.la = xy.la and x.lb = xy.la
  join rd y on y.repeat_epoch = xy.repeat_epoch and y.la = 0 and y.lb = 0 where xy.lb = 0 and xy.la <> 0)"""


@query("m02_baseline_identity", f"with {REPEAT_ENERGY} select repeat_epoch, label, {r6('energy')} as energy_distance from en")
def m02(t: Tables):
    """Identity baseline: the prediction is the control set itself."""
    treated, control = treated_and_control(t, repeats=True)
    out = M.energy_distance(treated, control, ["pool", *KEYS], "vec_id", "v", DIM, pool=["pool", "repeat_epoch"])
    return rounded_columns(out.drop("pool"), "energy_distance")


NORMS = "sqrt(sum(true_delta * true_delta)) * sqrt(sum(pred_delta * pred_delta))"


@query("m03_centroid_cosine", f"""
select repeat_epoch, label, {r6(f"sum(true_delta * pred_delta) / greatest({NORMS}, 1e-12)")} as centroid_cosine
from fx_delta group by repeat_epoch, label""")
def m03(t: Tables):
    c = M.centroid_metrics(F.col("pred_delta"), F.col("true_delta"))
    return t.deltas.select(*KEYS, rounded(c["centroid_cosine"]).alias("centroid_cosine"))


@query("m04_centroid_l2", f"""
select repeat_epoch, label, {r6("sqrt(sum((true_delta - pred_delta) * (true_delta - pred_delta)))")} as centroid_l2
from fx_delta group by repeat_epoch, label""")
def m04(t: Tables):
    c = M.centroid_metrics(F.col("pred_delta"), F.col("true_delta"))
    return t.deltas.select(*KEYS, rounded(c["centroid_l2"]).alias("centroid_l2"))


@query("m05_vector_error", f"""
with c as (select repeat_epoch, label, avg(abs(pred_delta - true_delta)) as mae, avg((pred_delta - true_delta) * (pred_delta - true_delta)) as mse
 from fx_delta group by repeat_epoch, label)
select count(*) as rows, {r6("avg(mae)")} as macro_mae, {r6("avg(mse)")} as macro_mse from c""")
def m05(t: Tables):
    return rounded_columns(M.vector_error(t.deltas, "pred_delta", "true_delta"), "macro_mae", "macro_mse")


def _corr(x, y):
    return (f"case when min({x}) < max({x}) and min({y}) < max({y}) then covar_pop({x}, {y}) / "
            f"(stddev_pop({x}) * stddev_pop({y})) end")


@query("m06_pearson", f"select repeat_epoch, label, {r6(_corr('pred_delta', 'true_delta'))} as pearson from fx_delta group by repeat_epoch, label")
def m06(t: Tables):
    return t.deltas.select(*KEYS, rounded(V.pearson(F.col("pred_delta"), F.col("true_delta"))).alias("pearson"))


RANKED = """r as (select *,
 rank() over (partition by repeat_epoch, label order by pred_delta) + (count(*) over (partition by repeat_epoch, label, pred_delta) - 1) / 2.0 as rp,
 rank() over (partition by repeat_epoch, label order by true_delta) + (count(*) over (partition by repeat_epoch, label, true_delta) - 1) / 2.0 as rt
 from fx_delta)"""


@query("m07_spearman", f"with {RANKED} select repeat_epoch, label, {r6(_corr('rp', 'rt'))} as spearman from r group by repeat_epoch, label")
def m07(t: Tables):
    return rounded_columns(M.spearman(t.deltas, KEYS, "pred_delta", "true_delta"), "spearman")


MANN_WHITNEY = """v as (select vec_id, label, gene, round(v, 2) as v from fx_vec_long),
 u as (select c.label as cond, v.* from (select distinct label from v where label <> 0) c join v on v.label = c.label or v.label = 0),
 k as (select *, rank() over (partition by cond, gene order by v) + (count(*) over (partition by cond, gene, v) - 1) / 2.0 as rk,
  count(*) over (partition by cond, gene, v) as tie from u),
 s as (select cond, gene, count(case when label <> 0 then 1 end) as n1, count(case when label = 0 then 1 end) as n0,
  sum(case when label <> 0 then rk end) as r1, sum(cast(tie as double) * tie - 1) as t from k group by cond, gene),
 mw as (select cond as label, gene, n1, n0, r1 - n1 * (n1 + 1) / 2.0 as u,
  (r1 - n1 * (n1 + 1) / 2.0 - n1 * n0 / 2.0) / sqrt(n1 * n0 / 12.0 * ((n1 + n0 + 1) - t / ((n1 + n0) * (n1 + n0 - 1.0)))) as z from s)"""


def de_cells(t: Tables):
    long = t.vectors.select("vec_id", "label", F.posexplode(F.col("embedding")).alias("gene", "x"))
    return long.select(F.lit("all").alias("pool"), "label", F.col("gene").cast("long").alias("gene"),
                       F.round(F.col("x").cast("double"), 2).alias("v"))


@query("m08_de_scores", f"with {MANN_WHITNEY} select label, gene, n1, n0, {r6('u')} as u, {r6('z')} as z from mw")
def m08(t: Tables):
    out = M.de_scores(de_cells(t), "label", "pool", "gene", "v", F.col("label") == 0).drop("pool")
    return rounded_columns(out, "u", "z")


@query("m08_de_test", f"""
with {MANN_WHITNEY}, p as (select label, gene, coalesce({M.two_sided_p_sql("z")}, 1.0) as p from mw),
 o as (select *, row_number() over (partition by label order by p, gene) as place, count(*) over (partition by label) as n from p),
 b as (select *, least(1.0, min(p * n / place) over (partition by label order by place rows between current row and unbounded following)) as q from o)
select label, gene, {r6("p")} as p, {r6("q")} as p_adjusted, q < 0.05 as significant from b""")
def m08_test(t: Tables):
    out = M.de_test(de_cells(t), "label", "pool", "gene", "v", F.col("label") == 0)
    return rounded_columns(out.select("label", "gene", "p", "p_adjusted", "significant"), "p", "p_adjusted")


TOP = f"""{LABELLED}, p as (select *, row_number() over (partition by repeat_epoch, label order by abs(pred_delta) desc, gene) as place,
  sum(y) over (partition by repeat_epoch, label) as pos, count(*) over (partition by repeat_epoch, label) as total,
  sum(y) over (partition by repeat_epoch, label order by abs(pred_delta) desc) as tp,
  count(*) over (partition by repeat_epoch, label order by abs(pred_delta) desc) as seen from d)"""
DES = "case when max(pos) > 0 then sum(case when place <= pos then y end) / cast(max(pos) as double) end"
AP = "case when max(pos) > 0 and max(pos) < max(total) then sum(y * tp / cast(seen as double)) / max(pos) end"


@query("m09_des", f"with {TOP} select repeat_epoch, label, {r6(f'coalesce({DES}, -1)')} as des from p group by repeat_epoch, label")
def m09(t: Tables):
    out = M.condition_metrics(labelled(t), KEYS, "pred_delta", "true_delta", "y")
    return out.select(*KEYS, rounded(F.coalesce("set_level_des", F.lit(-1.0))).alias("des"))


@query("m10_auprc", f"""
with {TOP} select repeat_epoch, label, {r6(f'coalesce({AP}, -1)')} as auprc,
 case when max(pos) in (0, max(total)) then 'single_class_true_labels' else '' end as reason from p group by repeat_epoch, label""")
def m10(t: Tables):
    out = M.condition_metrics(labelled(t), KEYS, "pred_delta", "true_delta", "y")
    return out.select(*KEYS, rounded(F.coalesce("auprc", F.lit(-1.0))).alias("auprc"), F.col("auprc_reason").alias("reason"))


RANKS = """l1 as (select p.repeat_epoch, p.label, q.label as other, sum(abs(p.pred_delta - q.true_delta)) as dist
  from fx_delta p join fx_delta q on p.repeat_epoch = q.repeat_epoch and p.gene = q.gene group by all),
 rk as (select *, count(*) over (partition by repeat_epoch, label) as candidates,
  row_number() over (partition by repeat_epoch, label order by dist, other) - 1 as rank from l1)"""


@query("j13_context_ranks", f"""
with {RANKS} select repeat_epoch, label, candidates, {r6("dist")} as own_distance, rank from rk where label = other""")
def j13(t: Tables):
    out = M.context_ranks(materialize(t.deltas), ["repeat_epoch"], "label", "pred_delta", "true_delta")
    return rounded_columns(out, "own_distance")


@query("w06_own_rank", f"with {RANKS} select repeat_epoch, label, rank from rk where label = other")
def w06(t: Tables):
    return M.context_ranks(materialize(t.deltas), ["repeat_epoch"], "label", "pred_delta", "true_delta", block=4).select(
        *KEYS, "rank")


@query("m11_context_pds", f"""
with {RANKS} select repeat_epoch, max(candidates) as candidates, {r6("avg(1 - rank / cast(candidates as double))")} as context_score
from rk where label = other group by repeat_epoch having max(candidates) >= 2""")
def m11(t: Tables):
    out = M.context_pds(materialize(t.deltas), ["repeat_epoch"], "label", "pred_delta", "true_delta")
    return rounded_columns(out, "context_score")


MAGNITUDE = f"""nn as (select repeat_epoch, label, sqrt(sum(true_delta * true_delta)) as tn, sqrt(sum(pred_delta * pred_delta)) as pn
  from fx_delta group by repeat_epoch, label),
 nr as (select repeat_epoch, rank() over (partition by repeat_epoch order by pn) + (count(*) over (partition by repeat_epoch, pn) - 1) / 2.0 as a,
  rank() over (partition by repeat_epoch order by tn) + (count(*) over (partition by repeat_epoch, tn) - 1) / 2.0 as b from nn)
select repeat_epoch, {r6(_corr("a", "b"))} as delta_magnitude_spearman from nr group by repeat_epoch"""


@query("m12_magnitude_spearman", f"with {MAGNITUDE}")
def m12(t: Tables):
    norms = t.deltas.select(*KEYS, V.l2_norm(F.col("true_delta")).alias("true_delta_norm"),
                            V.l2_norm(F.col("pred_delta")).alias("pred_delta_norm"))
    return rounded_columns(M.magnitude_spearman(materialize(norms), ["repeat_epoch"]), "delta_magnitude_spearman")


METRICS = f"""{TOP}, rr as (select repeat_epoch, label, gene,
  rank() over (partition by repeat_epoch, label order by pred_delta) + (count(*) over (partition by repeat_epoch, label, pred_delta) - 1) / 2.0 as rp,
  rank() over (partition by repeat_epoch, label order by true_delta) + (count(*) over (partition by repeat_epoch, label, true_delta) - 1) / 2.0 as rt
  from fx_delta),
 mt as (select repeat_epoch, label, avg(abs(pred_delta - true_delta)) as mae, avg((pred_delta - true_delta) * (pred_delta - true_delta)) as mse,
  {_corr("pred_delta", "true_delta")} as pearson_delta, {_corr("rp", "rt")} as spearman_delta, {DES} as set_level_des, {AP} as auprc,
  cast(max(pos) as bigint) as true_deg_count, sqrt(sum(true_delta * true_delta)) as true_delta_norm,
  sqrt(sum(pred_delta * pred_delta)) as pred_delta_norm from p join rr using (repeat_epoch, label, gene) group by repeat_epoch, label)"""
METRIC_COLUMNS = ["mae", "mse", "pearson_delta", "spearman_delta", "set_level_des", "auprc", "true_delta_norm", "pred_delta_norm"]


def metric_table(t: Tables):
    return M.condition_metrics(labelled(t), KEYS, "pred_delta", "true_delta", "y")


@query("m13_condition_metrics", f"""
with {METRICS} select repeat_epoch, label, true_deg_count, {", ".join(f"{r6(f'coalesce({c}, -9)')} as {c}" for c in METRIC_COLUMNS)} from mt""")
def m13(t: Tables):
    out = metric_table(t)
    return out.select(*KEYS, "true_deg_count", *[rounded(F.coalesce(c, F.lit(-9.0))).alias(c) for c in METRIC_COLUMNS])


def two_branches(t: Tables):
    """The half-set prediction, and a shrunken copy of it as the second branch."""
    rows = materialize(labelled(t))
    halved = rows.withColumn("pred_delta", F.transform("pred_delta", lambda x: x / 2))
    one = M.condition_metrics(rows, KEYS, "pred_delta", "true_delta", "y").withColumn("branch", F.lit("full"))
    two = M.condition_metrics(halved, KEYS, "pred_delta", "true_delta", "y").withColumn("branch", F.lit("half"))
    return one.unionByName(two)


@query("m14_compare_branches", f"""
with f as (select repeat_epoch, label, avg(abs(pred_delta - true_delta)) as a, avg(abs(pred_delta / 2 - true_delta)) as b,
  sqrt(sum(pred_delta * pred_delta)) as c, sqrt(sum(pred_delta * pred_delta)) / 2 as d from fx_delta group by repeat_epoch, label),
 r as (select repeat_epoch, avg(a) as a, avg(b) as b, avg(c) as c, avg(d) as d from f group by repeat_epoch),
 m as (select 'mae' as metric, avg(a) as x, avg(b) as y from r union all select 'pred_delta_norm', avg(c), avg(d) from r)
select metric, {r6("x")} as first, {r6("y")} as second, {r6("y - x")} as difference,
 case when y = x then 'same' when (metric = 'mae' and y < x) or (metric <> 'mae' and y > x) then 'improved' else 'degraded' end as verdict from m""")
def m14(t: Tables):
    summary = A.summarize_branch(two_branches(t), ["mae", "pred_delta_norm"])[1]
    return rounded_columns(M.compare_branches(summary, "full", "half", ["mae"]), "first", "second", "difference")


@query("m15_select_candidate", f"""
with f as (select repeat_epoch, label, avg(abs(pred_delta - true_delta)) as a, avg(abs(pred_delta * pred_delta - true_delta)) as b,
  {_corr("pred_delta", "true_delta")} as pa, {_corr("pred_delta * pred_delta", "true_delta")} as pb from fx_delta group by repeat_epoch, label)
select {r6("avg(a)")} as mae_first, {r6("avg(b)")} as mae_second, {r6("avg(pa)")} as pearson_first, {r6("avg(pb)")} as pearson_second,
 0 as undefined_first, 0 as undefined_second, false as fallback, case when avg(pa) > avg(pb) then 'first' else 'second' end as selected from f""")
def m15(t: Tables):
    rows = t.deltas.select("true_delta", F.col("pred_delta").alias("first"),
                           F.transform("pred_delta", lambda x: x * x).alias("second"))
    return rounded_columns(M.select_candidate(rows, ["first", "second"], "true_delta"), "mae_first", "mae_second",
                           "pearson_first", "pearson_second")


@query("m16_majority_winner", """
with f as (select repeat_epoch, label, avg(abs(pred_delta - true_delta)) as a, avg(abs(pred_delta / 2 - true_delta)) as b,
   sqrt(sum(pred_delta * pred_delta)) as c, sum((pred_delta - true_delta) ** 2) as g, sum((pred_delta / 2 - true_delta) ** 2) as h
  from fx_delta group by repeat_epoch, label),
 m as (select 'mae' as metric, false as up, false as pri, avg(a) as x, avg(b) as y from f
  union all select 'norm', true, true, avg(c), avg(c) / 2 from f union all select 'sharpness', false, true, avg(c), avg(c) / 2 from f
  union all select 'corpus_mse', false, false, avg(g) / 20, avg(h) / 20 from f),
 w as (select *, case when abs(x - y) <= 1e-12 then 'tie' when (up and x > y) or (not up and x < y) then 'first' else 'second' end as winner from m),
 o as (select count(case when pri and winner = 'first' then 1 end) as first_votes, count(case when pri and winner = 'second' then 1 end) as second_votes,
  max(case when metric = 'mae' then winner end) as mae, max(case when metric = 'corpus_mse' then winner end) as corpus_mse from w)
select *, case when first_votes > second_votes then 'first' when first_votes < second_votes then 'second'
 when mae <> 'tie' then mae when corpus_mse = 'first' then 'first' else 'second' end as selected from o""")
def m16(t: Tables):
    table = E.two_sided_metrics(t.deltas.withColumn("other", F.transform("pred_delta", lambda x: x / 2)),
                                "pred_delta", "other", "true_delta")
    return M.majority_winner(table)


@query("m17_evaluation_plan", f"""
with g as (select r.repeat_epoch, f.label, count(*) as members,
  {DIGEST("concat(cast(label as varchar), '|', cast(repeat_epoch as varchar), '|', cast(vec_id as varchar))")} as digest
  from embeddings f cross join fx_repeats r where f.vec_id % 5 <> r.repeat_epoch and f.label <> 0
  group by r.repeat_epoch, f.label),
 l as (select repeat_epoch, label, sum(abs(true_delta)) as truth_l1 from fx_delta group by repeat_epoch, label)
select g.repeat_epoch, g.label, g.members, g.digest, {r6("l.truth_l1")} as truth_l1 from g
join l on l.repeat_epoch = g.repeat_epoch and l.label = g.label""")
def m17(t: Tables):
    plan = E.evaluation_plan(t.vec_repeats, "label", "vec_id", "v", DIM)
    return plan.select("repeat_epoch", "label", "members", "digest",
                       rounded(V.total(F.transform("true_delta", F.abs))).alias("truth_l1"))


@query("m17_drawn_plan", f"""
with {SIDES}, v as (select *, (cell_index % 1009) / 1009.0 as x, (cell_index % 757) / 757.0 as y from s),
 drawn as (select pair_id, epoch, string_agg(case when side = 'control' then cast(cell_index as varchar) end, ',' order by cell_index) as control,
  string_agg(case when side = 'treated' then cast(cell_index as varchar) end, ',' order by cell_index) as treated,
  avg(case when side = 'treated' then x end) - avg(case when side = 'control' then x end) as dx,
  avg(case when side = 'treated' then y end) - avg(case when side = 'control' then y end) as dy from v group by pair_id, epoch)
select row_number() over (order by epoch, c.pair_id) - 1 as row_index, c.pair_id, epoch as repeat_epoch, control, treated, {r6("dx")} as dx, {r6("dy")} as dy,
 edge_id, cell_line_id, drug, dose_um, plate, control_pool_id from drawn join fx_conditions c on c.pair_id = drawn.pair_id""")
def m17_drawn(t: Tables):
    """Both drawn sets of every condition and repeat, with two surrogate expressions per cell."""
    sets = materialize(sample_sets(sides(t), SET_SIZE, [0, 1]))
    value = lambda n: F.col("cell_index") % n / F.lit(float(n))
    vectors = sets.select("cell_index").distinct().withColumn("v", F.array(value(1009), value(757)))
    metadata = ["edge_id", "cell_line_id", "drug", "dose_um", "plate", "control_pool_id"]
    plan = E.drawn_plan(sets, vectors, t.conditions, SET_SIZE, "v", 2, metadata)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return plan.select("row_index", "pair_id", "repeat_epoch", text("control"), text("treated"), rounded(F.col("true_delta")[0]).alias("dx"),
                       rounded(F.col("true_delta")[1]).alias("dy"), *metadata)


AVERAGE_RANK = lambda c: (f"rank() over (partition by label order by {c}) + (count(*) over (partition by label, {c}) - 1) / 2.0")


@query("m19_structure_correlation", f"""
with t as (select x.label, x.vec_id as i, y.vec_id as j,
  list_distance(cast(x.embedding[1:32] as double[]), cast(y.embedding[1:32] as double[])) as a,
  list_distance(cast(x.embedding[33:64] as double[]), cast(y.embedding[33:64] as double[])) as b
  from embeddings x join embeddings y on x.label = y.label and x.vec_id < y.vec_id),
 k as (select *, {AVERAGE_RANK("a")} as ra, {AVERAGE_RANK("b")} as rb from t)
select label, count(*) as pairs, {r6(_corr("a", "b"))} as pearson, {r6(_corr("ra", "rb"))} as spearman from k group by label""")
def m19(t: Tables):
    """Whole sets of a label: the pair structure of the first half of the components against that of the second."""
    sets = t.vectors.select("label", "vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    return rounded_columns(M.structure_correlation(sets, ["label"], "vec_id", "a", "b"), "pearson", "spearman")


TRIANGLE = f"""tr as (select a.label, a.vec_id as i, b.vec_id as j, list_distance(a.e, b.e) as euclidean, list_cosine_similarity(a.e, b.e) as cosine
 from (select vec_id, label, cast(embedding as double[]) as e from embeddings) a
 join (select vec_id, label, cast(embedding as double[]) as e from embeddings) b on a.label = b.label and a.vec_id < b.vec_id)"""


@query("a17_pairwise_structure", f"with {TRIANGLE}\n" + "\nunion all ".join(
    f"select label, '{m}' as metric, count(*) as pairs, {r6(f'min({m})')} as min, {r6(f'quantile_cont({m}, 0.5)')} as median, "
    f"{r6(f'avg({m})')} as mean, {r6(f'stddev_pop({m})')} as std, {r6(f'max({m})')} as max from tr group by label"
    for m in ("cosine", "euclidean")))
def a17(t: Tables):
    out = M.pairwise_structure(t.vectors, ["label"], "vec_id", "embedding", DIM)
    return rounded_columns(out, "min", "median", "mean", "std", "max")


@query("m20_context_diagnostics", f"""
with a as (select f.label, f.gene, avg(f.v) as t, avg(case when f.vec_id % 2 = 0 then f.v end) as p from fx_vec_long f group by f.label, f.gene),
 c as (select x.label, x.gene, x.t, x.p, x.t - k.t as dt, x.p - k.p as dp from a x join a k on k.gene = x.gene and k.label = 0 where x.label <> 0),
 r as (select *, rank() over (partition by label order by t) as rt, rank() over (partition by label order by p) as rp,
  rank() over (partition by label order by dt) as rdt, rank() over (partition by label order by dp) as rdp from c)
select label, {r6(_corr("p", "t"))} as pearson_absolute, {r6(_corr("dp", "dt"))} as pearson_delta,
 {r6(_corr("rp", "rt"))} as spearman_absolute, {r6(_corr("rdp", "rdt"))} as spearman_delta from r group by label""")
def m20(t: Tables):
    out = E.context_diagnostics(t.vectors.withColumn("v", F.col("embedding")), "label", "v", DIM,
                                control=F.col("label") == 0, predicted=F.col("vec_id") % 2 == 0)
    return rounded_columns(out, "pearson_absolute", "pearson_delta", "spearman_absolute", "spearman_delta")


@query("m20_diagnostics_per_context", f"""
with f as (select vec_id, label, gene, v, vec_id % 3 as context, label in (0, 1) and vec_id % 2 = 0 as control from fx_vec_long),
 a as (select context, label, gene, avg(v) as t, avg(case when vec_id % 5 <> 0 then v end) as p from f where not control group by context, label, gene),
 k as (select context, gene, avg(v) as t, avg(case when vec_id % 5 <> 0 then v end) as p from f where control group by context, gene),
 c as (select x.context, x.label, x.gene, x.t, x.p, x.t - k.t as dt, x.p - k.p as dp from a x join k on k.gene = x.gene and k.context = x.context),
 r as (select *, rank() over (partition by context, label order by t) as rt, rank() over (partition by context, label order by p) as rp,
  rank() over (partition by context, label order by dt) as rdt, rank() over (partition by context, label order by dp) as rdp from c)
select context, label, {r6(_corr("p", "t"))} as pearson_absolute, {r6(_corr("dp", "dt"))} as pearson_delta,
 {r6(_corr("rp", "rt"))} as spearman_absolute, {r6(_corr("rdp", "rdt"))} as spearman_delta from r group by context, label""")
def m20_context(t: Tables):
    """Three contexts, each with control cells of its own under two labels."""
    vecs = t.vectors.withColumn("v", F.col("embedding")).withColumn("context", F.col("vec_id") % 3)
    out = E.context_diagnostics(vecs, "label", "v", DIM, control=F.col("label").isin(0, 1) & (F.col("vec_id") % 2 == 0),
                                predicted=F.col("vec_id") % 5 != 0, context=["context"])
    return rounded_columns(out, "pearson_absolute", "pearson_delta", "spearman_absolute", "spearman_delta")


@query("m21_rollup_with_undefined", f"""
with {METRICS} select repeat_epoch, {r6("coalesce(avg(auprc), -1)")} as mean, count(auprc) as valid_n, count(*) - count(auprc) as undefined_n,
 count(case when auprc is null and true_deg_count <> 0 then 1 end) as unexpected_undefined_n from mt group by repeat_epoch""")
def m21(t: Tables):
    out = M.rollup_with_undefined(metric_table(t), "auprc", ["repeat_epoch"])
    return out.withColumn("mean", rounded(F.coalesce("mean", F.lit(-1.0))))


@query("m22_latent_evaluation", f"""
with {REPEAT_ENERGY}, ce as (select repeat_epoch, label, sum(true_delta * pred_delta) / greatest({NORMS}, 1e-12) as centroid_cosine,
  sqrt(sum((true_delta - pred_delta) ** 2)) as centroid_l2 from fx_delta group by repeat_epoch, label),
 m as (select ce.*, en.energy from ce join en using (repeat_epoch, label)),
 r as (select repeat_epoch, avg(energy) as energy_distance, avg(centroid_cosine) as centroid_cosine, avg(centroid_l2) as centroid_l2 from m group by 1)
select {", ".join(f"{r6(f'avg({c})')} as {c}_mean, {r6(f'stddev_samp({c})')} as {c}_std" for c in ("energy_distance", "centroid_cosine", "centroid_l2"))} from r""")
def m22(t: Tables):
    treated, control = treated_and_control(t, repeats=True)
    out = E.latent_evaluation(treated, control, t.deltas, KEYS, DIM, ["pool", "repeat_epoch"])
    return rounded_columns(out, *out.columns)


BY_REPEAT = """rpc as (select repeat_epoch, condition_id, edge_id, cell_line_id, drug, dose_um, plate, avg(energy) as energy from raw group by all),
 rrp as (select *, case when dose_um = 5.0 and plate in ('plate6', 'plate14')
   and bool_or(plate = 'plate6') over w and bool_or(plate = 'plate14') over w then 'plate6|plate14' else condition_id end as rid
  from rpc window w as (partition by repeat_epoch, edge_id, dose_um)),
 rre as (select repeat_epoch, edge_id, dose_um, rid, avg(energy) as energy from rrp group by all),
 rds as (select repeat_epoch, edge_id, dose_um, avg(energy) as energy from rre group by all),
 rde as (select repeat_epoch, edge_id, avg(energy) as energy from rds group by all),
 rep as (select repeat_epoch, count(*) as edges, avg(energy) as edge_mean from rde group by repeat_epoch)"""


@query("m22_report_repeats", f"""
with {RAW}, {BY_REPEAT}, c as (select repeat_epoch, count(*) as conditions, avg(energy) as e, avg(cosine) as s from raw group by repeat_epoch)
select repeat_epoch, conditions, edges, {r6("edge_mean")} as edge_energy_mean, {r6("e")} as condition_energy_mean, {r6("s")} as condition_cosine_mean
from c join rep using (repeat_epoch)""")
def m22_repeats(t: Tables):
    out = E.latent_report(raw_rows(t), ["energy", "cosine"])["repeats"]
    return rounded_columns(out, "edge_energy_mean", "condition_energy_mean", "condition_cosine_mean")


@query("m22_report_summary", f"""
with {HIERARCHY}, {BY_REPEAT} select count(*) as repeats, {r6("avg(edge_mean)")} as edge_mean, {r6("stddev_samp(edge_mean)")} as edge_std,
 (select count(distinct edge_id) from ds) as final_edges, (select count(*) from re where rid = 'plate6|plate14') as merged_replicate_groups from rep""")
def m22_summary(t: Tables):
    return rounded_columns(E.latent_report(raw_rows(t), ["energy", "cosine"])["summary"], "edge_mean", "edge_std")


@query("m22_report_descriptions", f"""
with {HIERARCHY}, e as (select edge_id, avg(energy) as value from ds group by edge_id),
 c as (select condition_id, avg(energy) as energy, avg(cosine) as cosine from raw group by condition_id)
select 'edges' as of, {DESCRIBE("value")} from e union all select 'energy', {DESCRIBE("energy")} from c
union all select 'cosine', {DESCRIBE("cosine")} from c""")
def m22_descriptions(t: Tables):
    report = E.latent_report(raw_rows(t), ["energy", "cosine"])
    both = report["edges"].withColumn("of", F.lit("edges")).unionByName(report["conditions"].withColumnRenamed("metric", "of"))
    return rounded_columns(both.select("of", "count", *DESCRIBED), *DESCRIBED)


@query("m22_hierarchy_levels", f"""
with {HIERARCHY} select edge_id, dose_um, {r6("energy")} as energy, reps as replicates, cast(pcs as bigint) as plate_conditions from ds""")
def m22_levels(t: Tables):
    dose = A.hierarchical_mean(raw_rows(t), "energy")["dose"]
    return rounded_columns(dose.select("edge_id", "dose_um", "energy", "replicates", "plate_conditions"), "energy")


@query("m23_decode_quality", f"""
with m as (select label, gene, avg(v) as m from fx_vec_long group by label, gene)
select count(distinct vec_id) as cells, {r6("sum((v - m) * (v - m)) / count(*)")} as mse, 0 as missing, 0 as repeated
from fx_vec_long f join m on f.label = m.label and f.gene = m.gene where f.label in (2, 5, 8)""")
def m23(t: Tables):
    vecs = t.vectors.withColumn("target", F.col("embedding")).withColumn(
        "split", F.when(F.col("label") % 3 == 2, "test").otherwise("train"))
    means = V.mean_vectors(vecs, ["label"], "target", DIM, "prediction")
    pairs = vecs.join(means, "label").select(F.col("vec_id").alias("cell_index"), "prediction", "target", "split")
    out = E.decode_quality(pairs, vecs.select(F.col("vec_id").alias("cell_index"), "split"), "test")
    return rounded_columns(out, "mse")


