"""Batch inference queries with deterministic functions standing in for a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellset.catalog.aggregates import rounded_columns
from cellset.catalog.registry import query, r6
from cellset.catalog.selection import SIDES, sides
from cellset.functions.numbers import rounded
from cellset.operators import clean, infer
from cellset.operators import metrics as M
from cellset.operators.sampling import sample_sets
from cellset.operators.windows import hash_top_k
from cellset.sources.surrogates import DIM, SET_SIZE, Tables


def moments(batch_size: int = 64):
    """Model stand-in: per cell the sum of counts, the count-weighted gene sum and minus the largest count."""
    def fn(indices, values, offsets):
        import numpy as np
        starts = offsets[:-1].astype(int)
        return np.stack([np.add.reduceat(values, starts), np.add.reduceat(values * indices, starts),
                         -np.maximum.reduceat(values, starts)], axis=1)
    return fn


def model_cells(t: Tables):
    return clean.cleaned(t.ragged, t.genes).select("cell_id", "entries")


@query("u01_infer_cells", f"""
select m.cell_id, {r6("sum(m.count)")} as a, {r6("sum(m.count * m.gene_index)")} as b, {r6("-max(m.count)")} as c
from fx_mapped_long m join fx_mapped_lib l on l.cell_id = m.cell_id group by m.cell_id""")
def u01(t: Tables):
    out = infer.infer_cells(model_cells(t), moments(), batch=64, signed=True)
    return out.select("cell_id", *[rounded(F.col("vector")[i]).alias(n) for i, n in enumerate("abc")])


def drawn_sets(t: Tables):
    """Sixteen members of every label; label 0 serves as control of each other label."""
    rows = hash_top_k(t.vectors, ["label"], SET_SIZE, "structure", "vec_id").select(
        "label", F.col("vec_id").alias("cell_index"), F.col("embedding").alias("v"))
    labels = t.vectors.where("label <> 0").agg(F.array_sort(F.collect_set("label")).alias("l")).scalar()
    control = rows.where("label = 0").drop("label").withColumn("label", F.explode(labels)).withColumn("side", F.lit("control"))
    return rows.where("label <> 0").withColumn("side", F.lit("treated")).unionByName(control)


DRAWN = """dr as (select vec_id, label, row_number() over (partition by label
   order by sha256(concat('42|structure|', cast(label as varchar), '|', cast(vec_id as varchar))), vec_id) as n from embeddings),
 dl as (select f.label, f.vec_id, f.gene, f.v from fx_vec_long f join dr on dr.vec_id = f.vec_id where dr.n <= 16)"""


@query("u02_infer_sets", f"""
with {DRAWN}, m as (select label, gene, avg(v) as m from dl group by label, gene)
select t.label, t.gene, {r6("t.m - c.m")} as delta from m t join m c on c.gene = t.gene and c.label = 0 where t.label <> 0""")
def u02(t: Tables):
    out = infer.infer_sets(drawn_sets(t), lambda control, treated: treated.mean(axis=0) - control.mean(axis=0), ["label"])
    return out.select("label", F.posexplode("vector").alias("gene", "x")).select(
        "label", F.col("gene").cast("long").alias("gene"), rounded(F.col("x")).alias("delta"))


@query("u03_infer_transition", f"""
with {DRAWN}, l as (select distinct label from dl where label <> 0)
select l.label, {r6("sum(dl.v + l.label * 0.1 * 0.5)")} as total, count(distinct dl.vec_id) as members from dl cross join l
where dl.label = 0 group by l.label""")
def u03(t: Tables):
    sets = drawn_sets(t).withColumn("drug_id", F.col("label")).withColumn("dose", F.lit(0.5))
    out = infer.infer_transition(sets, lambda control, drug, dose: control + drug * 0.1 * dose, ["label"], "drug_id", "dose", DIM)
    return out.groupBy("label").agg(
        rounded(F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x))).alias("total"),
        F.count_distinct("member").alias("members"))


@query("u04_check_deterministic", """
select count(*) as rows, 0.0 as max_abs, true as allclose, true as consistent from fx_mapped_lib""")
def u04(t: Tables):
    return infer.check_deterministic(model_cells(t), moments()).select("rows", "max_abs", "allclose", "consistent")


@query("u05_pcg64_sampler", f"""
with {SIDES} select pair_id, side, epoch, count(*) as drawn, count(distinct cell_index) as distinct_members from s
group by pair_id, side, epoch""")
def u05(t: Tables):
    """Members follow numpy's generator; their number and distinctness are what SQL can confirm."""
    drawn = sample_sets(sides(t), SET_SIZE, [0, 1], mode="pcg64")
    return drawn.groupBy("pair_id", "side", "epoch").agg(
        F.count("*").alias("drawn"), F.count_distinct("cell_index").alias("distinct_members"))


@query("u06_normal_tail", f"""
select event_id, {r6("z")} as z, {r6(M.two_sided_p_sql("z"))} as p from (select event_id, (value - 25) / 10 as z from events) e""")
def u06(t: Tables):
    z = (F.col("value") - 25) / 10
    return rounded_columns(t.read("events").select("event_id", z.alias("z"), M.two_sided_p(z).alias("p")), "z", "p")
