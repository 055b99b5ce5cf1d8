"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellset.catalog.aggregates import RAW, raw_rows, rounded_columns
from cellset.catalog.registry import query, r6
from cellset.functions import vectors as V
from cellset.functions.hashing import seeded_hash
from cellset.functions.numbers import rounded
from cellset.operators import clean, joins as J
from cellset.operators.scale import dense_index
from cellset.operators.windows import assign_ranges
from cellset.sources.surrogates import Tables


@query("j01_lookup_strict", """
select c.pair_id, v.drug_id from fx_conditions c
join (select drug, row_number() over (order by drug) - 1 as drug_id from (select distinct drug from fx_conditions) d) v
 on c.drug = v.drug""")
def j01(t: Tables):
    return J.lookup_strict(t.conditions, clean.drug_vocabulary(t.conditions), "drug", "drug_id").select(
        "pair_id", "drug_id")


@query("j02_attach_controls", """
select c.pair_id, coalesce(p.control_cells, 0) as control_cells, p.control_pool_id is not null as pool_found, coalesce(c.cell_line_id = p.cell_line_id, false) as cell_line_id_agrees,
 coalesce(c.plate = p.plate, false) as plate_agrees
from fx_conditions c left join (select * from fx_pools where plate <> 'plate2') p on c.control_pool_id = p.control_pool_id""")
def j02(t: Tables):
    """Pools of one plate are left out, so their conditions are reported as without a pool."""
    return J.attach_controls(t.conditions, t.pools.where("plate <> 'plate2'"), ["cell_line_id", "plate"]).select(
        "pair_id", F.coalesce("control_cells", F.lit(0)).alias("control_cells"), "pool_found", "cell_line_id_agrees", "plate_agrees")


@query("j03_join_validated", """
select o.o_orderkey, coalesce(c.c_mktsegment, '') as segment, c.c_custkey is not null as matched
from orders o left join (select * from customer where c_acctbal > 0) c on o.o_custkey = c.c_custkey""")
def j03(t: Tables):
    customers = t.read("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    orders = t.read("orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return J.join_validated(orders, customers, ["k"]).select(
        "o_orderkey", F.coalesce("c_mktsegment", F.lit("")).alias("segment"), "matched")


VOCABS = """a as (select ensembl_id, gene_symbol, token_id from fx_genes where gene_symbol not like 'red%'),
 b as (select ensembl_id, case when gene_symbol like 'small%' then concat(gene_symbol, '*') else gene_symbol end as gene_symbol, token_id
  from fx_genes where gene_symbol not like '%ring')"""


def vocabularies(t: Tables):
    genes = t.genes.select("ensembl_id", "gene_symbol", "token_id")
    symbol = F.col("gene_symbol")
    changed = F.when(symbol.startswith("small"), F.concat(symbol, F.lit("*"))).otherwise(symbol)
    return genes.where(~symbol.startswith("red")), genes.where(~symbol.endswith("ring")).withColumn("gene_symbol", changed)


@query("j04_compare_dimensions", f"""
with {VOCABS}
select coalesce(a.ensembl_id, b.ensembl_id) as ensembl_id,
 case when b.ensembl_id is null then 'first_only' when a.ensembl_id is null then 'second_only' else 'both' end as membership,
 coalesce(a.gene_symbol = b.gene_symbol, false) as gene_symbol_match, coalesce(a.token_id = b.token_id, false) as token_id_match
from a full outer join b on a.ensembl_id = b.ensembl_id""")
def j04(t: Tables):
    return J.compare_dimensions(*vocabularies(t), "ensembl_id", ["gene_symbol", "token_id"]).select(
        "ensembl_id", "membership", "gene_symbol_match", "token_id_match")


@query("j04_compatibility", f"""
with {VOCABS}, c as (select a.ensembl_id as x, b.ensembl_id as y, a.gene_symbol = b.gene_symbol and a.token_id = b.token_id as same
  from a full outer join b on a.ensembl_id = b.ensembl_id)
select count(case when x is not null and y is not null then 1 end) as both, count(case when y is null then 1 end) as first_only,
 count(case when x is null then 1 end) as second_only, count(case when not same then 1 end) as changed, 'C' as "case" from c""")
def j04_case(t: Tables):
    columns = ["gene_symbol", "token_id"]
    return J.compatibility(J.compare_dimensions(*vocabularies(t), "ensembl_id", columns), columns)


@query("j05_diff_results", f"""
with {RAW} select count(case when repeat_epoch not in (1, 2) then 1 end) as rows, count(case when repeat_epoch = 1 then 1 end) as only_first,
 count(case when repeat_epoch = 2 then 1 end) as only_second,
 {r6("max(case when repeat_epoch not in (1, 2) then abs(energy - cosine) end)")} as max_abs_energy from raw""")
def j05(t: Tables):
    a = raw_rows(t)
    b = a.select("condition_id", "repeat_epoch", F.col("cosine").alias("energy")).where("repeat_epoch <> 1")
    return rounded_columns(J.diff_results(a.where("repeat_epoch <> 2"), b, ["condition_id", "repeat_epoch"], ["energy"]), "max_abs_energy")


@query("j06_restrict_plan", """
with s as (select cell_index, row_number() over (order by cell_index) - 1 as new_index, owner_id from fx_indexed where sample_id <> 's1')
select i.cell_index as source_index, s.new_index, i.owner_id, true as owner_agrees from fx_indexed i join s on i.cell_index = s.cell_index""")
def j06(t: Tables):
    plan = t.indexed.select(F.col("cell_index").alias("source_index"), "owner_type", "owner_id", "sample_id")
    chosen = dense_index(plan.where("sample_id <> 's1'"), ["source_index"], "new_index")
    return J.restrict_plan(plan.drop("sample_id"), chosen).select("source_index", "new_index", "owner_id", "owner_agrees")


@query("j07_reindex_plan", """
with f as (select cell_index, row_number() over (order by cell_index) - 1 + 1000000 as new_index from fx_indexed
  where owner_type = 1 and sample_id <> 's1')
select i.cell_index as source_index, i.cell_index - r.start + r.start + 500 as new_index, i.owner_id
from fx_indexed i join fx_ranges r on i.owner_id = r.owner_id and i.owner_type = r.owner_type where i.owner_type = 0
union all select i.cell_index, coalesce(f.new_index, -1), i.owner_id from fx_indexed i left join f on i.cell_index = f.cell_index where i.owner_type = 1""")
def j07(t: Tables):
    plan = t.indexed.select(F.col("cell_index").alias("source_index"), "owner_type", "owner_id", "sample_id")
    ranges = assign_ranges(t.owners, ["owner_type", "owner_id"]).where("owner_type = 0").select(
        "owner_id", F.col("start").alias("old_start"), F.col("stop").alias("old_stop"),
        (F.col("start") + 500).alias("new_start"))
    fixed = dense_index(plan.where("owner_type = 1 and sample_id <> 's1'"), ["source_index"], "_i").withColumn(
        "new_index", F.col("_i") + 1_000_000)
    return J.reindex_plan(plan, ranges, fixed).select(
        "source_index", F.coalesce("new_index", F.lit(-1)).alias("new_index"), "owner_id")


@query("j08_verify_owner", """
select cell_id, owner_id, drug <> 'MACHINERY' as owner_known, drug <> 'MACHINERY' as drug_ok, drug <> 'MACHINERY' and plate <> 'plate2' as plate_ok,
 drug <> 'MACHINERY' and sample_id in ('s0', 's1', 's2') as sample_ok
from fx_owned where owner_type = 0 and not (drug <> 'MACHINERY' and plate <> 'plate2' and sample_id in ('s0', 's1', 's2'))""")
def j08(t: Tables):
    """Owners list three samples, every plate2 owner carries a wrong plate, one drug's owners are unknown: all must be reported."""
    owners = t.conditions.where("drug <> 'MACHINERY'").select(
        F.col("pair_id").alias("owner_id"), "drug", F.lit("s0|s1|s2").alias("samples"),
        F.when(F.col("plate") == "plate2", "plate3").otherwise(F.col("plate")).alias("plate"))
    return J.verify_owner(t.owned.where("owner_type = 0"), owners, ["drug", "plate"])


@query("j09_expand_ranges", "select owner_id, owner_type, cell_index from fx_indexed")
def j09(t: Tables):
    return J.expand_ranges(assign_ranges(t.owners, ["owner_type", "owner_id"]), ["owner_id", "owner_type"])


@query("j09_range_join", "select cell_id, owner_id, cell_index from fx_indexed")
def j09_join(t: Tables):
    ranges = assign_ranges(t.owners, ["owner_type", "owner_id"]).select("owner_id", "start", "stop")
    cells = t.indexed.select("cell_id", "cell_index")
    return J.owner_join(cells, ranges).select("cell_id", "owner_id", "cell_index")


@query("j10_gather", f"""
select l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_extendedprice, {r6("f.total")} as total
from lineitem l left join (select vec_id, sum(v) as total from fx_vec_full group by vec_id) f on l.l_suppkey = f.vec_id""")
def j10(t: Tables):
    """Members (lineitem rows, whose supplier key is the cell index) joined to their vectors."""
    sets = t.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").withColumn(
        "cell_index", F.col("l_suppkey"))
    vectors = t.vectors.select(F.col("vec_id").alias("cell_index"), "embedding")
    return J.gather(sets, vectors).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
                                          rounded(V.total(F.col("embedding"))).alias("total"))


@query("j11_keep_seen", """
select pair_id, split from fx_labelled where drug in (select drug from fx_labelled where split = 'train')""")
def j11(t: Tables):
    return J.keep_seen(t.labelled, t.labelled.where("split = 'train'"), "drug").select("pair_id", "split")


@query("j12_unseen", """
select pair_id, split, drug from fx_labelled where split <> 'train'
 and drug not in (select drug from fx_labelled where split = 'train')""")
def j12(t: Tables):
    return J.unseen(t.labelled.where("split <> 'train'"), t.labelled.where("split = 'train'"), "drug").select(
        "pair_id", "split", "drug")


@query("j15_paired_cells", f"""
select f.vec_id, {r6("sum(f.v)")} as latent_sum, {r6("case when f.vec_id % 5 <> 0 then sum(f.v) end")} as target_sum, f.vec_id % 5 <> 0 as complete
from fx_vec_full f where f.label in (1, 4, 7) group by f.vec_id""")
def j15(t: Tables):
    plan = t.vectors.select(F.col("vec_id").alias("cell_index"), F.when(F.col("label") % 3 == 1, "val").otherwise(
        "train").alias("split"))
    latent = t.vectors.select(F.col("vec_id").alias("cell_index"), F.col("embedding").alias("latent"))
    target = t.vectors.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("cell_index"), F.col("embedding").alias("target"))
    return J.paired_cells(plan, latent, target, "val").select(
        F.col("cell_index").alias("vec_id"), rounded(V.total(F.col("latent"))).alias("latent_sum"),
        rounded(V.total(F.col("target"))).alias("target_sum"), "complete")


@query("j16_assert_same", f"""
with {VOCABS}, c as (select a.ensembl_id as x, b.ensembl_id as y, a.gene_symbol = b.gene_symbol as s, a.token_id = b.token_id as k
  from a full outer join b on a.ensembl_id = b.ensembl_id)
select count(case when y is null then 1 end) as only_first, count(case when x is null then 1 end) as only_second,
 count(case when not s then 1 end) as gene_symbol_differs, count(case when not k then 1 end) as token_id_differs from c""")
def j16(t: Tables):
    return J.assert_same(*vocabularies(t), "ensembl_id", ["gene_symbol", "token_id"])


@query("j17_align_branches", f"""
with {RAW} select condition_id, repeat_epoch, {r6("case when repeat_epoch <> 1 then energy end")} as first_score,
 {r6("case when repeat_epoch <> 2 then cosine end")} as second_score, repeat_epoch not in (1, 2, 4) as same_members from raw""")
def j17(t: Tables):
    rows = raw_rows(t)
    digest = seeded_hash(F.col("condition_id"), F.col("repeat_epoch"))
    a = rows.select("condition_id", "repeat_epoch", rounded(F.col("energy")).alias("score"), digest.alias("digest"))
    other = F.when(F.col("repeat_epoch") == 4, F.lit("")).otherwise(digest)
    b = rows.select("condition_id", "repeat_epoch", rounded(F.col("cosine")).alias("score"), other.alias("digest"))
    return J.align_branches(a.where("repeat_epoch <> 1"), b.where("repeat_epoch <> 2"), ["condition_id", "repeat_epoch"], "score")


@query("m18_vector_parity", f"""
with p as (select vec_id, cast(v as double) as x, cast(v as double) + (vec_id % 7) * 1e-4 as y from fx_vec_full),
 r as (select vec_id, max(abs(x - y)) as gap, sum(abs(x - y)) as gs, count(*) as n,
  sqrt(sum((x - y) * (x - y))) / greatest(sqrt(sum(y * y)), 1e-12) as rel,
  sum(x * y) / greatest(sqrt(sum(x * x)) * sqrt(sum(y * y)), 1e-12) as cos,
  bool_and(abs(x - y) <= 1e-6 + 1e-5 * abs(y)) as close from p group by vec_id)
select count(*) as rows, 0 as missing, {r6("max(gap)")} as max_abs, {r6("sum(gs) / sum(n)")} as mean_abs, {r6("max(rel)")} as max_relative_l2,
 {r6("min(cos)")} as min_cosine, bool_and(close) as allclose,
 max(gap) <= 0.2 and sum(gs) / sum(n) <= 0.03 and max(rel) <= 0.06 and min(cos) >= 0.998 as consistent from r""")
def m18(t: Tables):
    a = t.vectors.select("vec_id", F.col("embedding").alias("v"))
    b = t.vectors.select("vec_id", F.transform(
        "embedding", lambda x: x.cast("double") + F.col("vec_id") % 7 * F.lit(1e-4)).alias("v"))
    limits = {"max_abs": 0.2, "mean_abs": 0.03, "max_relative_l2": 0.06, "min_cosine": 0.998}  # fixed values
    return rounded_columns(J.parity(a, b, "vec_id", "v", 1e-5, 1e-6, limits), "max_abs", "mean_abs",
                           "max_relative_l2", "min_cosine")


