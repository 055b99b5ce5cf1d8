"""Ordered queries: indexes, ranges, ranks, running results, top-k and caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellset.catalog.aggregates import GENE_SELECT, GENE_STATS, RAW, raw_rows, rounded_columns
from cellset.catalog.registry import query, r6
from cellset.functions.hashing import seeded_hash
from cellset.functions.numbers import rounded
from cellset.operators import aggregates as A, clean
from cellset.operators import windows as W
from cellset.operators.scale import dense_index
from cellset.sources.surrogates import POOL_CAP, Tables

HASHED = """h as (select *, sha256(concat('42|condition|', split, '|', pair_id)) as hash from fx_labelled)"""


def hashed(t: Tables):
    return t.labelled.withColumn("hash", seeded_hash("condition", F.col("split"), F.col("pair_id")))


@query("w01_coverage_rounds", f"""
with {HASHED}, r as (select pair_id,
  row_number() over (partition by split, cell_line_id, dose_um, drug order by hash, pair_id) - 1 as drug_round,
  row_number() over (partition by split, cell_line_id, dose_um, control_pool_id order by hash, pair_id) - 1 as control_round from h)
select *, greatest(drug_round, control_round) as coverage_round from r""")
def w01(t: Tables):
    return W.coverage_rounds(hashed(t), ["split", "cell_line_id", "dose_um"], ["hash", "pair_id"]).select(
        "pair_id", "drug_round", "control_round", "coverage_round")


@query("w02_assign_ranges", "select owner_type, owner_id, cells, start, stop from fx_ranges")
def w02(t: Tables):
    return W.assign_ranges(t.owners, ["owner_type", "owner_id"]).select("owner_type", "owner_id", "cells", "start", "stop")


@query("w03_csr_offsets", """
select cell_id, len(genes) as length, cast(sum(len(genes)) over (order by cell_id) - len(genes) as bigint) as offset_begin,
 cast(sum(len(genes)) over (order by cell_id) as bigint) as offset_end from fx_ragged where genes is not null and len(genes) > 0""")
def w03(t: Tables):
    return W.csr_offsets(clean.drop_malformed(t.ragged), ["cell_id"])


@query("w04_dense_index", "select ensembl_id, row_number() over (order by gene_symbol, token_id) - 1 as gene_rank from fx_genes")
def w04(t: Tables):
    return dense_index(t.genes, ["gene_symbol", "token_id"], "gene_rank").select("ensembl_id", "gene_rank")


@query("w05_avg_rank", f"""
select event_id, {r6("rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / 2.0")} as rank
from events""")
def w05(t: Tables):
    return W.avg_rank(t.read("events").select("event_id", "event_type", "value"), ["event_type"], "value").select(
        "event_id", "rank")


PR = """p as (select vec_id, abs(round(v, 2)) as score, case when v > 0.1 then 1 else 0 end as label from fx_vec_full)"""


@query("w07_average_precision", f"""
with {PR}, s as (select vec_id, score, sum(label) as hits, count(*) as n from p group by vec_id, score),
 c as (select *, sum(hits) over (partition by vec_id order by score desc) as tp, sum(n) over (partition by vec_id order by score desc) as seen,
  sum(hits) over (partition by vec_id) as pos, sum(n) over (partition by vec_id) as total from s)
select vec_id, cast(max(pos) as bigint) as positives,
 round(coalesce(case when max(pos) > 0 and max(pos) < max(total) then sum(hits / pos * tp / seen) end, -1), 6) as auprc,
 case when max(pos) > 0 and max(pos) < max(total) then '' else 'single_class_true_labels' end as reason from c group by vec_id""")
def w07(t: Tables):
    long = t.vectors.select("vec_id", F.explode("embedding").alias("v")).select(
        "vec_id", F.abs(F.round(F.col("v").cast("double"), 2)).alias("score"), (F.col("v").cast("double") > 0.1).cast("int").alias("label"))
    return W.average_precision(long, ["vec_id"]).withColumn("auprc", rounded(F.coalesce("auprc", F.lit(-1.0))))


@query("w08_check_ranges", """
with g as (select owner_id, cells, start + case when cells % 40 = 0 then 1 else 0 end as start, stop from fx_ranges),
 l as (select *, lag(stop) over (order by stop, owner_id) as before from g)
select count(*) as ranges, min(start) as first_start, max(stop) as last_stop,
 count(case when start <> coalesce(before, 0) then 1 end) as broken, count(case when stop - start <> cells then 1 end) as wrong_length from l""")
def w08(t: Tables):
    """Ranges whose count is a multiple of 40 start one late, which the check must report."""
    ranges = W.assign_ranges(t.owners, ["owner_type", "owner_id"]).withColumn(
        "start", F.col("start") + F.when(F.col("cells") % 40 == 0, 1).otherwise(0))
    return W.check_ranges(ranges, ["stop", "owner_id"])


@query("w09_best_so_far", f"""
with h as (select event_type, date_trunc('hour', ts) as step, round(avg(value), 6) as loss from events group by all),
 b as (select *, min(loss) over (partition by event_type order by step rows between unbounded preceding and 1 preceding) as prev,
  row_number() over (partition by event_type order by step) as n from h),
 i as (select *, prev is null or loss < prev as improved from b),
 s as (select *, n - max(case when improved then n end) over (partition by event_type order by step) as since_best from i)
select event_type, cast(epoch(step) as bigint) as step, {r6("least(loss, coalesce(prev, loss))")} as best, improved, since_best,
 since_best >= 3 as stop from s""")
def w09(t: Tables):
    history = t.read("events").groupBy("event_type", F.date_trunc("hour", "ts").alias("step")).agg(
        F.round(F.avg("value"), 6).alias("loss"))
    return W.best_so_far(history, ["event_type"], "step", "loss", 3).select(
        "event_type", F.unix_timestamp("step").alias("step"), rounded(F.col("best")).alias("best"), "improved",
        "since_best", "stop")


@query("w10_bh_adjust", f"""
with p as (select vec_id, dim, least(abs(v), 1.0) as p from fx_vec_full),
 r as (select *, row_number() over (partition by vec_id order by p, dim) as rank, count(*) over (partition by vec_id) as m from p)
select vec_id, dim, {r6("least(min(p * m / rank) over (partition by vec_id order by rank desc), 1.0)")} as p_adjusted from r""")
def w10(t: Tables):
    long = t.vectors.select("vec_id", F.posexplode("embedding").alias("dim", "v")).select(
        "vec_id", F.col("dim").cast("long").alias("dim"), F.least(F.abs(F.col("v").cast("double")), F.lit(1.0)).alias("p"))
    return W.bh_adjust(long, ["vec_id"], "p", "dim").select("vec_id", "dim", rounded(F.col("p_adjusted")).alias("p_adjusted"))


@query("t01_stable_sort", """
select pair_id, split, dose_um, plate from fx_labelled order by split, cell_line_id, dose_um, plate, pair_id""")
def t01(t: Tables):
    return W.stable_sort(t.labelled, ["split", "cell_line_id", "dose_um", "plate", "pair_id"]).select(
        "pair_id", "split", "dose_um", "plate")


@query("t02_top_variance_panel", GENE_STATS.format(counts="fx_mapped_long", lib="fx_mapped_lib") + f""",
 s as ({GENE_SELECT}), b as (select * from s order by variance desc, gene_index limit 20)
select row_number() over (order by variance desc, gene_index) - 1 as panel_rank, * from b""")
def t02(t: Tables):
    stats = rounded_columns(A.gene_stats(clean.collapse_entries(clean.cleaned(t.ragged, t.genes))),
                            "mean", "variance", "detection_rate")
    return W.top_variance_panel(stats, 20)


@query("t03_hash_top_k", f"""
select owner_id, cell_id from (select owner_id, cell_id, row_number() over (partition by owner_id
  order by sha256(concat('42|control-cell|', owner_id, '|', cast(cell_id as varchar))), cell_id) as n
 from fx_owned where owner_type = 1) r where n <= {POOL_CAP}""")
def t03(t: Tables):
    controls = t.owned.where("owner_type = 1").select("owner_id", "cell_id")
    return W.hash_top_k(controls, ["owner_id"], POOL_CAP, "control-cell", "cell_id")


@query("t04_fill_quota", f"""
with {HASHED}, n as (select *, row_number() over (partition by split, cell_line_id, dose_um order by hash, pair_id) as place from h)
select pair_id from n where place <= case split when 'train' then 3 when 'val' then 2 else 1 end""")
def t04(t: Tables):
    need = F.when(F.col("split") == "train", 3).when(F.col("split") == "val", 2).otherwise(1)
    return W.fill_quota(hashed(t).withColumn("need", need), ["split", "cell_line_id", "dose_um"],
                        [F.col("hash"), F.col("pair_id")], "pair_id").select("pair_id")


@query("t05_top_n_variable", """
with p as (select vec_id, dim, abs(round(v, 3)) as score, sum(case when v > 0.15 then 1 else 0 end) over (partition by vec_id) as n
  from fx_vec_full), r as (select *, row_number() over (partition by vec_id order by score desc, dim) as place from p)
select vec_id, dim from r where place <= n""")
def t05(t: Tables):
    count = F.aggregate("embedding", F.lit(0), lambda s, x: s + F.when(x.cast("double") > 0.15, 1).otherwise(0))
    long = t.vectors.select("vec_id", count.alias("n"), F.posexplode("embedding").alias("dim", "v")).select(
        "vec_id", "n", F.col("dim").cast("long").alias("dim"), F.abs(F.round(F.col("v").cast("double"), 3)).alias("score"))
    return W.top_n_variable(long, ["vec_id"], F.col("score"), "dim", "n").select("vec_id", "dim")


@query("t06_arg_best", f"""
with {RAW}, r as (select *, row_number() over (partition by edge_id order by round(energy, 6) desc, condition_id, repeat_epoch) as n from raw)
select edge_id, condition_id, repeat_epoch, {r6("energy")} as energy from r where n = 1""")
def t06(t: Tables):
    rows = rounded_columns(raw_rows(t), "energy").select("edge_id", "condition_id", "repeat_epoch", "energy")
    return W.arg_best(rows, "energy", True, [F.col("condition_id"), F.col("repeat_epoch")], ["edge_id"])


@query("t07_cap_rows", """
with p as (select o_orderstatus as shard, o_custkey % 10 as block, o_orderkey as row from orders),
 b as (select *, row_number() over (partition by shard, block order by row) as bn from p),
 s as (select *, row_number() over (partition by shard order by row) as sn from b where bn <= 50)
select shard, block, row from s where sn <= 300 order by shard, row limit 700""")
def t07(t: Tables):
    plan = t.read("orders").select(F.col("o_orderstatus").alias("shard"), (F.col("o_custkey") % 10).alias("block"),
                                   F.col("o_orderkey").alias("row"))
    return W.cap_rows(plan, ["shard", "row"], total=700, per_shard=300, per_block=50)


@query("t08_spot_indices", """
with n as (select o_orderstatus as shard, count(*) as n from orders group by o_orderstatus)
select distinct shard, cast(floor(i * (n - 1) / 15.0) as bigint) as row from n, (select unnest(range(0, 16)) as i) s""")
def t08(t: Tables):
    sizes = t.read("orders").groupBy(F.col("o_orderstatus").alias("shard")).agg(F.count("*").alias("n"))
    return sizes.select("shard", F.explode(W.spot_indices(F.col("n"), 16)).alias("row"))


@query("t09_physical_order", "select l_suppkey, l_orderkey, l_partkey, l_linenumber from lineitem")
def t09(t: Tables):
    plan = t.read("lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber")
    return W.physical_order(plan, ["l_suppkey", "l_orderkey"])


@query("t10_canonical_order", f"""
with k as (select owner_id, cell_id, row_number() over (partition by owner_id
  order by sha256(concat('42|draw|', owner_id, '|', cast(cell_id as varchar))), cell_id) as n from fx_owned)
select owner_id, string_agg(cast(cell_id as varchar), ',' order by cell_id) as members from k where n <= 16 group by owner_id""")
def t10(t: Tables):
    drawn = W.hash_top_k(t.owned.select("owner_id", "cell_id"), ["owner_id"], 16, "draw", "cell_id")
    return W.canonical_order(drawn, ["owner_id"], "cell_id").select(
        "owner_id", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))
