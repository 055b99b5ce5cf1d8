"""Statistics, audits and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellset.catalog.registry import query, r6
from cellset.functions import vectors as V
from cellset.functions.numbers import rounded
from cellset.operators import aggregates as A
from cellset.operators import clean
from cellset.sources.scans import with_locator
from cellset.sources.sinks import new_folder
from cellset.sources.surrogates import DIM, PANEL, REPEATS, Tables

RAW = """raw as (select concat(cell_line_id,'|',drug,'|',plate,'|',cast(dose_um as varchar)) as condition_id,
 concat(cell_line_id,'|',drug) as edge_id, cell_line_id, drug, dose_um, plate, cell_id % 5 as repeat_epoch,
 avg((cell_id % 1009) / 1009.0) as energy, avg((cell_id % 757) / 757.0) as cosine from fx_cells
 where owner_type = 0 and dose_um is not null group by all)"""
QUANT = lambda c: ", ".join(
    f"{r6(f'quantile_cont({c}, {p})')} as {n}" for n, p in A.PROBS.items())
DESCRIBE = lambda c: (f"count(*) as count, {r6(f'avg({c})')} as mean, {r6(f'stddev_pop({c})')} as std, "  # noqa: E731
                      f"{r6(f'min({c})')} as min, {r6(f'max({c})')} as max, {QUANT(c)}")
DIGEST = lambda h: "concat(" + ", ".join(
    f"lpad(format('{{:x}}', bit_xor(cast('0x' || substr(sha256({h}), {1 + 15 * i}, 15) as bigint))), 15, '0')"
    for i in range(4)) + ")"


def raw_rows(t: Tables):
    rows = t.cells.where((F.col("owner_type") == 0) & F.col("dose_um").isNotNull())
    return rows.select(
        F.concat_ws("|", "cell_line_id", "drug", "plate", F.col("dose_um").cast("string")).alias("condition_id"),
        F.concat_ws("|", "cell_line_id", "drug").alias("edge_id"), "cell_line_id", "drug", "dose_um", "plate",
        (F.col("cell_id") % REPEATS).alias("repeat_epoch"), "cell_id").groupBy(
        "condition_id", "edge_id", "cell_line_id", "drug", "dose_um", "plate", "repeat_epoch").agg(
        F.avg(F.col("cell_id") % 1009 / 1009.0).alias("energy"), F.avg(F.col("cell_id") % 757 / 757.0).alias("cosine"))


def rounded_columns(df, *names):
    return df.withColumns({n: rounded(F.col(n)) for n in names})


DESCRIBED = ("mean", "std", "min", "max", *A.PROBS)


STATS = f"""select count(l) as count, {r6("avg(l)")} as mean, {r6("stddev_samp(l)")} as std, count(case when x < 0 then 1 end) as negative_values
from (select x, case when x >= 0 then ln(1 + x) end as l"""


@query("a01_global_stats", f"""
{STATS} from (select unnest(case when expressions[1] < 0 then expressions[2:] else expressions end) as x from fx_ragged) v) w""")
def a01(t: Tables):
    return rounded_columns(A.global_stats(t.ragged), "mean", "std")


@query("a01_global_stats_first_cells", f"""
{STATS} from (select unnest(case when expressions[1] < 0 then expressions[2:] else expressions end) as x
 from (select expressions from fx_ragged order by cell_id limit 100) c) v) w""")
def a01_first(t: Tables):
    return rounded_columns(A.global_stats(t.ragged, limit=100), "mean", "std")


GENE_STATS = """with v as (select c.cell_id, c.gene_index, sum(c.count) as count, ln(1 + 10000.0 * sum(c.count) / l.library) as v
 from {counts} c join {lib} l on c.cell_id = l.cell_id group by c.cell_id, c.gene_index, l.library),
 n as (select count(*) as n from {lib})"""
GENE_SELECT = (f"select gene_index, {r6('sum(v) / max(n)')} as mean, "
               f"{r6('greatest(sum(v * v) / max(n) - (sum(v) / max(n)) * (sum(v) / max(n)), 0)')} as variance, "
               f"{r6('count(case when count > 0 then 1 end) / cast(max(n) as double)')} as detection_rate "
               "from v cross join n group by gene_index")


@query("a02_gene_stats", GENE_STATS.format(counts="fx_mapped_long", lib="fx_mapped_lib") + "\n" + GENE_SELECT)
def a02(t: Tables):
    cells = clean.collapse_entries(clean.cleaned(t.ragged, t.genes))
    return rounded_columns(A.gene_stats(cells), "mean", "variance", "detection_rate")


@query("a02_gene_stats_long", GENE_STATS.format(counts="fx_counts", lib="fx_lib") + "\n" + GENE_SELECT)
def a02_long(t: Tables):
    return rounded_columns(A.gene_stats_long(clean.collapse_duplicates(t.counts)), "mean", "variance", "detection_rate")


@query("a03_detection_rate", f"""
select c.gene_index, {r6("count(distinct c.cell_id) / (select cast(count(*) as double) from fx_mapped_lib)")} as detection_rate
from fx_mapped_long c join fx_mapped_lib l on c.cell_id = l.cell_id where c.count > 0 group by c.gene_index""")
def a03(t: Tables):
    cells = clean.collapse_entries(clean.cleaned(t.ragged, t.genes))
    return rounded_columns(A.gene_stats(cells).where("detection_rate > 0").select("gene_index", "detection_rate"),
                           "detection_rate")


@query("a04_running_stats", f"""
select event_type, count(value) as count, min(value) as min, max(value) as max, {r6("avg(value)")} as mean,
 {r6("stddev_pop(value)")} as std from events group by event_type""")
def a04(t: Tables):
    return rounded_columns(A.running_stats(t.read("events"), "value", ["event_type"]), "mean", "std")


VECTOR_AUDIT = """with n as (select vec_id, label, sqrt(sum(v * v)) as norm from fx_vec_full group by vec_id, label),
 a as (select {key} count(distinct vec_id) as rows, %s as value_min, %s as value_max, %s as value_mean, %s as value_std,
  %s as negative_ratio, %s as positive_ratio from fx_vec_full {group}),
 b as (select {key} %s as norm_min, %s as norm_mean, %s as norm_max, %s as norm_std, %s as norm_median, true as finite
  from n {group})
select {out} a.rows, value_min, value_max, value_mean, value_std, negative_ratio, positive_ratio, norm_min, norm_mean,
 norm_max, norm_std, norm_median, finite from a join b on {on}""" % (
    r6("min(v)"), r6("max(v)"), r6("avg(v)"), r6("stddev_pop(v)"), r6("avg(case when v < 0 then 1.0 else 0.0 end)"),
    r6("avg(case when v > 0 then 1.0 else 0.0 end)"), r6("min(norm)"), r6("avg(norm)"), r6("max(norm)"),
    r6("stddev_pop(norm)"), r6("quantile_cont(norm, 0.5)"))
AUDITED = ("value_min", "value_max", "value_mean", "value_std", "negative_ratio", "positive_ratio", "norm_min",
           "norm_mean", "norm_max", "norm_std", "norm_median")


@query("a05_vector_audit", VECTOR_AUDIT.format(key="", group="", out="", on="true"))
def a05(t: Tables):
    return rounded_columns(A.vector_audit(t.vectors, "embedding"), *AUDITED)


@query("a05_vector_audit_by_section", VECTOR_AUDIT.format(key="label,", group="group by label", out="a.label,",
                                                          on="a.label = b.label"))
def a05_by(t: Tables):
    return rounded_columns(A.vector_audit(t.vectors, "embedding", ["label"]), *AUDITED)


@query("a06_preprocessing_audit", f"""
with e as (select cell_id, unnest(genes) as tok from fx_stripped),
 m as (select e.cell_id, count(*) as mapped, count(distinct g.gene_index) as uniq
  from e join fx_genes g on e.tok = g.token_id group by e.cell_id),
 c as (select s.had_sentinel, len(f.genes) as raw_entries, len(s.genes) as kept_entries, coalesce(mapped, 0) as mapped_entries,
  len(s.genes) - coalesce(mapped, 0) as unmapped_entries, coalesce(mapped - uniq, 0) as duplicates_collapsed
  from fx_stripped s join fx_ragged f on s.cell_id = f.cell_id left join m on m.cell_id = s.cell_id),
 l as (select had_sentinel, unnest(['raw_entries', 'kept_entries', 'mapped_entries', 'unmapped_entries',
   'duplicates_collapsed']) as counter,
  unnest([raw_entries, kept_entries, mapped_entries, unmapped_entries, duplicates_collapsed]) as value from c)
select counter, count(case when had_sentinel then 1 end) as sentinel_cells, {DESCRIBE("value")} from l group by counter""")
def a06(t: Tables):
    return rounded_columns(A.preprocessing_audit(t.ragged, t.genes), *DESCRIBED)


@query("a07_describe", f"select {DESCRIBE('l_extendedprice')} from lineitem")
def a07(t: Tables):
    return rounded_columns(A.describe_exact(t.read("lineitem"), "l_extendedprice"), *DESCRIBED)


@query("a08_describe_by", f"""
with {RAW}, g as (select 'dose_um' as grouping, cast(dose_um as varchar) as key, energy from raw
 union all select 'cell_line_id', cell_line_id, energy from raw union all select 'drug', drug, energy from raw)
select grouping, key, {DESCRIBE("energy")} from g group by grouping, key""")
def a08(t: Tables):
    return rounded_columns(A.describe_by_each(raw_rows(t), "energy", ["dose_um", "cell_line_id", "drug"]), *DESCRIBED)


HIERARCHY = f"""{RAW}, pc as (select condition_id, edge_id, cell_line_id, drug, dose_um, plate, avg(energy) as energy
  from raw group by all),
 rp as (select *, case when dose_um = 5.0 and plate in ('plate6', 'plate14')
   and bool_or(plate = 'plate6') over w and bool_or(plate = 'plate14') over w then 'plate6|plate14' else condition_id end as rid
  from pc window w as (partition by edge_id, dose_um)),
 re as (select edge_id, cell_line_id, drug, dose_um, rid, avg(energy) as energy, count(*) as pcs from rp group by all),
 ds as (select edge_id, cell_line_id, drug, dose_um, avg(energy) as energy, count(*) as reps, sum(pcs) as pcs from re group by all)"""


@query("a09_hierarchical_mean", f"""
with {HIERARCHY}
select edge_id, cell_line_id, drug, {r6("avg(energy)")} as energy, count(*) as doses, cast(sum(reps) as bigint) as replicates,
 cast(sum(pcs) as bigint) as plate_conditions from ds group by edge_id, cell_line_id, drug""")
def a09(t: Tables):
    return rounded_columns(A.hierarchical_mean(raw_rows(t), "energy")["edge"], "energy")


@query("a10_mean_over_repeats", f"""
with {RAW} select condition_id, count(*) as repeats, {r6("avg(energy)")} as energy, {r6("avg(cosine)")} as cosine
from raw group by condition_id""")
def a10(t: Tables):
    return rounded_columns(A.mean_over_repeats(raw_rows(t), ["condition_id"], ["energy", "cosine"]), "energy", "cosine")


PANEL_LONG = """v as (select l.cell_id, p.panel_rank, ln(1 + 10000.0 * coalesce(sum(m.count), 0) / max(l.library)) as v
 from {lib} l cross join fx_panel p left join {counts} m on m.cell_id = l.cell_id and m.gene_index = p.gene_index
 group by l.cell_id, p.panel_rank)"""


@query("a11_panel_delta", f"""
with {PANEL_LONG.format(lib="fx_lib", counts="fx_counts")},
 c as (select cell_id, owner_type, concat(cell_line_id,'|',plate) as pool,
  concat(cell_line_id,'|',drug,'|',plate,'|',cast(dose_um as varchar)) as pair_id from fx_cells where dose_um is not null),
 k as (select pool, panel_rank, avg(v) as m from c join v on c.cell_id = v.cell_id where owner_type = 1 group by all),
 x as (select pair_id, pool, panel_rank, avg(v) as m from c join v on c.cell_id = v.cell_id where owner_type = 0 group by all)
select x.pair_id, x.panel_rank, {r6("x.m - k.m")} as delta from x join k on x.pool = k.pool and x.panel_rank = k.panel_rank""")
def a11(t: Tables):
    """Panel expression, treated minus control, per condition: one pass over the counts, one over the cells."""
    target = clean.panel_target_long(t.counts, PANEL)
    cells = t.cells.where("dose_um is not null").select(
        "cell_id", "owner_type", F.concat_ws("|", "cell_line_id", "plate").alias("control_pool_id"),
        F.concat_ws("|", "cell_line_id", "drug", "plate", F.col("dose_um").cast("string")).alias("pair_id"))
    delta = A.set_delta(cells.join(target, "cell_id"), "target", PANEL)
    return delta.select("pair_id", F.posexplode("delta").alias("panel_rank", "d")).select(
        "pair_id", F.col("panel_rank").cast("long").alias("panel_rank"), rounded(F.col("d")).alias("delta"))


@query("a11_panel_delta_ragged", f"""
with {PANEL_LONG.format(lib="fx_mapped_lib", counts="fx_mapped_long")},
 c as (select cell_id, case when drug = 'DMSO' then 1 else 0 end as owner_type, cell_line_id as pool,
  concat(cell_line_id,'|',drug) as pair_id from fx_ragged),
 k as (select pool, panel_rank, avg(v) as m from c join v on c.cell_id = v.cell_id where owner_type = 1 group by all),
 x as (select pair_id, pool, panel_rank, avg(v) as m from c join v on c.cell_id = v.cell_id where owner_type = 0 group by all)
select x.pair_id, x.panel_rank, {r6("x.m - k.m")} as delta from x join k on x.pool = k.pool and x.panel_rank = k.panel_rank""")
def a11_ragged(t: Tables):
    """The same from ragged cells: everything before the group means is a map over rows."""
    cells = clean.panel_target(clean.cleaned(t.ragged, t.genes), t.panel, PANEL)
    members = cells.select("target", (F.col("drug") == "DMSO").cast("int").alias("owner_type"),
                           F.col("cell_line_id").alias("control_pool_id"),
                           F.concat_ws("|", "cell_line_id", "drug").alias("pair_id"))
    delta = A.set_delta(members, "target", PANEL)
    return delta.select("pair_id", F.posexplode("delta").alias("panel_rank", "d")).select(
        "pair_id", F.col("panel_rank").cast("long").alias("panel_rank"), rounded(F.col("d")).alias("delta"))


SUMMARY_RAW = f"""{RAW}, mm as (select case when cell_line_id < 'B' then 'identity' else 'model' end as branch, repeat_epoch, energy,
  case when plate = 'plate2' then null else cosine end as cosine from raw),
 rr as (select branch, repeat_epoch, count(*) as conditions, avg(energy) as energy, count(energy) as energy_valid_n,
  count(*) - count(energy) as energy_nan_n, avg(cosine) as cosine, count(cosine) as cosine_valid_n,
  count(*) - count(cosine) as cosine_nan_n from mm group by branch, repeat_epoch)"""


def branch_rows(t: Tables):
    return raw_rows(t).select(
        F.when(F.col("cell_line_id") < "B", "identity").otherwise("model").alias("branch"), "repeat_epoch", "energy",
        F.when(F.col("plate") == "plate2", F.lit(float("nan"))).otherwise(F.col("cosine")).alias("cosine"))


@query("a12_branch_repeats", f"""
with {SUMMARY_RAW} select branch, repeat_epoch, conditions, {r6("energy")} as energy, energy_valid_n, energy_nan_n,
 {r6("cosine")} as cosine, cosine_valid_n, cosine_nan_n from rr""")
def a12_repeats(t: Tables):
    return rounded_columns(A.summarize_branch(branch_rows(t), ["energy", "cosine"])[0], "energy", "cosine")


@query("a12_branch_summary", f"""
with {SUMMARY_RAW}, s as (select branch, 'energy' as metric, energy as value from rr union all select branch, 'cosine', cosine from rr)
select branch, metric, {r6("avg(value)")} as mean, {r6("coalesce(stddev_samp(value), 0)")} as std,
 count(value) as valid_repeats, count(*) - count(value) as nan_repeats from s group by branch, metric""")
def a12_summary(t: Tables):
    return rounded_columns(A.summarize_branch(branch_rows(t), ["energy", "cosine"])[1], "mean", "std")


@query("a13_grain_counts", """
select split, count(*) as conditions, count(distinct edge_id) as edges, count(distinct drug) as drugs,
 count(distinct control_pool_id) as pools from fx_labelled group by split""")
def a13(t: Tables):
    return A.grain_counts(t.labelled)


@query("a14_split_distributions", """
select split, dose_um, cell_line_id, count(*) as conditions from fx_labelled
group by grouping sets ((split, dose_um), (split, cell_line_id))""")
def a14(t: Tables):
    return A.split_distributions(t.labelled)


@query("a15_distribution", f"""
select min(treated_cells) as min, {r6("quantile_cont(treated_cells, 0.5)")} as median, {r6("avg(treated_cells)")} as mean,
 max(treated_cells) as max from fx_conditions""")
def a15(t: Tables):
    return rounded_columns(A.distribution(t.conditions, "treated_cells"), "median", "mean")


@query("a16_profile_dimension", """
with c as (select unnest(['p_partkey', 'p_name', 'p_brand']) as "column",
  unnest([cast(p_partkey as varchar), p_name, p_brand]) as value from part),
 g as (select "column", value, count(*) as n from c group by "column", value)
select "column", count(value) as distinct_values, cast(coalesce(sum(case when value is null then n end), 0) as bigint) as missing_values,
 cast(coalesce(sum(case when value is not null and n > 1 then n end), 0) as bigint) as duplicated_rows,
 (select count(*) from part) as rows, (select min(p_partkey) from part) as key_min, (select max(p_partkey) from part) as key_max,
 (select bool_and(p_partkey >= coalesce(b, p_partkey)) from (select p_partkey, lag(p_partkey) over (order by p_retailprice, p_partkey) as b
   from part) o) as sorted,
 "column" = 'p_partkey' and count(value) = (select max(p_partkey) - min(p_partkey) + 1 from part) as contiguous
from g group by "column" """)
def a16(t: Tables):
    rows = t.read("part").withColumn("place", F.struct("p_retailprice", "p_partkey"))
    return A.profile_dimension(rows, "p_partkey", "place", ["p_partkey", "p_name", "p_brand"])


@query("a18_coverage", f"""
with s as (select l_orderkey as id, count(*) as n from lineitem group by l_orderkey),
 b as (select coalesce(s.id, o.o_orderkey) as id, s.n, o.o_orderkey as want from s full outer join orders o on s.id = o.o_orderkey)
select cast(coalesce(sum(n), 0) as bigint) as consumed_rows, count(n) as unique_ids, count(case when n is null then 1 end) as missing,
 count(case when want is null then 1 end) as unexpected, count(case when n > 1 then 1 end) as repeated,
 {DIGEST("case when n is not null then cast(id as varchar) end")} as digest from b""")
def a18(t: Tables):
    consumed = t.read("lineitem").select(F.col("l_orderkey").alias("id"))
    return A.coverage(consumed, t.read("orders").select(F.col("o_orderkey").alias("id")), "id")


@query("a20_plan_counts", "select owner_type, plate, count(*) as rows from fx_cells group by owner_type, plate")
def a20(t: Tables):
    return A.plan_counts(t.cells, ["owner_type", "plate"])


@query("a21_corpus_mse", f"""
with m as (select label, gene, avg(v) as m from fx_vec_long group by label, gene)
select count(distinct vec_id) as cells, {r6("sum((v - m) * (v - m)) / count(*)")} as mse
from fx_vec_long f join m on f.label = m.label and f.gene = m.gene""")
def a21(t: Tables):
    vecs = t.vectors.withColumn("target", F.col("embedding"))
    means = V.mean_vectors(vecs, ["label"], "target", DIM, "prediction")
    return rounded_columns(A.corpus_mse(vecs.join(means, "label")), "mse")


@query("a22_progress_rollup", f"""
with p as (select o_orderstatus as worker, count(*) as planned, count(case when o_orderpriority <> '5-LOW' then 1 end) as processed,
  count(case when o_orderpriority <> '5-LOW' then 1 end) / 60.0 as rate from orders group by o_orderstatus)
select count(*) as workers, cast(sum(processed) as bigint) as processed, cast(sum(planned - processed) as bigint) as remaining,
 {r6("sum(rate)")} as rate, {r6("max((planned - processed) / rate)")} as eta_seconds, bool_and(planned = processed) as complete from p""")
def a22(t: Tables):
    done = F.count_if(F.col("o_orderpriority") != "5-LOW")
    progress = t.read("orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("planned"), done.alias("processed"), (done / 60.0).alias("rate"))
    return rounded_columns(A.progress_rollup(progress), "rate", "eta_seconds")


@query("a16_stored_order", """
select count(*) as rows, true as by_key, (select coalesce(bool_and(x >= coalesce(b, x)), true) from
 (select o_custkey as x, lag(o_custkey) over (order by o_orderkey) as b from orders) o) as by_customer from orders""")
def a16_stored(t: Tables):
    """Orders written in key order: are keys, and customers, sorted as they lie?"""
    folder = new_folder(t.spark)
    t.read("orders").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(folder)
    located = with_locator(t.spark.read.parquet(folder))
    by_key = A.stored_order(located, "o_orderkey").select("rows", F.col("sorted").alias("by_key"))
    return by_key.withColumns(clean.one_row(A.stored_order(located, "o_custkey").select(F.col("sorted").alias("by_customer"))))
