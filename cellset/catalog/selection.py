"""Selection, splitting and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellset.catalog.aggregates import DIGEST
from cellset.catalog.registry import query, r6
from cellset.functions.numbers import rounded
from cellset.operators import sampling as H
from cellset.operators.aggregates import membership_digest
from cellset.operators.scale import place_in_group
from cellset.operators.windows import assign_ranges, hash_top_k
from cellset.plans import subset as P
from cellset.session import materialize
from cellset.sources.surrogates import POOL_CAP, SET_SIZE, Tables

SPLITS = ["train", "val", "test"]
TOTALS = {"train": 60, "val": 15, "test": 20}  # fixed values: conditions per split on these tables


def totals(t: Tables):
    return t.spark.createDataFrame(list(TOTALS.items()), "split string, total long")


def candidate_conditions(t: Tables, pools=None):
    return t.labelled.join((pools or t.pools).select("control_pool_id", "control_cells"), "control_pool_id").withColumn(
        "eligible", F.lit(1))


def chosen_subset(t: Tables):
    pools = materialize(t.pools)
    rows = materialize(candidate_conditions(t, pools))
    return P.build_subset(rows, pools, totals(t), SET_SIZE, POOL_CAP, SPLITS)


@query("h01_split_files", """
select s_name, row_number() over (order by s_name) - 1 as ordinal,
 case when row_number() over (order by s_name) - 1 < least(greatest(ceil(1000 / 60.0), 8), floor((select count(*) from supplier) / 2))
  then 'val' else 'train' end as split from supplier""")
def h01(t: Tables):
    return H.split_files(t.read("supplier"), "s_name", 60, 1000, 4)


@query("h02_check_subset", f"""
with n as (select least(17, floor(count(*) / 2)) as v, count(*) as n from supplier),
 f as (select s_name, row_number() over (order by s_name) - 1 as o from supplier)
select true as val_equal, true as selected_in_pool, true as no_copies,
 {r6("(select count(*) from f, n where o >= v and s_name not like '%5') / cast((select n - v from n) as double)")} as coverage""")
def h02(t: Tables):
    files = H.split_files(t.read("supplier"), "s_name", 60, 1000, 4)
    manifest = files.where("split = 'val' or s_name not like '%5'")
    return H.check_subset(files, manifest, "s_name").withColumn("coverage", rounded(F.col("coverage")))


@query("h03_shard_of", "select doc_id, row_number() over (order by doc_id) - 1 as ordinal, (row_number() over (order by doc_id) - 1) % 7 as shard from documents")
def h03(t: Tables):
    return H.shard_of(t.read("documents").select("doc_id"), ["doc_id"], 7)


@query("h04_keyed_shuffle", """
select o_orderkey, row_number() over (order by sha256(concat('45|', cast(o_orderkey as varchar))), o_orderkey) - 1 as position from orders""")
def h04(t: Tables):
    return H.keyed_shuffle(t.read("orders").select("o_orderkey"), "o_orderkey", epoch=3)


SIDES = f"""k as (select owner_id, cell_index, row_number() over (partition by owner_id
   order by sha256(concat('42|control-cell|', owner_id, '|', cast(cell_index as varchar))), cell_index) as n
  from fx_indexed where owner_type = 1),
 pool as (select owner_id, row_number() over (order by owner_id, cell_index) - 1 as cell_index from k where n <= {POOL_CAP}),
 m as (select c.pair_id, 'treated' as side, i.cell_index from fx_conditions c join fx_indexed i on i.owner_id = c.pair_id
   where c.treated_cells >= {SET_SIZE}
  union all select c.pair_id, 'control', p.cell_index + 1000000000 from fx_conditions c join pool p on p.owner_id = c.control_pool_id
   where c.treated_cells >= {SET_SIZE}),
 d as (select pair_id, side, epoch, cell_index, row_number() over (partition by pair_id, side, epoch
   order by sha256(concat('42|set|', cast(epoch as varchar), '|', pair_id, '|', side, '|', cast(cell_index as varchar))), cell_index) as place
  from m cross join (select unnest([0, 1]) as epoch) e),
 s as (select pair_id, side, epoch, cell_index from d where place <= {SET_SIZE})"""


def sides(t: Tables):
    """Both index ranges of every condition: treated cells, and its pool capped to the smallest hashes."""
    cells = materialize(t.indexed.select("owner_type", "owner_id", "cell_index"))
    capped = hash_top_k(cells.where("owner_type = 1"), ["owner_id"], POOL_CAP, "control-cell", "cell_index")
    pool_sizes = capped.groupBy("owner_id").agg(F.count("*").alias("cells"))
    pools = assign_ranges(pool_sizes, ["owner_id"]).select(
        F.col("owner_id").alias("control_pool_id"), (F.col("start") + 1_000_000_000).alias("control_start"),
        (F.col("stop") + 1_000_000_000).alias("control_stop"))
    treated = cells.where("owner_type = 0").groupBy(F.col("owner_id").alias("pair_id")).agg(
        F.min("cell_index").alias("start"), (F.max("cell_index") + 1).alias("stop"))
    return P.set_sides(t.conditions.where(F.col("treated_cells") >= SET_SIZE).join(treated, "pair_id").join(
        pools, "control_pool_id"))


@query("h05_sample_sets", f"with {SIDES} select * from s")
def h05(t: Tables):
    return H.sample_sets(sides(t), SET_SIZE, [0, 1])


@query("h05_sample_sets_pcg64")
def h05_pcg(t: Tables):
    return H.sample_sets(sides(t), SET_SIZE, [0, 1], mode="pcg64")


@query("h06_sampling_audit", f"""
with {SIDES}, g as (select pair_id, side, epoch, count(*) as drawn, count(distinct cell_index) = {SET_SIZE} as "unique",
  sha256(string_agg(cast(cell_index as varchar), ',' order by cell_index)) as digest from s group by pair_id, side, epoch)
select g.*, coalesce(g.digest <> b.digest, true) as redrawn from g left join g b
 on b.pair_id = g.pair_id and b.side = g.side and b.epoch = g.epoch - 1""")
def h06(t: Tables):
    return H.sampling_audit(materialize(H.sample_sets(sides(t), SET_SIZE, [0, 1])), SET_SIZE)


def as_membership(sets):
    return sets.select(F.col("pair_id").alias("condition_id"), F.col("epoch").alias("repeat_epoch"), "side", "cell_index")


@query("h07_fairness_audit", f"with {SIDES} select count(*) as sets, count(*) as same, 0 as one_sided from (select distinct pair_id, side, epoch from s) g")
def h07(t: Tables):
    """Two consumers draw on their own; both must see the same members."""
    ranges = materialize(sides(t))
    a = as_membership(H.sample_sets(ranges, SET_SIZE, [0, 1]))
    b = as_membership(H.sample_sets(ranges.repartition(3, "pair_id"), SET_SIZE, [1, 0]))
    return H.fairness_audit(a, b)


@query("a19_membership_digest", f"""
with {SIDES}, g as (select concat(pair_id, '|', cast(epoch as varchar), '|', side, '|',
  string_agg(cast(cell_index as varchar), ',' order by cell_index)) as k, count(*) as n from s group by pair_id, side, epoch)
select count(*) as sets, cast(sum(n) as bigint) as members, {DIGEST("k")} as digest from g""")
def a19(t: Tables):
    return membership_digest(as_membership(H.sample_sets(sides(t), SET_SIZE, [0, 1])))


CANDIDATES = """c as (select l.*, p.control_cells from fx_labelled l join fx_pools p on l.control_pool_id = p.control_pool_id),
 q as (select split, cell_line_id, dose_um, count(*) as capacity,
  row_number() over (partition by split order by sha256(concat('42|stratum|', cell_line_id, '|', cast(dose_um as varchar))), cell_line_id, dose_um) as r,
  count(*) over (partition by split) as n, case split when 'train' then 60 when 'val' then 15 else 20 end as total
  from c where drug in (select drug from c where split = 'train') group by split, cell_line_id, dose_um)"""


@query("h08_stratum_quotas", f"""
with {CANDIDATES}
select split, cell_line_id, dose_um, capacity, total // n + case when r <= total % n then 1 else 0 end as quota from q""")
def h08(t: Tables):
    rows = materialize(candidate_conditions(t))
    return P.stratum_quotas(P.keep_seen(rows, rows.where("split = 'train'"), "drug"), totals(t))


@query("h09_select_conditions", """
select c.pair_id, c.split, c.cell_line_id, c.dose_um, c.drug from fx_cand c join fx_selected s on s.pair_id = c.pair_id""")
def h09(t: Tables):
    rows = materialize(candidate_conditions(t))
    return P.select_conditions(P.keep_seen(rows, rows.where("split = 'train'"), "drug"), totals(t)).select(
        "pair_id", "split", "cell_line_id", "dose_um", "drug")


@query("h10_build_subset", """
select c.condition_index, c.pair_id, c.split, r.start, r.stop, p.control_pool_index, k.start as control_start, k.stop as control_stop, v.drug_id
from fx_chosen c join fx_chosen_ranges r on r.owner_type = 0 and r.owner_index = c.condition_index
join fx_chosen_pools p on p.control_pool_id = c.control_pool_id
join fx_chosen_ranges k on k.owner_type = 1 and k.owner_index = p.control_pool_index
join (select drug, row_number() over (order by drug) - 1 as drug_id from (select distinct drug from fx_labelled) d) v on v.drug = c.drug""")
def h10(t: Tables):
    return chosen_subset(t)[0].select("condition_index", "pair_id", "split", "start", "stop", "control_pool_index",
                                      "control_start", "control_stop", "drug_id")


@query("h11_build_cell_plan", f"""
with k as (select *, row_number() over (partition by owner_id order by sha256(concat('42|control-cell|', owner_id, '|',
   cast(cell_index as varchar))), cell_index) as n from fx_indexed where owner_type = 1),
 m as (select owner_id, cell_index, row_number() over (partition by owner_id order by cell_index) - 1 as i from k where n <= {POOL_CAP})
select r.start + row_number() over (partition by c.pair_id order by i.cell_index) - 1 as cell_index, i.cell_index as source_index,
 0 as owner_type, c.condition_index as owner_index from fx_chosen c join fx_indexed i on i.owner_type = 0 and i.owner_id = c.pair_id
 join fx_chosen_ranges r on r.owner_type = 0 and r.owner_index = c.condition_index
union all select r.start + m.i, m.cell_index, 1, p.control_pool_index from fx_chosen_pools p join m on m.owner_id = p.control_pool_id
 join fx_chosen_ranges r on r.owner_type = 1 and r.owner_index = p.control_pool_index""")
def h11(t: Tables):
    conditions, pools = chosen_subset(t)
    cells = t.indexed.select(F.col("cell_index").alias("source_index"), "owner_type", "owner_id")
    source = place_in_group(cells, ["owner_type", "owner_id"], ["source_index"], "place")
    return P.build_cell_plan(conditions, pools, source, POOL_CAP)


@query("h12_rank_groups", """
with s as (select cell_line_id, least(count(distinct case when split = 'train' then edge_id end),
   count(distinct case when split = 'val' then edge_id end), count(distinct case when split = 'test' then edge_id end)) as min_split_edges,
  count(distinct edge_id) as edges, count(*) as conditions from fx_labelled group by cell_line_id)
select row_number() over (order by min_split_edges desc, edges desc, conditions desc, cell_line_id) - 1 as rank, * from s""")
def h12(t: Tables):
    return P.rank_groups(t.labelled, SPLITS)


@query("h12_one_context_each", """
with e as (select cell_line_id, split, dose_um, control_pool_id, count(distinct edge_id) as edges from fx_labelled group by all),
 p as (select *, row_number() over (partition by cell_line_id, split, dose_um order by edges desc,
   sha256(concat('42|context|', split, '|', cast(dose_um as varchar), '|', control_pool_id))) as n from e),
 i as (select l.*, row_number() over (partition by l.edge_id order by sha256(concat('42|one-per-edge|', l.pair_id))) as k
  from fx_labelled l join p on p.n = 1 and p.cell_line_id = l.cell_line_id and p.split = l.split and p.dose_um = l.dose_um
   and p.control_pool_id = l.control_pool_id)
select edge_id, pair_id, control_pool_id, cell_line_id, split, dose_um from i where k = 1""")
def h12_context(t: Tables):
    return P.one_context_each(t.labelled)


@query("h13_fixed_sets", f"""
with {SIDES}, p as (select pair_id, side, cell_index, row_number() over (partition by pair_id, side order by cell_index) - 1 as pos
  from s where epoch = 0)
select pair_id, side, count(*) as members, count(distinct cell_index) as distinct_members, count(distinct pos) as positions,
 min(pos) as first_position, max(pos) as last_position, side = 'treated' as cell_id_agrees, 0 as shared_cells,
 side = 'treated' as valid from p group by pair_id, side""")
def h13(t: Tables):
    """Control indexes are remapped, so their cell ids cannot be confirmed and the check must say so."""
    drawn = materialize(H.sample_sets(sides(t), SET_SIZE, [0]))
    cells = materialize(t.indexed.select("cell_index", "cell_id"))
    placed = place_in_group(drawn, ["pair_id", "side"], ["cell_index"], "set_position")
    members = placed.join(cells, "cell_index", "left").withColumn("cell_id", F.coalesce("cell_id", F.lit(-1)))
    return H.fixed_sets(members, cells, SET_SIZE)
