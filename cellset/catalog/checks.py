"""Gate queries. The oracle computes the same observed and expected numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellset.catalog.aggregates import raw_rows
from cellset.catalog.registry import query
from cellset.catalog.selection import TOTALS, chosen_subset, sides
from cellset.operators import clean, quality as Q
from cellset.operators.joins import expand_ranges
from cellset.operators.sampling import sample_sets
from cellset.operators.windows import assign_ranges, spot_indices
from cellset.operators.scale import dense_index
from cellset.plans.audit import subset_audit
from cellset.session import materialize
from cellset.sources.sinks import new_folder
from cellset.sources.scans import artifact_inventory
from cellset.sources.surrogates import DIM, PANEL, SET_SIZE, Tables


def row(name, observed, expected):
    return f"select '{name}' as \"check\", cast(({observed}) as bigint) as observed, cast(({expected}) as bigint) as expected"


def result(*rows):
    return "select *, observed = expected as passed from (" + " union all ".join(rows) + ") c"


@query("q01_key_unique", result(
    row("order_key", "select count(distinct o_orderkey) from orders", "select count(*) from orders"),
    row("line_key", "select count(distinct l_orderkey) from lineitem", "select count(*) from lineitem")))
def q01(t: Tables):
    return Q.run_checks([Q.unique_key(t.read("orders"), "o_orderkey", "order_key"),
                         Q.unique_key(t.read("lineitem"), "l_orderkey", "line_key")])


@query("q02_index_contiguous", result(
    row("gene_index", "select count(*) from fx_genes", "select count(*) from fx_genes"),
    row("token_id", "-1", "select count(*) from fx_genes")))
def q02(t: Tables):
    return Q.run_checks([Q.contiguous_index(t.genes, "gene_index", "gene_index"),
                         Q.contiguous_index(t.genes, "token_id", "token_id")])


@query("q03_ranges", result(row("ranges", "0", "0"), row(
    "shifted", "select count(*) from fx_ranges where cells % 40 = 0 and start <> 0", "0")))
def q03(t: Tables):
    ranges = materialize(assign_ranges(t.owners, ["owner_type", "owner_id"]))
    late = ranges.withColumn("stop", F.col("stop") - F.when((F.col("cells") % 40 == 0) & (F.col("start") != 0), 1).otherwise(0))
    return Q.run_checks([Q.ranges_back_to_back(ranges, ["start"], "ranges"), Q.none_of(
        late, "shifted", F.col("stop") - F.col("start") != F.col("cells"))])


@query("q04_split_leakage", result(
    row("edge", "select count(*) from (select edge_id from fx_labelled group by edge_id having count(distinct split) > 1) x", "0"),
    row("drug", "select count(*) from (select drug from fx_labelled group by drug having count(distinct split) > 1) x", "0")))
def q04(t: Tables):
    return Q.run_checks([Q.no_key_in_two(t.labelled, "edge_id", "split", "edge"),
                         Q.no_key_in_two(t.labelled, "drug", "split", "drug")])


@query("q05_drugs_seen", result(row(
    "seen", "select count(*) from fx_labelled where split <> 'train' and drug not in (select drug from fx_labelled where split = 'train')", "0")))
def q05(t: Tables):
    return Q.run_checks([Q.keys_known(t.labelled.where("split <> 'train'"), t.labelled.where("split = 'train'"), "drug", "seen")])


@query("q06_covered_once", result(
    row("index", "select count(*) from fx_indexed", "select count(*) from fx_indexed"),
    row("lines", """with s as (select l_orderkey as k, count(*) as n from lineitem group by 1)
     select count(case when n = 1 then 1 end) - count(case when n > 1 then 1 end) from orders left join s on k = o_orderkey""",
        "select count(*) from orders")))
def q06(t: Tables):
    cells = materialize(t.indexed.select("cell_index"))
    whole = cells.agg(F.lit(0).cast("long").alias("start"), F.count("*").alias("stop"))
    planned = expand_ranges(whole, [])
    return Q.run_checks([Q.covered_once(planned, cells, "cell_index", "index"), Q.covered_once(
        t.read("orders").select(F.col("o_orderkey").alias("k")), t.read("lineitem").select(F.col("l_orderkey").alias("k")),
        "k", "lines")])


@query("q07_vectors", result(
    row("finite", "select count(*) from embeddings", "select count(*) from embeddings"), row("signed", "2", "2"),
    row("nonnegative", "select count(*) from embeddings where list_min(embedding) >= 0", "select count(*) from embeddings")))
def q07(t: Tables):
    return Q.run_checks([Q.vectors_finite(t.vectors, "embedding", "finite"), Q.vectors_signed(t.vectors, "embedding", "signed"),
                         Q.vectors_nonnegative(t.vectors, "embedding", "nonnegative")])


@query("q08_set_size", result(row(
    "sets", "select count(*) * 4 from fx_conditions where treated_cells >= 16", "select count(*) * 4 from fx_conditions where treated_cells >= 16")))
def q08(t: Tables):
    sets = sample_sets(sides(t), SET_SIZE, [0, 1])
    return Q.run_checks([Q.set_sizes(sets, ["pair_id", "side", "epoch"], "cell_index", SET_SIZE, "sets")])


@query("q09_owner_agrees", result(
    row("pool_line", """select count(*) from fx_conditions c left join fx_pools p on p.control_pool_id = c.control_pool_id
 where p.cell_line_id is distinct from c.cell_line_id""", "0"), row("sample", "select count(*) from fx_owned where owner_type = 0 and sample_id = 's3'", "0")))
def q09(t: Tables):
    joined = t.conditions.join(t.pools.select("control_pool_id", F.col("cell_line_id").alias("_l")), "control_pool_id", "left")
    listed = F.array_contains(F.split(F.lit("s0|s1|s2"), r"\|"), F.col("sample_id"))
    return Q.run_checks([Q.none_of(joined, "pool_line", ~F.col("cell_line_id").eqNullSafe(F.col("_l"))),
                         Q.none_of(t.owned.where("owner_type = 0"), "sample", ~listed)])


@query("q10_contract", result(
    row("regions", "select count(*) from region", "5"),
    row("plates", "select count(*) from fx_cells where plate not in ('plate6', 'plate14')", "0")))
def q10(t: Tables):
    return Q.run_checks([Q.row_count(t.read("region"), 5, "regions"),
                         Q.allowed_values(t.cells, "plate", ["plate6", "plate14"], "plates")])


@query("q11_complete", result(row(
    "repeats", """select count(*) from (select cell_line_id, drug, plate, dose_um from fx_cells where owner_type = 0 and dose_um is not null
     group by all having count(distinct cell_id % 5) = 5) x""", "select count(*) from fx_conditions")))
def q11(t: Tables):
    return Q.run_checks([Q.evaluation_complete(raw_rows(t), "condition_id", "repeat_epoch", [0, 1, 2, 3, 4], "energy", "repeats")])


@query("q12_spot_check", result(row("panel_cache", "64", "64")))
def q12(t: Tables):
    """Evenly spaced cells recomputed from raw entries must equal the panel cache exactly."""
    cells = clean.cleaned(t.ragged, t.genes)
    cache = materialize(dense_index(clean.panel_target(cells, t.panel, PANEL).select("cell_id", "target"), ["cell_id"], "row"))
    n = cache.agg(F.count("*").alias("n")).scalar()
    spots = t.spark.range(1).select(n.alias("n")).select(F.explode(spot_indices(F.col("n"), 64)).alias("row"))
    chosen = cache.join(spots, "row", "left_semi").select("cell_id")
    again = clean.panel_target(clean.cleaned(t.ragged.join(chosen, "cell_id", "left_semi"), t.genes), t.panel, PANEL)
    return Q.run_checks([Q.spot_check(cache, again, "cell_id", "target", "panel_cache")])


@query("q13_manifest_current", result(row("artifacts", "1", "2")))
def q13(t: Tables):
    """Two recorded artifacts of which one carries an outdated hash."""
    folder = new_folder(t.spark)
    t.read("region").coalesce(1).write.parquet(folder + "/region")
    t.read("nation").coalesce(1).write.parquet(folder + "/nation")
    inventory = materialize(artifact_inventory(t.spark, folder, "*.parquet"))
    stale = F.when(F.col("path").contains("/nation/"), F.lit("0")).otherwise(F.col("sha256"))
    manifest = inventory.select("path", stale.alias("sha256"), "size_bytes", F.lit("frozen").alias("status"))
    return Q.run_checks([Q.manifest_current(manifest, inventory, ["pass", "frozen"], "artifacts")])


@query("q14_subset_audit", result(*[row(f"{s}_conditions", str(n), str(n)) for s, n in TOTALS.items()],
                                  row("cell_lines", "5", "5"), row("pair_unique", "95", "95"),
                                  row("condition_index_contiguous", "95", "95"),
                                  row("pool_index_contiguous", "15", "15"), row("ranges_back_to_back", "0", "0"),
                                  row("edge_in_one_split", "0", "0"), row("drugs_seen_in_train", "0", "0")))
def q14(t: Tables):
    conditions, pools = chosen_subset(t)
    return subset_audit(materialize(conditions), pools, TOTALS, 5)


@query("q15_alignment", result(
    row("rows_aligned", "select count(*) from embeddings", "select count(*) from embeddings"),
    row("panel_rank", "20", "20"), row("constant_features", "0", "0")))
def q15(t: Tables):
    a, b = t.vectors.select("vec_id"), t.vectors.select("vec_id", F.col("embedding").alias("v"))
    return Q.run_checks([Q.aligned([a, b.select("vec_id")], "vec_id", "rows_aligned"),
                         Q.contiguous_index(t.panel, "panel_rank", "panel_rank"),
                         Q.no_constant_features(t.vectors, ["label"], "embedding", DIM, "constant_features")])


