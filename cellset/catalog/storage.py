"""Scan and sink queries: each writes the given tables in the wanted form and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellset.catalog.aggregates import raw_rows, rounded_columns
from cellset.catalog.registry import query, r6
from cellset.catalog.selection import SIDES, as_membership, sides
from cellset.functions import vectors as V
from cellset.functions.numbers import rounded
from cellset.operators.sampling import sample_sets
from cellset.session import materialize
from cellset.sources import footers, scans, sinks
from cellset.sources.surrogates import DIM, SET_SIZE, Tables


@query("s01_scan_cells", "select l_orderkey, l_partkey, l_quantity from lineitem")
def s01(t: Tables):
    schema = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()),
                           T.StructField("l_quantity", T.DoubleType()), T.StructField("l_returnflag", T.StringType())])
    return scans.scan_cells(t.spark, [t.path("lineitem")], ["l_orderkey", "l_partkey", "l_quantity"], schema)


def order_shards(t: Tables):
    folder = sinks.new_folder(t.spark)
    t.read("orders").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(folder)
    return folder


#: Rows of a row group in the shards that the locator queries write.
GROUP_ROWS = 500
LOCATED = f"""(select *, (row - row_group * {GROUP_ROWS})::int as row_in_group from (select *, (row // {GROUP_ROWS})::int as row_group from
 (select *, o_orderkey % 8 as shard, row_number() over (partition by o_orderkey % 8 order by o_orderkey) - 1 as row from orders)))"""


def grouped_shards(t: Tables) -> str:
    """Orders in eight shards by key, each in key order and row groups of ``GROUP_ROWS``."""
    folder = sinks.new_folder(t.spark)
    rows = t.read("orders").withColumn("bucket", F.col("o_orderkey") % 8)
    rows.repartition("bucket").sortWithinPartitions("bucket", "o_orderkey").write.option(
        "parquet.block.row.count.limit", GROUP_ROWS).partitionBy("bucket").parquet(folder)
    return folder


def located_orders(t: Tables, folder: str):
    rows = scans.with_locator(t.spark.read.parquet(folder)).drop("block_start")
    return footers.with_row_groups(rows, footers.footer_table(t.spark, folder))


@query("s03_with_locator", f"select o_orderkey, concat('bucket=', shard) as folder, row, row_group, row_in_group from {LOCATED}")
def s03(t: Tables):
    """Full path, row, row group and row in it of every order."""
    folder = F.element_at(F.split("shard", "/"), -2).alias("folder")
    return located_orders(t, grouped_shards(t)).select("o_orderkey", folder, "row", "row_group", "row_in_group")


@query("s04_planned_row_groups", f"""
select o_orderkey, o_totalprice, o_orderstatus, row_group from {LOCATED} where row_group % 2 = 0 and o_orderpriority < '3'""")
def s04_groups(t: Tables):
    """Planned rows read by tasks that open nothing but the planned row groups."""
    folder = grouped_shards(t)
    wanted = located_orders(t, folder).where("row_group % 2 = 0 and o_orderpriority < '3'")
    plan = materialize(wanted.select("shard", "row_group", "row_in_group"))
    columns = ["o_orderkey", "o_totalprice", "o_orderstatus"]
    return footers.scan_row_groups(plan, columns, t.read("orders").schema).select(*columns, "row_group")


@query("s04_scan_by_locator", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def s04(t: Tables):
    """Rows planned by their place (file, row) are found again through it."""
    folder = order_shards(t)
    plan = scans.with_locator(t.spark.read.parquet(folder)).where("o_orderstatus = 'F'").select("shard", "row")
    return scans.scan_by_locator(t.spark, folder, materialize(plan)).select("o_orderkey", "o_totalprice")


RAW_TEXT = """select concat(cell_line_id,'|',drug,'|',plate,'|',cast(dose_um as varchar)) as condition_id, cell_id % 5 as repeat_epoch,
 case when plate = 'plate2' then 'NaN' else printf('%.10g', avg((cell_id % 757) / 757.0)) end as cosine,
 case when plate = 'plate2' then '' else plate end as plate
from fx_cells where owner_type = 0 and dose_um is not null group by cell_line_id, drug, plate, dose_um, cell_id % 5"""


@query("s05_scan_index_csv", RAW_TEXT)
def s05(t: Tables):
    """Written and read back as text: ten digits, ``NaN`` for undefined, empty stays empty."""
    folder = sinks.new_folder(t.spark)
    rows = raw_rows(t)
    undefined = F.when(F.col("plate") == "plate2", F.lit(float("nan"))).otherwise(F.col("cosine"))
    sinks.sink_index_csv(rows.withColumns({
        "cosine": undefined, "plate": F.when(F.col("plate") != "plate2", F.col("plate"))}),
        folder, ["condition_id", "repeat_epoch", "cosine", "plate"])
    schema = T.StructType([T.StructField("condition_id", T.StringType()), T.StructField("repeat_epoch", T.LongType()),
                           T.StructField("cosine", T.StringType()), T.StructField("plate", T.StringType())])
    return scans.scan_index_csv(t.spark, folder, schema)


@query("s10_sink_index_csv", f"""
select concat(cell_line_id,'|',drug,'|',plate,'|',cast(dose_um as varchar)) as condition_id, cell_id % 5 as repeat_epoch,
 {r6("avg((cell_id % 1009) / 1009.0)")} as energy from fx_cells where owner_type = 0 and dose_um is not null
 group by cell_line_id, drug, plate, dose_um, cell_id % 5""")
def s10(t: Tables):
    folder = sinks.new_folder(t.spark)
    sinks.sink_index_csv(raw_rows(t), folder, ["condition_id", "repeat_epoch", "energy"])
    schema = T.StructType([T.StructField("condition_id", T.StringType()), T.StructField("repeat_epoch", T.LongType()),
                           T.StructField("energy", T.DoubleType())])
    return rounded_columns(scans.scan_index_csv(t.spark, folder, schema), "energy")


@query("s06_scan_manifest", """
select o_orderstatus as split, count(*) as rows, cast(max(o_orderkey) as bigint) as last_key, false as has_mean from orders group by o_orderstatus""")
def s06(t: Tables):
    """Manifest rows with a nested struct and an undefined number that must come back as null."""
    folder = sinks.new_folder(t.spark)
    rows = t.read("orders").groupBy(F.col("o_orderstatus").alias("split")).agg(
        F.struct(F.count("*").alias("rows"), F.max("o_orderkey").alias("last_key")).alias("counts")).withColumn(
        "mean", F.lit(float("nan")))
    sinks.sink_manifest(rows, folder)
    schema = "split string, counts struct<rows long, last_key long>, mean double"
    back = t.spark.read.schema(schema).json(folder)
    return back.select("split", "counts.rows", "counts.last_key", F.col("mean").isNotNull().alias("has_mean"))


@query("s11_sink_manifest", """
select event_type, concat('{"event_type":"', event_type, '","events":', cast(count(*) as varchar), ',"score":null}') as text
from events group by event_type""")
def s11(t: Tables):
    folder = sinks.new_folder(t.spark)
    rows = t.read("events").groupBy("event_type").agg(F.count("*").alias("events")).withColumn("score", F.lit(float("nan")))
    sinks.sink_manifest(rows, folder)
    return t.spark.read.text(folder).select(F.get_json_object("value", "$.event_type").alias("event_type"),
                                            F.col("value").alias("text"))


@query("s07_scan_vectors", f"select vec_id, {r6('sum(v)')} as total from fx_vec_full group by vec_id")
def s07(t: Tables):
    table = scans.scan_vectors(t.spark, t.path("embeddings"), "embedding", DIM)
    return table.select("vec_id", rounded(V.total(F.col("embedding"))).alias("total"))


@query("s08_scan_keys", """
select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)""")
def s08(t: Tables):
    keys = t.read("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return scans.scan_keys(t.spark, t.path("orders"), "o_custkey", keys).select("o_orderkey", "o_totalprice")


@query("s09_scan_plan_range", "select cell_index, owner_id from fx_indexed where cell_index >= 1000 and cell_index < 3000")
def s09(t: Tables):
    folder = sinks.new_folder(t.spark)
    t.indexed.select("cell_index", "owner_id").repartitionByRange("cell_index").sortWithinPartitions("cell_index").write.parquet(folder)
    return scans.scan_plan_range(t.spark, folder, "cell_index", 1000, 3000)


@query("s12_sink_plan", f"""
select o_orderkey as embedding_index, (o_custkey % 3)::int as worker_id, shard::int as shard_index, row_group::smallint as row_group_index,
 row_in_group as row_index_in_row_group, row::int as row_index_in_shard, (o_custkey % 2)::tinyint as owner_type,
 row_number() over (partition by o_custkey % 3 order by shard, row) - 1 as part_index from {LOCATED}""")
def s12(t: Tables):
    """Plan with full locators and narrow types, written per worker in physical order and read back."""
    folder, shards = sinks.new_folder(t.spark), grouped_shards(t)
    cells = located_orders(t, shards).withColumns({
        "embedding_index": F.col("o_orderkey"), "owner_type": F.col("o_custkey") % 2, "worker_id": (F.col("o_custkey") % 3).cast("int")})
    plan = sinks.locator_plan(cells, "worker_id", ["embedding_index", "owner_type"])
    sinks.sink_plan(plan, folder, "worker_id", ["part_index"])
    return t.spark.read.parquet(folder).drop("shard_path")


@query("s13_sink_vectors", f"select vec_id as cell_index, {r6('sum(v * v)')} as squares from fx_vec_full group by vec_id")
def s13(t: Tables):
    folder = sinks.new_folder(t.spark)
    sinks.sink_vectors(t.vectors.select(F.col("vec_id").alias("cell_index"), "embedding"), folder)
    v = F.col("embedding")
    return scans.scan_vectors(t.spark, folder, "embedding", DIM).select("cell_index", rounded(V.dot(v, v)).alias("squares"))


@query("s14_sink_membership", f"""
with {SIDES} select pair_id as condition_id, epoch as repeat_epoch,
 string_agg(case when side = 'control' then cast(cell_index as varchar) end, ',' order by cell_index) as control,
 string_agg(case when side = 'treated' then cast(cell_index as varchar) end, ',' order by cell_index) as treated
from s group by pair_id, epoch""")
def s14(t: Tables):
    folder = sinks.new_folder(t.spark)
    sinks.sink_membership(as_membership(sample_sets(sides(t), SET_SIZE, [0, 1])), folder)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return t.spark.read.parquet(folder).select("condition_id", "repeat_epoch", text("control_idx").alias("control"),
                                               text("treated_idx").alias("treated"))


BUNDLE = """select concat('label', cast(label as varchar), '_', case when label = 0 then 'control' else 'treated' end, '_', lpad(cast(vec_id as varchar), 8, '0'))
 as obs_name, case when label = 0 then 'non-targeting' else concat('label', cast(label as varchar)) end as perturbation"""


@query("s15_expression_bundle", f"""
{BUNDLE}, {r6("sum(v)")} as total from fx_vec_long group by vec_id, label""")
def s15(t: Tables):
    sets = t.vectors.select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("condition_id"),
                            F.when(F.col("label") == 0, "control").otherwise("treated").alias("side"),
                            F.col("vec_id").alias("cell_index"))
    expr = t.vectors.select(F.col("vec_id").alias("cell_index"), F.col("embedding").alias("expr"))
    bundle = sinks.expression_bundle(sets, expr, t.panel)
    return bundle["obs"].join(bundle["x"], "obs_name").select(
        "obs_name", "perturbation", rounded(V.total(F.col("expr"))).alias("total"))


@query("s16_artifact_inventory")
def s16(t: Tables):
    return scans.artifact_inventory(t.spark, t.folder, "*.parquet")


@query("s17_merge_parts", f"""
with n as (select vec_id, label, sqrt(sum(v * v)) as norm from fx_vec_full group by vec_id, label)
select label, count(*) as rows, {r6("min(norm)")} as norm_min, {r6("avg(norm)")} as norm_mean, {r6("max(norm)")} as norm_max from n group by label""")
def s17(t: Tables):
    """Two workers' parts, numbered on their own, come back as one table with statistics per section."""
    keyed = t.vectors.select((F.col("vec_id") % 2).alias("worker_id"), F.floor(F.col("vec_id") / 2).alias("part_index"),
                             F.col("vec_id").alias("cell_index"), "label", "embedding")
    parts = [keyed.where(F.col("worker_id") == w).select("worker_id", "part_index", "embedding") for w in (0, 1)]
    plan = keyed.select("worker_id", "part_index", "cell_index", "label")
    stats = sinks.merge_parts(parts, plan, "embedding", ["label"])[1]
    return rounded_columns(stats.select("label", "rows", "norm_min", "norm_mean", "norm_max"), "norm_min", "norm_mean", "norm_max")


