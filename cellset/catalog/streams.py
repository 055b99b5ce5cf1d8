"""Streaming queries over shards that Spark derives from the given tables; each equals its batch result."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellset.catalog.aggregates import rounded_columns
from cellset.catalog.metrics import MANN_WHITNEY, de_cells
from cellset.catalog.registry import query, r6
from cellset.operators import metrics as M
from cellset.session import materialize
from cellset.sources.sinks import new_folder
from cellset.sources.surrogates import Tables
from cellset.streaming import ingest as X


def event_shards(t: Tables, copies: bool = False):
    """Events as several shard files; with ``copies`` every error event arrives twice."""
    folder = new_folder(t.spark)
    rows = t.read("events").select("event_id", "event_type", "user_id", "value")
    if copies:
        rows = rows.unionByName(rows.where("event_type = 'error'"))
    rows.repartitionByRange(3, "event_id").write.parquet(folder)
    return folder, rows.schema


@query("s02_stream_cells", "select event_id, event_type, value from events")
def s02(t: Tables):
    folder, schema = event_shards(t)
    out = new_folder(t.spark)
    stream = X.stream_cells(t.spark, folder, schema, 1).select("event_id", "event_type", "value")
    X.run_available(stream, new_folder(t.spark), lambda df, i: X.write_batch(df, out, i))
    return t.spark.read.parquet(out).drop("batch_id")


@query("x01_ingest", "select event_type, count(*) as events, cast(sum(event_id) as bigint) as key_sum from events group by event_type")
def x01(t: Tables):
    """Ingested in two runs: the second continues after the first and adds nothing twice."""
    folder, schema = event_shards(t)
    sink, checkpoint = new_folder(t.spark), new_folder(t.spark)
    for _ in range(2):
        X.ingest(t.spark, folder, schema, sink, checkpoint, files_per_batch=1)
    return t.spark.read.parquet(sink).groupBy("event_type").agg(F.count("*").alias("events"), F.sum("event_id").alias("key_sum"))


@query("x01_bounded_runs", "select event_id, event_type, value, event_id is not null as once from events")
def x01_bounded(t: Tables):
    """Runs of a third of the rows each, which stop inside batches; together they take every row once."""
    folder, schema = event_shards(t)
    sink, checkpoint = new_folder(t.spark), new_folder(t.spark)
    budget = t.read("events").count() // 3 + 1
    while X.ingest(t.spark, folder, schema, sink, checkpoint, files_per_batch=2, max_rows=budget) is None:
        pass
    copies = F.count("*").over(Window.partitionBy("event_id")) == 1
    return t.spark.read.parquet(sink).select("event_id", "event_type", "value", copies.alias("once"))


@query("x02_ingest_once", "select event_id, event_type, value from events")
def x02(t: Tables):
    folder, schema = event_shards(t, copies=True)
    sink = new_folder(t.spark)
    X.ingest_once(t.spark, folder, schema, sink, new_folder(t.spark), "event_id", files_per_batch=1)
    return t.spark.read.parquet(sink).select("event_id", "event_type", "value")


@query("x03_stream_audit", f"""
select event_type, count(value) as count, {r6("avg(value)")} as mean, {r6("stddev_pop(value)")} as std, min(value) as min,
 max(value) as max from events group by event_type""")
def x03(t: Tables):
    folder, schema = event_shards(t)
    out = X.stream_audit(t.spark, folder, schema, new_folder(t.spark), new_folder(t.spark), ["event_type"], "value", 1)
    return rounded_columns(out, "mean", "std")


@query("x04_incremental_gene_stats", f"""
with v as (select c.cell_id, c.gene_index, ln(1 + 10000.0 * sum(c.count) / l.library) as v from fx_counts c
  join fx_lib l on c.cell_id = l.cell_id group by c.cell_id, c.gene_index, l.library), n as (select count(*) as n from fx_lib)
select gene_index, {r6("sum(v) / max(n)")} as mean,
 {r6("greatest(sum(v * v) / max(n) - (sum(v) / max(n)) * (sum(v) / max(n)), 0)")} as variance from v cross join n group by gene_index""")
def x04(t: Tables):
    folder = new_folder(t.spark)
    t.counts.repartitionByRange(4, "cell_id").write.parquet(folder)
    out = X.incremental_gene_stats(t.spark, folder, t.counts.schema, new_folder(t.spark), new_folder(t.spark), "inputs-v1", 2)
    return rounded_columns(out, "mean", "variance")


@query("x05_fill_pending", "select o_orderkey, o_totalprice * 2 as doubled from orders")
def x05(t: Tables):
    """The cache holds one status already; only the other rows are computed."""
    sink = new_folder(t.spark)
    plan = t.read("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    compute = lambda df: df.select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled"))
    compute(plan.where("o_orderstatus = 'F'")).write.parquet(sink)
    X.fill_pending(plan, materialize(t.spark.read.parquet(sink)), "o_orderkey", compute, sink)
    return t.spark.read.parquet(sink)


@query("x06_progress", "select count(*) as processed, 0 as remaining from events")
def x06(t: Tables):
    folder, schema = event_shards(t)
    total = t.read("events").count()
    sink = new_folder(t.spark)
    run = X.ingest(t.spark, folder, schema, sink, new_folder(t.spark), files_per_batch=1)
    return X.progress(run, total, sink).agg(F.max("processed").alias("processed"), F.min("remaining").alias("remaining"))


@query("x07_fill_pending_labels", f"with {MANN_WHITNEY} select label, gene, {r6('u')} as u from mw")
def x07(t: Tables):
    """Scores exist for some conditions; the rest is filled in."""
    sink = new_folder(t.spark)
    cells = materialize(de_cells(t))
    score = lambda df: M.de_scores(df.unionByName(cells.where("label = 0")), "label", "pool", "gene", "v",
                                   F.col("label") == 0).select("label", "gene", "u")
    treated = cells.where("label <> 0")
    score(treated.where("label < 5")).write.parquet(sink)
    X.fill_pending(treated, materialize(t.spark.read.parquet(sink)), "label", score, sink)
    return rounded_columns(t.spark.read.parquet(sink), "u")
