"""Incremental ingestion with Structured Streaming.

Every batch writes its own folder of the sink, replacing it if the batch is run again, so a restart neither loses nor
repeats rows. Statistics are kept as mergeable partial rows per batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cellset.operators import clean
from cellset.operators.scale import first_in_order
from cellset.sources.scans import stream_cells


def claim(spark: SparkSession, sink: str, owner: str) -> None:
    """Tie a sink to the checkpoint (and inputs) that fill it; any other owner is refused before anything is written.

    Batch numbers start again with a new checkpoint, so two checkpoints would overwrite each other's batches.
    """
    try:
        known = spark.read.text(f"{sink}/_owner").first()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        spark.createDataFrame([(owner,)], "owner string").write.text(f"{sink}/_owner")
        return
    if known is None or known[0] != owner:
        raise ValueError(f"the sink {sink} belongs to {known and known[0]}, not to {owner}")


def write_batch(df: DataFrame, sink: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what is there now in bounded batches, then stop."""
    query = (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


class BudgetReached(Exception):
    """Ends a run whose row budget is used up; the batch is not committed, so the next run continues with it."""


def rows_written(spark: SparkSession, sink: str, batch_id: int) -> int:
    """Rows that an earlier attempt left in a batch's folder (its durable cursor)."""
    try:
        return spark.read.parquet(f"{sink}/batch_id={batch_id}").count()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return 0


def write_within(df: DataFrame, sink: str, batch_id: int, room: int) -> int:
    """Write a batch, or its first rows in physical order up to ``room`` rows more than stand there; returns how many are new."""
    spark, columns = df.sparkSession, [c for c in df.columns if c not in ("_shard", "_place")]
    done, n = rows_written(spark, sink, batch_id), df.count()
    if n - done <= room:
        write_batch(df.select(*columns), sink, batch_id)
        return n - done
    # the batch's rows come from its source files, so reading them while its folder is replaced is safe
    write_batch(first_in_order(df, ["_shard", "_place"], done + room).select(*columns), sink, batch_id)
    raise BudgetReached(f"{room} rows of batch {batch_id} taken")


def ingest(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, files_per_batch: int = 64,
           transform: Callable[[DataFrame], DataFrame] | None = None, inputs: str = "", max_rows: int | None = None) -> StreamingQuery | None:
    """Append new shard files to the sink; a further call continues where the last one ended.

    The sink belongs to its checkpoint and to ``inputs``, a fingerprint of what is ingested. ``max_rows`` bounds the new rows of this run,
    exactly and across batches: the run stops inside a batch, whose rest the next run takes first (then there is no query to
    return). A bound needs rows as they are, without ``transform``.
    """
    claim(spark, sink, f"{checkpoint} {inputs}".rstrip())
    stream = stream_cells(spark, source, schema, files_per_batch)
    if max_rows is None:
        step = transform or (lambda df: df)
        return run_available(stream, checkpoint, lambda df, batch_id: write_batch(step(df), sink, batch_id))
    if transform is not None:
        raise ValueError("a run with a row budget takes rows as they are")
    left = max_rows

    def each(df: DataFrame, batch_id: int) -> None:
        nonlocal left
        left -= write_within(df, sink, batch_id, left)

    placed = stream.select("*", F.col("_metadata.file_path").alias("_shard"), F.col("_metadata.row_index").alias("_place"))
    try:
        return run_available(placed, checkpoint, each)
    except StreamingQueryException as error:
        if BudgetReached.__name__ not in str(error):
            raise
        return None


#: State store on executors' disks with change logs in the checkpoint, so state may outgrow memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest_once(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, key: str,
                files_per_batch: int = 64) -> StreamingQuery:
    """Ingestion that keeps the first arrival of every key (NULL is one), across batches and restarts.

    Seen keys are state of the stream, versioned by its checkpoint: a batch looks up its own keys only, and neither the sink
    nor earlier batches are read again, however long the stream has run.
    """
    claim(spark, sink, checkpoint)
    names = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE,
             "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        stream = stream_cells(spark, source, schema, files_per_batch).dropDuplicates([key])
        return run_available(stream, checkpoint, lambda df, batch_id: write_batch(df, sink, batch_id))
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def partial_stats(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(value * value).alias("ss"),
                               F.min(value).alias("lo"), F.max(value).alias("hi"))


def merge_stats(partials: DataFrame, by: list[str]) -> DataFrame:
    """count, mean, population std, min and max from partial rows."""
    n, mean = F.sum("n"), F.sum("s") / F.sum("n")
    return partials.groupBy(*by).agg(
        n.alias("count"), mean.alias("mean"),
        F.sqrt(F.greatest(F.sum("ss") / n - mean * mean, F.lit(0.0))).alias("std"),
        F.min("lo").alias("min"), F.max("hi").alias("max"))


def stream_audit(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, by: list[str],
                 value: str, files_per_batch: int = 64) -> DataFrame:
    """Running statistics over the stream: one small partial table per batch, merged on read."""
    ingest(spark, source, schema, sink, checkpoint, files_per_batch,
           lambda df: partial_stats(df, by, F.col(value)))
    return merge_stats(spark.read.parquet(sink), by)


def running_audit(spark: SparkSession, source: str, schema: T.StructType, by: list[str], value: str,
                  files_per_batch: int = 64) -> DataFrame:
    """The same as a streaming aggregate (to be written in complete mode)."""
    return stream_cells(spark, source, schema, files_per_batch).groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))


def refuse_split_cells(spark: SparkSession, cells: str) -> None:
    """Fail if a cell has come from two shards; only ``cell_id, shard`` pairs are compared."""
    shards = spark.read.parquet(cells).groupBy("cell_id").agg(F.count_distinct("shard").alias("n")).where("n > 1")
    if split := shards.orderBy("cell_id").limit(5).collect():
        raise ValueError("cells lie in more than one shard: " + ", ".join(str(r.cell_id) for r in split))


def incremental_gene_stats(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str,
                           fingerprint: str, files_per_batch: int = 64) -> DataFrame:
    """Per-gene mean and variance of CP10K-log1p from long count shards, resumable.

    A cell must lie in one shard: its pairs with shards are kept beside the sums, and a cell with two fails the run. State of other
    inputs (another fingerprint) is refused before anything is written.
    """
    cells = f"{sink}/_cells"  # not part of the sink's table

    def partial(df: DataFrame) -> DataFrame:
        once = clean.collapse_duplicates(df)
        v = clean.cp10k(F.col("count"), F.col("library"))
        genes = clean.with_library(once).groupBy("gene_index").agg(F.sum(v).alias("s"), F.sum(v * v).alias("ss"))
        counted = clean.positive_library(clean.library_size(once)).agg(
            F.lit(-1).cast("long").alias("gene_index"), F.count("*").cast("double").alias("s"), F.lit(0.0).alias("ss"))
        return genes.unionByName(counted)

    def each(df: DataFrame, batch_id: int) -> None:
        write_batch(df.select("cell_id", "shard").distinct(), cells, batch_id)
        write_batch(partial(df.drop("shard")), sink, batch_id)

    claim(spark, sink, f"{checkpoint} {fingerprint}".rstrip())
    stream = stream_cells(spark, source, schema, files_per_batch).select("*", F.col("_metadata.file_path").alias("shard"))
    run_available(stream, checkpoint, each)
    refuse_split_cells(spark, cells)
    table = spark.read.parquet(sink)
    n = table.where("gene_index = -1").agg(F.sum("s").alias("n")).scalar()
    sums = table.where("gene_index >= 0").groupBy("gene_index").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.col("s") / F.col("_n")
    return sums.withColumn("_n", n).select(
        "gene_index", mean.alias("mean"), F.greatest(F.col("ss") / F.col("_n") - mean * mean, F.lit(0.0)).alias("variance"))


def fill_pending(plan: DataFrame, done: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], sink: str) -> None:
    """Compute only the planned rows whose key is not done yet, and append them."""
    pending = plan.join(done.select(key), key, "left_anti")
    compute(pending).write.mode("append").parquet(sink)


def progress(query: StreamingQuery, total_rows: int | None = None, sink: str | None = None) -> DataFrame:
    """One row per recent batch: rows, rate, rows so far, rows and seconds left.

    Spark remembers the last hundred batches; rows of earlier ones are counted in the ``sink``.
    """
    spark = SparkSession.active()
    recent = query.recentProgress
    rows, so_far = [], 0
    if sink and recent and int(recent[0]["batchId"]) > 0:
        so_far = spark.read.parquet(sink).where(F.col("batch_id") < int(recent[0]["batchId"])).count()
    for p in recent:
        n, rate = int(p["numInputRows"]), float(p.get("processedRowsPerSecond") or 0.0)
        so_far += n
        left = None if total_rows is None else total_rows - so_far
        rows.append((int(p["batchId"]), n, rate, so_far, left, left / rate if left is not None and rate else None))
    return spark.createDataFrame(rows, "batch_id long, rows long, rate double, processed long, remaining long, eta double")
