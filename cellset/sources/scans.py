"""Readers: declared schemas, locators, plans, keys, indexes and manifests."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellset.sources.footers import file_digests

CELL_SCHEMA = T.StructType([
    T.StructField("genes", T.ArrayType(T.LongType())), T.StructField("expressions", T.ArrayType(T.FloatType())),
    T.StructField("drug", T.StringType()), T.StructField("sample", T.StringType()),
    T.StructField("BARCODE_SUB_LIB_ID", T.StringType()), T.StructField("cell_line_id", T.StringType()),
    T.StructField("plate", T.StringType())])


def scan_cells(spark: SparkSession, paths: list[str], columns: list[str], schema: T.StructType = CELL_SCHEMA) -> DataFrame:
    """Cell shards with a declared schema; only the named columns are read."""
    return spark.read.schema(schema).parquet(*paths).select(*columns)


def stream_cells(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def with_locator(df: DataFrame) -> DataFrame:
    """Physical place of every row: full path of the file, row in file, start of the file block it was read from."""
    return df.select("*", F.col("_metadata.file_path").alias("shard"), F.col("_metadata.row_index").alias("row"),
                     F.col("_metadata.file_block_start").alias("block_start"))


def scan_by_locator(spark: SparkSession, root: str, plan: DataFrame) -> DataFrame:
    """Rows named by a plan ``shard, row``, whatever its size; files that the plan doesn't name are never opened.

    Shards are full paths, and ``root`` gives the partition columns. ``footers.scan_row_groups`` also leaves out unplanned row groups.
    """
    # names of files only, as many as the planned scan lists itself
    shards = [unquote(r.shard) for r in plan.select("shard").distinct().collect()]
    if not shards:
        return with_locator(spark.read.parquet(root)).join(plan, ["shard", "row"])
    return with_locator(spark.read.option("basePath", root).parquet(*sorted(shards))).join(plan, ["shard", "row"])


def scan_index_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Index CSV: header, byte-order mark tolerated, no missing-value inference; empty text stays empty text."""
    texts = [f.name for f in schema if isinstance(f.dataType, T.StringType)]
    return spark.read.schema(schema).option("header", True).option("nanValue", "NaN").csv(path).na.fill("", texts)


def scan_manifest(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def scan_vectors(spark: SparkSession, path: str, column: str, dim: int) -> DataFrame:
    """Vector table; a row of another width fails the job."""
    table = spark.read.parquet(path)
    return table.where(F.assert_true(F.size(column) == dim, F.lit(f"vector width is not {dim}")).isNull())


def scan_keys(spark: SparkSession, path: str, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key is wanted, by a semi join; the planner may prune the scan with the keys at run time."""
    return spark.read.parquet(path).join(keys.select(key), key, "left_semi")


def scan_plan_range(spark: SparkSession, path: str, column: str, start: int, stop: int) -> DataFrame:
    """Half-open slice of a plan written in order; row groups outside it are skipped by their statistics."""
    at: Column = F.col(column)
    return spark.read.parquet(path).where((at >= start) & (at < stop))


def artifact_inventory(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Path, size and SHA-256 of every file, of any size; hashed as streams in the tasks."""
    return file_digests(spark, root, pattern)
