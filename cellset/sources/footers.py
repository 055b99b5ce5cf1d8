"""Parquet footers as a table, and readers that open only the files and row groups which a plan names.

Files are opened inside tasks, by their full path, through the file system that the path's scheme names (local, HDFS, S3,
GCS); another one is given as ``opener``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellset.session import materialize

FOOTER = "shard string, row_group int, first_row long, rows int, group_bytes long"
#: Bytes that a task holds at once of a file that it hashes.
PIECE = 8 << 20


def open_file(path: str):
    """Random-access file of a full path."""
    from pyarrow import fs
    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def footer_table(spark: SparkSession, root: str, opener: Callable = open_file) -> DataFrame:
    """``FOOTER``: every row group of every file under ``root`` with the number of its first row; only footers are read."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                with opener(path) as source:
                    meta, first = pq.ParquetFile(source).metadata, 0
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        out.append((path, g, first, group.num_rows, group.total_byte_size))
                        first += group.num_rows
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             ["shard", "row_group", "first_row", "rows", "group_bytes"])

    # paths as the scan itself says them; without columns it reads footers only
    shards = spark.read.parquet(root).select(F.col("_metadata.file_path").alias("shard")).distinct()
    return shards.repartition(4 * spark.sparkContext.defaultParallelism, "shard").mapInArrow(run, FOOTER)


def with_row_groups(located: DataFrame, footers: DataFrame) -> DataFrame:
    """Rows with ``shard, row`` get ``row_group`` and ``row_in_group``; ``first_row + row_in_group = row`` holds for each.

    A row of an unknown file, or beyond the rows of its file, fails the job.
    """
    groups = materialize(footers.where("rows > 0").select(
        F.col("shard").alias("_shard"), "first_row", F.col("row_group").alias("_group"), "rows"))
    # rows and groups meet on stretches of the mean length of a group, so that a row meets few groups however many its file has
    length = int(groups.agg(F.avg("rows").alias("m")).first().m or 1)
    unit = lambda c: F.floor(c / F.lit(length))
    pieces = groups.withColumn("_unit", F.explode(F.sequence(unit(F.col("first_row")), unit(F.col("first_row") + F.col("rows") - 1))))
    inside = (F.col("row") >= F.col("first_row")) & (F.col("row") < F.col("first_row") + F.col("rows"))
    found = located.join(pieces, (F.col("shard") == F.col("_shard")) & (unit(F.col("row")) == F.col("_unit")) & inside, "left")
    message = F.concat(F.lit("no such row: "), F.coalesce("shard", F.lit("NULL")), F.lit(" "), F.coalesce(F.col("row").cast("string"), F.lit("NULL")))
    return found.where(F.assert_true(F.col("_group").isNotNull(), message).isNull()).withColumns({
        "row_group": F.col("_group"), "row_in_group": (F.col("row") - F.col("first_row")).cast("int"),
    }).drop("_shard", "_group", "_unit", "first_row", "rows")


def row_group_runs(batch) -> Iterator[tuple[str, int, int, int]]:
    """``(shard, row group, from, to)`` of the stretches of a sorted plan batch that stay in one row group."""
    shards, groups = batch.column("shard").to_pylist(), batch.column("row_group").to_pylist()
    at = 0
    for i in range(1, len(shards) + 1):
        if i == len(shards) or (shards[i], groups[i]) != (shards[at], groups[at]):
            yield shards[at], groups[at], at, i
            at = i


def scan_row_groups(plan: DataFrame, columns: list[str], schema: T.StructType, opener: Callable = open_file) -> DataFrame:
    """The planned rows (``shard, row_group, row_in_group`` and any other columns) with ``columns`` of their files.

    The plan is dealt by row group: every planned one is read once, by one task, and nothing else is opened but the footers of
    its file. ``schema`` names the types of ``columns``. A NULL place, an unknown row group or a row outside it fails the job;
    a repeated place gives the row again.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(T.StructType([schema[c] for c in columns]))
    names = plan.columns

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        now, source, held, table = None, None, None, None
        try:
            for batch in batches:
                for shard, group, at, to in row_group_runs(batch):
                    if shard is None or group is None:
                        raise ValueError("a planned place is NULL")
                    if shard != now:
                        if source is not None:
                            source.close()
                        source = opener(shard)
                        now, held, file = shard, None, pq.ParquetFile(source)
                    if group != held:
                        if not 0 <= group < file.num_row_groups:
                            raise ValueError(f"{shard} has no row group {group}")
                        held, table = group, file.read_row_group(group, columns=columns).select(columns).cast(wanted)
                    part = batch.slice(at, to - at)
                    rows = part.column("row_in_group")
                    if rows.null_count or pc.min(rows).as_py() < 0 or pc.max(rows).as_py() >= table.num_rows:
                        raise ValueError(f"a planned row lies outside row group {group} of {shard}")
                    taken = table.take(rows).combine_chunks()
                    arrays = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in taken.columns]
                    yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*names, *columns])
        finally:
            if source is not None:
                source.close()

    dealt = plan.repartition("shard", "row_group").sortWithinPartitions("shard", "row_group", "row_in_group")
    return dealt.mapInArrow(run, T.StructType([*plan.schema.fields, *[schema[c] for c in columns]]))


def file_digests(spark: SparkSession, root: str, pattern: str, opener: Callable = open_file) -> DataFrame:
    """``path, size_bytes, sha256`` of every file below ``root`` whose name fits; files of any size, hashed as streams."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            digests = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with opener(path) as source:
                    while piece := source.read(PIECE):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.string())], ["path", "size_bytes", "sha256"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    # sizes come from the listing; contents aren't read here
    listed = files.select("path", F.col("length").alias("size_bytes"))
    return listed.repartition(4 * spark.sparkContext.defaultParallelism, F.col("path")).mapInArrow(
        run, "path string, size_bytes long, sha256 string")
