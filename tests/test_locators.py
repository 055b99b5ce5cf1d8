"""Footers, planned reads, plans, file hashes and merges of parts."""

import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from cellset.sources import footers, scans, sinks


def shards(spark, rows=1000, group=70):
    folder = sinks.new_folder(spark)
    spark.range(rows).selectExpr("id", "id % 3 as bucket", "concat('t', id) as text").repartition("bucket").sortWithinPartitions(
        "bucket", "id").write.option("parquet.block.row.count.limit", group).partitionBy("bucket").parquet(folder)
    return folder


def located(spark, folder):
    return footers.with_row_groups(scans.with_locator(spark.read.parquet(folder)), footers.footer_table(spark, folder))


def spoil(folder, name):
    """Overwrite one file, checksum aside, so that opening it fails."""
    path = glob.glob(f"{folder.removeprefix('file:')}/{name}/*.parquet")[0]
    with open(path, "r+b") as f:
        f.write(b"\0" * os.path.getsize(path))
    side = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(side):
        os.remove(side)


def test_row_groups_of_rows(spark):
    folder = shards(spark)
    table = footers.footer_table(spark, folder).collect()
    assert sum(r.rows for r in table) == 1000 and max(r.rows for r in table) <= 70 and len({r.shard for r in table}) == 3
    rows = located(spark, folder).collect()
    first = {(r.shard, r.row_group): r.first_row for r in table}
    assert len(rows) == 1000 and all(first[r.shard, r.row_group] + r.row_in_group == r.row for r in rows)
    assert len({r.row_group for r in rows}) > 4
    lost = scans.with_locator(spark.read.parquet(folder)).withColumn("row", F.col("row") + 900)
    with pytest.raises(Exception, match="no such row"):
        footers.with_row_groups(lost, footers.footer_table(spark, folder)).collect()


def test_only_planned_files_are_opened(spark):
    folder = shards(spark)
    rows = located(spark, folder).where("bucket <> 1")
    plan = spark.createDataFrame(rows.where("id % 10 = 0").select("shard", "row", "row_group", "row_in_group", "id").collect())
    schema = spark.read.parquet(folder).schema
    spoil(folder, "bucket=1")
    with pytest.raises(Exception):
        spark.read.parquet(folder).select(F.max("text")).collect()
    want = sorted(i for i in range(0, 1000, 10) if i % 3 != 1)
    by_file = scans.scan_by_locator(spark, folder, plan.select("shard", "row")).collect()
    assert sorted(r.id for r in by_file) == want and {r.bucket for r in by_file} == {0, 2}
    by_group = footers.scan_row_groups(plan.withColumnRenamed("id", "planned"), ["text", "id"], schema).collect()
    assert sorted(r.id for r in by_group) == want and all(r.planned == r.id and r.text == f"t{r.id}" for r in by_group)
    assert footers.scan_row_groups(plan.limit(0), ["text"], schema).count() == 0
    assert scans.scan_by_locator(spark, shards(spark, 10), plan.select("shard", "row").limit(0)).count() == 0


def test_each_planned_row_group_is_read_once(spark, tmp_path):
    folder, seen = shards(spark, group=50), str(tmp_path)
    rows = located(spark, folder).where("row_group in (0, 2)")

    def watched(path):
        with open(f"{seen}/{os.path.basename(path)}-{os.urandom(4).hex()}", "w"):
            return footers.open_file(path)

    out = footers.scan_row_groups(rows.select("shard", "row_group", "row_in_group"), ["id"], spark.read.parquet(folder).schema, watched)
    assert len({r.id for r in out.collect()}) == rows.count()
    assert len(os.listdir(seen)) <= 6  # two row groups of three files


@pytest.mark.parametrize("change,match", [
    ("10000 as row_in_group", "outside row group"), ("-1 as row_in_group", "outside row group"), ("99 as row_group", "no row group"),
    ("cast(null as int) as row_group", "NULL"), ("'file:///none.parquet' as shard", "none.parquet")])
def test_wrong_places_fail(spark, change, match):
    folder = shards(spark, 100)
    plan = located(spark, folder).select("shard", "row_group", "row_in_group")
    plan = plan.selectExpr(*[c for c in plan.columns if not change.endswith(f" {c}")], change)
    with pytest.raises(Exception, match=match):
        footers.scan_row_groups(plan, ["id"], spark.read.parquet(folder).schema).collect()


def test_plan_is_narrow_and_ordered(spark):
    folder = shards(spark)
    cells = located(spark, folder).withColumns({"worker_id": F.col("id") % 2, "owner_type": F.lit(1), "embedding_index": F.col("id")})
    plan = sinks.locator_plan(cells, "worker_id", ["embedding_index", "owner_type"])
    kinds = {f.name: f.dataType.simpleString() for f in plan.schema}
    assert {c: kinds[c] for c in ("row_group_index", "row_index_in_shard", "owner_type", "part_index")} == {
        "row_group_index": "smallint", "row_index_in_shard": "int", "owner_type": "tinyint", "part_index": "bigint"}
    rows = plan.collect()
    for worker in (0, 1):
        own = sorted((r for r in rows if r.worker_id == worker), key=lambda r: r.part_index)
        assert [r.part_index for r in own] == list(range(500))
        places = [(r.shard_path, r.row_index_in_shard) for r in own]
        assert places == sorted(places)
    with pytest.raises(Exception, match="owner_type is missing or out of range"):
        sinks.locator_plan(cells.withColumn("owner_type", F.lit(300)), "worker_id", ["embedding_index", "owner_type"]).collect()


def test_large_files_are_hashed_as_streams(spark, tmp_path):
    (tmp_path / "small.bin").write_bytes(b"abc")
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate((1 << 31) + 100)
    digest, piece = hashlib.sha256(), bytes(1 << 20)
    for _ in range(1 << 11):
        digest.update(piece)
    digest.update(bytes(100))
    rows = {os.path.basename(r.path): (r.size_bytes, r.sha256) for r in scans.artifact_inventory(spark, str(tmp_path), "*.bin").collect()}
    assert rows == {"small.bin": (3, hashlib.sha256(b"abc").hexdigest()), "large.bin": ((1 << 31) + 100, digest.hexdigest())}


def merge_input(spark, n=20):
    rows = spark.range(n).selectExpr("id % 2 as worker_id", "id div 2 as part_index", "id as cell_index", "id % 3 as label",
                                     "array(cast(id as float) - 9.5f, 1f, -1f) as v")
    parts = [rows.where(F.col("worker_id") == w).select("worker_id", "part_index", "v") for w in (0, 1)]
    return parts, rows.drop("v")


def test_merge_is_complete(spark):
    parts, plan = merge_input(spark)
    table, stats = sinks.merge_parts(parts, plan, "v", ["label"])
    assert sorted((r.cell_index, r.v[0]) for r in table.collect()) == [(i, i - 9.5) for i in range(20)]
    assert {r.label: r.rows for r in stats.collect()} == {0: 7, 1: 7, 2: 6}


@pytest.mark.parametrize("spoilt,match", [
    (lambda p, q: ([p[0], p[1].where("part_index <> 3")], q), "1 planned rows without a part row"),
    (lambda p, q: ([p[0], p[1].union(p[1].limit(1))], q), "1 places that parts fill twice"),
    (lambda p, q: (p, q.where("cell_index <> 4")), "1 part rows that are not in the plan"),
    (lambda p, q: (p, q.withColumn("cell_index", F.when(F.col("cell_index") != 4, F.col("cell_index")).otherwise(5))), "planned twice"),
    (lambda p, q: ([p[0], p[1].withColumn("v", F.when(F.col("part_index") == 0, F.array(F.lit(float("nan")).cast("float"), F.lit(1.0).cast("float"),
                                                                                  F.lit(-1.0).cast("float"))).otherwise(F.col("v")))], q), "non-finite"),
    (lambda p, q: ([x.withColumn("v", F.transform("v", F.abs)) for x in p], q), "one sign")])
def test_faulty_merges_are_refused_by_name(spark, spoilt, match):
    parts, plan = spoilt(*merge_input(spark))
    with pytest.raises(ValueError, match=match):
        sinks.merge_parts(parts, plan, "v", ["label"])


def test_rows_meet_the_groups_of_their_stretch_only(spark):
    """No list of all groups of a file travels with its rows; groups of uneven length, one of them far longer than the mean."""
    groups = [("f", 0, 0, 1), ("f", 1, 1, 1), ("f", 2, 2, 900), ("f", 3, 902, 0), ("f", 4, 902, 3), ("g", 0, 0, 5)]
    table = spark.createDataFrame([(*g, 0) for g in groups], footers.FOOTER)
    rows = spark.createDataFrame([("f", i) for i in range(905)] + [("g", i) for i in range(5)], "shard string, row long")
    placed = footers.with_row_groups(rows, table)
    assert placed.columns == ["shard", "row", "row_group", "row_in_group"]
    assert "collect_list" not in placed._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.shard, r.row): (r.row_group, r.row_in_group) for r in placed.collect()}
    first = {(s, g): (at, n) for s, g, at, n in groups}
    assert len(found) == 910 and all(first[s, g][0] + i == row and i < first[s, g][1] for (s, row), (g, i) in found.items())
    for lost in (("f", 905), ("g", 5), ("h", 0), ("f", -1), ("f", None)):
        with pytest.raises(Exception, match="no such row"):
            footers.with_row_groups(spark.createDataFrame([lost], "shard string, row long"), table).collect()
