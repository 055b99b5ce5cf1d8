import pytest
from pyspark.sql import functions as F

from cellset.sources import scans, sinks
from cellset.streaming import ingest as X


def shards(spark, folder, lo, hi):
    spark.range(lo, hi).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("g"), (F.col("id") / 7).alias("value")) \
        .coalesce(1).write.mode("append").parquet(folder)


def test_second_run_takes_only_new_files(spark):
    source, sink, check = (sinks.new_folder(spark) for _ in range(3))
    shards(spark, source, 0, 100)
    schema = spark.read.parquet(source).schema
    X.ingest(spark, source, schema, sink, check)
    shards(spark, source, 100, 150)
    X.ingest(spark, source, schema, sink, check)
    got = spark.read.parquet(sink)
    assert got.count() == 150 and got.select("event_id").distinct().count() == 150


def test_keys_arrive_once_across_runs(spark):
    source, sink, check = (sinks.new_folder(spark) for _ in range(3))
    shards(spark, source, 0, 60)
    schema = spark.read.parquet(source).schema
    X.ingest_once(spark, source, schema, sink, check, "event_id", 1)
    shards(spark, source, 40, 90)
    X.ingest_once(spark, source, schema, sink, check, "event_id", 1)
    assert sorted(r.event_id for r in spark.read.parquet(sink).collect()) == list(range(90))


def test_a_batch_run_again_replaces_itself(spark):
    sink = sinks.new_folder(spark)
    df = spark.range(10)
    X.write_batch(df, sink, 0)
    X.write_batch(df, sink, 0)
    assert spark.read.parquet(sink).count() == 10


def test_running_audit_in_complete_mode_equals_the_batch(spark):
    source = sinks.new_folder(spark)
    for lo in (0, 100, 200):
        shards(spark, source, lo, lo + 100)
    schema = spark.read.parquet(source).schema
    query = (X.running_audit(spark, source, schema, ["g"], "value", 1).writeStream.format("memory").queryName("audit")
             .outputMode("complete").option("checkpointLocation", sinks.new_folder(spark)).trigger(availableNow=True).start())
    query.awaitTermination()
    merged = X.stream_audit(spark, source, schema, sinks.new_folder(spark), sinks.new_folder(spark), ["g"], "value", 1)
    one = {r.g: r for r in spark.table("audit").collect()}
    for r in merged.collect():
        assert r["count"] == one[r.g]["count"] == 100
        assert abs(r["mean"] - one[r.g]["mean"]) < 1e-9 and abs(r["std"] - one[r.g]["std"]) < 1e-9


def test_state_of_other_inputs_is_refused(spark):
    import pytest
    source, sink, check = (sinks.new_folder(spark) for _ in range(3))
    rows = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0)], "cell_id long, gene_index long, count double")
    rows.coalesce(1).write.parquet(source)
    X.incremental_gene_stats(spark, source, rows.schema, sink, check, "a").collect()
    with pytest.raises(Exception, match="belongs to"):
        X.incremental_gene_stats(spark, source, rows.schema, sink, check, "b").collect()


def test_locator_round_trip(spark):
    folder = sinks.new_folder(spark)
    spark.range(500).repartition(4).write.parquet(folder)
    located = scans.with_locator(spark.read.parquet(folder))
    plan = located.where("id < 50").select("shard", "row")
    assert sorted(r.id for r in scans.scan_by_locator(spark, folder, plan).collect()) == list(range(50))
    assert located.select("shard", "row").distinct().count() == 500


def test_csv_keeps_empty_text_and_a_byte_order_mark(spark, tmp_path):
    from pyspark.sql import types as T
    path = tmp_path / "index.csv"
    path.write_text("﻿name,note,n\na,,1\nNA,x,2\n", encoding="utf-8")
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("note", T.StringType()),
                           T.StructField("n", T.LongType())])
    rows = scans.scan_index_csv(spark, str(path), schema).orderBy("n").collect()
    assert [(r.name, r.note) for r in rows] == [("a", ""), ("NA", "x")]


def test_wrong_vector_width_fails(spark):
    import pytest
    folder = sinks.new_folder(spark)
    spark.createDataFrame([([1.0, 2.0],)], "v array<double>").write.parquet(folder)
    with pytest.raises(Exception, match="vector width"):
        scans.scan_vectors(spark, folder, "v", 3).collect()


def test_sink_refuses_other_checkpoints_and_inputs(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).selectExpr("id as cell_id", "id % 3 as gene_index", "1.0 as count").write.parquet(source)
    schema = spark.read.parquet(source).schema
    first = X.incremental_gene_stats(spark, source, schema, sink, str(tmp_path / "check"), "a").collect()
    before = spark.read.parquet(sink).count()
    for check, inputs in (("check", "b"), ("other", "a")):
        with pytest.raises(ValueError, match="belongs to"):
            X.incremental_gene_stats(spark, source, schema, sink, str(tmp_path / check), inputs)
    assert spark.read.parquet(sink).count() == before
    again = X.incremental_gene_stats(spark, source, schema, sink, str(tmp_path / "check"), "a").collect()
    assert sorted(again) == sorted(first)


def test_once_reads_neither_the_sink_nor_earlier_batches(spark):
    """Fifty batches over the same keys: each looks up its own rows, though all that earlier batches wrote is gone."""
    import glob
    import os
    source, sink, check = (sinks.new_folder(spark) for _ in range(3))
    for i in range(50):
        shards(spark, source, i, i + 20)
    schema = spark.read.parquet(source).schema
    query = X.ingest_once(spark, source, schema, sink, check, "event_id", 2)
    assert sorted(r.event_id for r in spark.read.parquet(sink).collect()) == list(range(69))
    assert {p["numInputRows"] for p in query.recentProgress if p["numInputRows"]} == {40}
    for path in glob.glob(f"{sink.removeprefix('file:')}/batch_id=*/*.parquet"):
        os.remove(path)
    shards(spark, source, 60, 75)
    X.ingest_once(spark, source, schema, sink, check, "event_id", 2)
    assert sorted(r.event_id for r in spark.read.schema(schema).parquet(sink).collect()) == list(range(69, 75))


def test_a_run_stops_at_its_row_budget(spark):
    source, sink, check = (sinks.new_folder(spark) for _ in range(3))
    for lo in (0, 40, 80):
        shards(spark, source, lo, lo + 40)
    schema = spark.read.parquet(source).schema
    seen = []
    for _ in range(6):
        done = X.ingest(spark, source, schema, sink, check, 1, max_rows=25)
        ids = [r.event_id for r in spark.read.parquet(sink).collect()]
        assert len(ids) == len(set(ids))
        seen.append(len(ids))
        if done is not None:
            break
    assert seen == [25, 50, 75, 100, 120] and sorted(ids) == list(range(120))
    with pytest.raises(ValueError):
        X.ingest(spark, source, schema, sink, check, 1, lambda df: df, max_rows=5)


def test_a_cell_in_two_shards_fails(spark):
    source, sink, check = (sinks.new_folder(spark) for _ in range(3))
    kinds = "cell_id long, gene_index long, count double"
    spark.createDataFrame([(1, 0, 2.0), (2, 0, 3.0)], kinds).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    X.incremental_gene_stats(spark, source, schema, sink, check, "a").collect()
    spark.createDataFrame([(3, 0, 2.0), (1, 1, 3.0)], kinds).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(ValueError, match="more than one shard: 1$"):
        X.incremental_gene_stats(spark, source, schema, sink, check, "a")
