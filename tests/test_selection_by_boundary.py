"""Boundaries, carried values, owners of ranges, order as stored, and pair structure at any size."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellset import session
from cellset.operators import aggregates as A
from cellset.operators import metrics as M
from cellset.operators import scale, tiles
from cellset.operators.joins import owner_join, range_join
from cellset.operators.windows import cap_rows
from cellset.sources import scans, sinks


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-2**63, 2**63 - 1), st.integers(0, 3)), st.sampled_from([None, "a", "b", "c"])),
                min_size=1, max_size=25), st.integers(0, 27))
def test_first_in_order_property(spark, rows, n):
    table = spark.createDataFrame(rows, "k long, s string").repartition(3)
    rank = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    text = lambda r: ((r[1] is not None, r[1] or ""), (r[0] is not None, r[0] or 0))
    assert sorted(map(tuple, scale.first_in_order(table, ["k", "s"], n).collect()), key=rank) == sorted(rows, key=rank)[:n]
    assert sorted(map(tuple, scale.first_in_order(table, ["s", "k"], n).collect()), key=text) == sorted(rows, key=text)[:n]


def test_first_in_order_moves_no_rows(spark, monkeypatch):
    monkeypatch.setattr(scale, "placed", None)  # neither sorted nor written
    table = spark.range(100_000).selectExpr("pmod(xxhash64(id), 1000003) as k", "id", "repeat('x', 50) as payload")
    got = scale.first_in_order(table, ["k", "id"], 777)
    want = sorted((r.k, r.id) for r in table.select("k", "id").collect())[:777]
    assert sorted((r.k, r.id) for r in got.select("k", "id").collect()) == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_total_cap_with_a_shard_name(spark):
    rows = [(f"s{i % 3}", i % 2, i) for i in range(300)]
    table = spark.createDataFrame(rows, "shard string, block long, row long")
    got = sorted(map(tuple, cap_rows(table, ["shard", "row"], total=130).collect()), key=lambda r: (r[0], r[2]))
    assert got == sorted(rows, key=lambda r: (r[0], r[2]))[:130]


def test_a_million_ranges_of_one_cell(spark):
    n = 1_000_000
    ranges = spark.range(n).selectExpr("id * 2 as start", "id * 2 + 1 as stop", "id as owner")
    cells = spark.range(0, 2 * n, 7).withColumnRenamed("id", "cell_index")
    row = owner_join(cells, ranges).agg(F.count("*").alias("n"), F.sum("owner").alias("s"), F.count_if(F.col("start") != F.col("cell_index"))).first()
    want = [x // 2 for x in range(0, 2 * n, 14)]
    assert tuple(row) == (len(want), sum(want), 0)


def test_owners_of_long_and_empty_ranges(spark):
    ranges = spark.createDataFrame([("a", 0, 5), ("none", 5, 5), ("long", 5, 10**9), ("far", 2 * 10**9, 2 * 10**9 + 1)], "name string, start long, stop long")
    cells = spark.range(0, 3000).selectExpr("id * 1000000 as cell_index", "id % 2 as start_of").unionByName(
        spark.createDataFrame([(4, 9), (4, 9), (None, 1), (-3, 1), (2 * 10**9, 5)], "cell_index long, start_of long")).repartition(7)
    got = owner_join(cells, ranges)
    want = range_join(cells, ranges, grid=10**8)
    key = ["cell_index", "start_of", "name", "start", "stop"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    assert owner_join(cells.limit(0), ranges).count() == 0 and owner_join(cells, ranges.limit(0)).count() == 0
    with pytest.raises(Exception, match="ranges overlap"):
        owner_join(cells, ranges.unionByName(spark.createDataFrame([("b", 3, 6)], "name string, start long, stop long"))).collect()


def test_order_as_stored(spark):
    def stored(rows):
        folder = sinks.new_folder(spark)
        rows.write.option("parquet.block.row.count.limit", 50).parquet(folder)
        return A.stored_order(scans.with_locator(spark.read.parquet(folder)), "k").first()

    rising = spark.range(0, 1000, 1, 4).selectExpr("id div 3 as k")
    assert tuple(stored(rising)) == (1000, True)
    assert tuple(stored(rising.selectExpr("if(k = 100, 98L, k) as k"))) == (1000, False)
    assert tuple(stored(rising.selectExpr("-k as k"))) == (1000, False)
    assert tuple(stored(rising.selectExpr("concat('a', lpad(k, 4, '0')) as k"))) == (1000, True)
    assert tuple(stored(rising.limit(0))) == (0, True)
    with pytest.raises(Exception, match="undefined"):
        stored(rising.selectExpr("if(k = 3, cast(null as long), k) as k"))


def pair_rows(v):
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    return d[np.triu_indices(len(v), 1)]


def test_median_where_one_bin_holds_all_pairs(spark):
    """A far point puts all other distances into the first of 1,024 bins; a set of equal points has distance 0 only."""
    rng = np.random.default_rng(0)
    v = rng.normal(size=(401, 4))
    v[400] += 1e7
    rows = [("far", i, x.tolist()) for i, x in enumerate(v)] + [("equal", i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)] + [
        ("pair", 1, [0.0] * 4), ("pair", 2, [3.0, 4.0, 0.0, 0.0]), ("one", 1, [0.0] * 4)]
    out = M.pairwise_structure(spark.createDataFrame(rows, "g string, i long, v array<double>"), ["g"], "i", "v", 4, ("euclidean",)).collect()
    got = {r.g: r.median for r in out}
    assert got["equal"] == pytest.approx(0, abs=1e-6) and got["pair"] == 5 and "one" not in got or got.get("one") is None
    assert got["far"] == pytest.approx(np.median(pair_rows(v)), rel=1e-6)


def test_no_list_of_distances_leaves_a_task(spark):
    table = spark.createDataFrame([("a", i, [float(i), 1.0]) for i in range(20)], "g string, i long, v array<double>")
    packed = tiles.blocks(table, ["g"], "i", "v", block=8)
    pairs = tiles.block_pairs(packed, packed, ["g"], triangle=True)
    interval = {"target": F.array(F.lit(0)), "lo": F.array(F.lit(0.0)), "hi": F.array(F.lit(20.0))}
    out = tiles._reduce_pairs(pairs.withColumns(interval), ["g"], 2, "euclidean", "bins", True)
    assert "array" not in out.schema.simpleString()
    assert out.agg(F.sum("c")).first()[0] == 190


def test_structure_correlation_of_large_and_flat_sets(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 4, (700, 5)).astype(float)  # many equal distances
    rows = [("big", i, x[:3].tolist(), x[3:].tolist()) for i, x in enumerate(v)]
    rows += [(None, i, [float(i), 0.0, 0.0], [float(-i), 2.0]) for i in range(5)]
    rows += [("flat", i, [float(i), 0.0, 0.0], [1.0, 1.0]) for i in range(5)] + [("one", 1, [0.0] * 3, [0.0] * 2)]
    table = spark.createDataFrame(rows, "g string, i long, a array<double>, b array<double>")
    got = {r.g: r for r in M.structure_correlation(table, ["g"], "i", "a", "b").collect()}
    import pandas as pd
    x, y = pd.Series(pair_rows(v[:, :3])), pd.Series(pair_rows(v[:, 3:]))
    assert got["big"].pairs == len(x) and got["big"].pearson == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
    assert got["big"].spearman == pytest.approx(np.corrcoef(x.rank(), y.rank())[0, 1], abs=1e-9)
    assert got[None].pearson == pytest.approx(1) and got[None].spearman == pytest.approx(1)
    assert (got["flat"].pairs, got["flat"].pearson, got["flat"].spearman) == (10, None, None)
    assert (got["one"].pairs, got["one"].pearson) == (0, None)
    assert M.structure_correlation(table.limit(0), ["g"], "i", "a", "b").count() == 0


def test_structure_correlation_writes_no_pairs(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tiles, "HELD_PAIRS", 10_000)  # eight parts, counted against strips that end inside rows
    monkeypatch.setattr(tiles, "STRIP_PAIRS", 7_001)
    monkeypatch.setattr(tiles, "SENT", 3)  # tasks of three and of two parts
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(300, 5)), rng.integers(0, 3, (100, 5))])
    v[50:90] = v[10]  # copies: many pairs at distance 0, and equal distances from each other vector
    rows = [("x", i, r[:3].tolist(), r[3:].tolist()) for i, r in enumerate(v)]
    rows += [("x", None, [9.0] * 3, [9.0] * 2), ("twice", 7, [1.0] * 3, [2.0] * 2), ("twice", 7, [4.0] * 3, [1.0] * 2)]
    table = spark.createDataFrame(rows, "g string, i long, a array<float>, b array<double>")
    monkeypatch.setattr(session, "durable_dir", lambda spark: str(tmp_path))
    got = {r.g: r for r in M.structure_correlation(table, ["g"], "i", "a", "b").collect()}
    written = [spark.read.parquet(str(p)).count() for p in tmp_path.iterdir()]
    assert written and max(written) <= len(rows)
    import pandas as pd
    a = v[:, :3].astype(np.float32).astype(float)
    i, j = np.triu_indices(len(v), 1)
    x, y = [pd.Series(np.sqrt(sum((w[i, k] - w[j, k]) ** 2 for k in range(w.shape[1])))) for w in (a, v[:, 3:])]
    assert got["x"].pairs == len(x) == 79_800 and got["x"].pearson == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12)
    assert got["x"].spearman == pytest.approx(np.corrcoef(x.rank(), y.rank())[0, 1], abs=1e-12)
    assert (got["twice"].pairs, got["twice"].pearson, got["twice"].spearman) == (0, None, None)


def test_a_set_is_sent_to_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(tiles, "HELD_PAIRS", 100)
    monkeypatch.setattr(tiles, "SENT", 3)
    table = spark.createDataFrame([("a", i, [float(i % 7), float(i)]) for i in range(100)], "g string, i long, v array<double>")
    parts = tiles.triangle_parts(tiles.blocks(table, ["g"], "i", "v"), ["g"], 1, 2).withColumn("task", F.spark_partition_id())
    assert tuple(parts.agg(F.count("*"), F.sum("n"), F.count_distinct("task")).first()) == (50, 4950, 3)
