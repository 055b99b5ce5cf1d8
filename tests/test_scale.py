"""Hot keys: one key holds a third of the rows and nothing is dropped or gathered."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellset.operators import scale as S
from cellset.operators import windows as W
from cellset.operators.joins import expand_ranges, range_join, unique_side


@pytest.fixture(scope="module")
def hot(spark):
    rows = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("key"),
        (F.pmod(F.xxhash64("id"), F.lit(200)) / 4.0).alias("v"))
    return rows.cache()


def test_dense_index_is_contiguous_and_ordered(hot):
    got = S.dense_index(hot, ["key", "v", "id"], "i").toPandas().sort_values("i")
    assert got["i"].tolist() == list(range(9000))
    want = hot.toPandas().sort_values(["key", "v", "id"])["id"].tolist()
    assert got["id"].tolist() == want


def test_running_total_and_place(hot):
    got = S.running_total(hot, ["key"], ["v", "id"], F.col("v"), "run").toPandas()
    want = hot.toPandas().sort_values(["key", "v", "id"])
    want["run"] = want.groupby("key")["v"].cumsum()
    merged = got.merge(want, on="id")
    assert np.allclose(merged["run_x"], merged["run_y"])
    place = S.place_in_group(hot, ["key"], ["v", "id"], "place").toPandas().merge(
        want.assign(n=want.groupby("key").cumcount()), on="id")
    assert (place["place"] == place["n"]).all()


def test_previous_value_crosses_ranges(hot):
    got = S.with_previous(hot, ["id"], "id", "before").toPandas().sort_values("id")
    assert got["before"].isna().sum() == 1
    assert (got["before"].dropna().astype(int).to_numpy() == got["id"].to_numpy()[:-1]).all()


def test_top_per_group_keeps_exactly_the_first(hot):
    got = S.top_per_group(hot, ["key"], [F.col("v"), F.col("id")], 40, F.col("id")).toPandas()
    want = hot.toPandas().sort_values(["key", "v", "id"]).groupby("key").head(40)
    assert set(got["id"]) == set(want["id"])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 101, 9000])
def test_exact_quantiles(hot, n):
    rows = hot.where(F.col("id") < n)
    got = {r.prob: r.quantile for r in S.exact_quantiles(rows, [], "v", [0.05, 0.5, 0.95]).collect()}
    values = rows.toPandas()["v"]
    for p in (0.05, 0.5, 0.95):
        assert got[p] == pytest.approx(np.quantile(values, p)), p


def test_exact_quantiles_by_hot_key_with_coarse_sketch(hot):
    got = S.exact_quantiles(hot, ["key"], "v", [0.25, 0.5], accuracy=50).toPandas()
    frame = hot.toPandas()
    for row in got.itertuples():
        assert row.quantile == pytest.approx(np.quantile(frame.loc[frame["key"] == row.key, "v"], row.prob))
    assert len(got) == 2 * frame["key"].nunique()


def test_average_rank(hot):
    got = W.avg_rank(hot, ["key"], "v").toPandas()
    frame = hot.toPandas()
    frame["want"] = frame.groupby("key")["v"].rank()
    merged = got.merge(frame[["id", "want"]], on="id")
    assert np.allclose(merged["rank"], merged["want"]) and len(merged) == 9000


def test_ranges_expand_and_join_alike(spark):
    ranges = spark.createDataFrame([("hot", 0, 5000), ("b", 5000, 5003), ("empty", 5003, 5003), ("c", 5003, 5100)],
                                   "owner string, start long, stop long")
    cells = expand_ranges(ranges, ["owner"], chunk=64)
    assert cells.count() == 5100
    joined = range_join(cells.select("cell_index"), ranges, grid=128).join(
        cells.withColumnRenamed("owner", "want"), "cell_index")
    assert joined.count() == 5100 and joined.where("owner <> want").count() == 0


def test_unique_side_fails_on_a_repeated_key(spark):
    rows = spark.createDataFrame([(1, 2), (1, 3)], "k long, v long")
    with pytest.raises(Exception, match="not unique"):
        unique_side(rows, ["k"]).collect()


def test_ragged_cleaning_does_not_shuffle(spark, small):
    """Vocabulary lookup, validation and collapse stay in the scan's own stage (the small input is spread first)."""
    from cellset.operators import clean
    stored = small.ragged.select("cell_id", "genes", "expressions")
    table = clean.collapse_entries(clean.cleaned(stored, small.genes))
    plan = table._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "SortMergeJoin" not in plan and "Window" not in plan
    assert main.count("Exchange hashpartitioning") == 0
