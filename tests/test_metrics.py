import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellset.functions import vectors as V
from cellset.operators import aggregates as A
from cellset.operators import metrics as M
from cellset.operators import quality as Q
from cellset.operators import tiles
from cellset.operators.windows import average_precision


def metric_rows(spark, *rows):
    return spark.createDataFrame([(i, p, t, y) for i, (p, t, y) in enumerate(rows)],
                                 "k long, p array<double>, t array<double>, y array<int>")


def test_undefined_metrics_stay_undefined(spark):
    rows = metric_rows(spark, ([1.0, 1.0], [1.0, 2.0], [0, 0]), ([1.0, 2.0], [1.0, 2.0], [1, 1]),
                       ([0.5, -2.0, 1.0], [1.0, 2.0, 0.0], [0, 1, 0]))
    out = {r.k: r for r in M.condition_metrics(rows, ["k"], "p", "t", "y").collect()}
    assert out[0].pearson_delta is None and out[0].spearman_delta is None
    assert out[0].set_level_des is None and out[0].auprc is None and out[0].auprc_reason != ""
    assert out[1].set_level_des == 1.0 and out[1].auprc is None
    assert out[2].set_level_des == 1.0 and out[2].auprc == 1.0 and out[2].auprc_reason == ""


def test_undefined_rows_are_counted_and_listed_with_a_reason(spark):
    rows = spark.createDataFrame([(0, 1, None, 0), (0, 2, float("nan"), 3), (0, 3, 0.5, 2)],
                                 "r long, c long, auprc double, true_deg_count long")
    out = M.rollup_with_undefined(rows, "auprc", ["r"]).first()
    assert (out["mean"], out.valid_n, out.undefined_n, out.unexpected_undefined_n) == (0.5, 1, 2, 1)
    assert {r.c: r.reason for r in M.excluded_rows(rows, "auprc").collect()} == {1: "no_true_genes", 2: "unexpected"}


def test_average_precision_with_ties(spark):
    rows = spark.createDataFrame([(1, .9, 1), (1, .5, 0), (1, .5, 1)], "k long, score double, label int")
    assert average_precision(rows, ["k"]).first().auprc == pytest.approx(0.5 + 0.5 * 2 / 3)


def frame(spark, rng, n, groups=2, dim=5):
    rows = [(int(i), int(i % groups), [float(x) for x in rng.normal(size=dim)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g long, v array<double>"), rows


def test_energy_distance_with_many_blocks_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 4)
    monkeypatch.setattr(tiles.blocks, "__defaults__", (4,))
    rng = np.random.default_rng(0)
    a, ra = frame(spark, rng, 41)
    b, rb = frame(spark, rng, 30)
    got = {r.g: r.energy_distance for r in M.energy_distance(a, b, ["g"], "id", "v", 5).collect()}
    dist = lambda x, y: np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1)).mean()
    for g in (0, 1):
        x, y = (np.array([r[2] for r in rows if r[1] == g]) for rows in (ra, rb))
        assert got[g] == pytest.approx(dist(x, y) - dist(x, x) / 2 - dist(y, y) / 2, abs=1e-7)


@pytest.mark.parametrize("n", [2, 3, 60, 61])
def test_pairwise_median_is_exact(spark, n, monkeypatch):
    monkeypatch.setattr(tiles.blocks, "__defaults__", (8,))
    table, rows = frame(spark, np.random.default_rng(n), n, groups=1)
    got = M.pairwise_structure(table, ["g"], "id", "v", 5, ("euclidean",)).first()
    x = np.array([r[2] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))[np.triu_indices(n, 1)]
    assert got.pairs == len(d)
    assert got.median == pytest.approx(np.median(d), abs=1e-9)
    assert got["std"] == pytest.approx(d.std(), abs=1e-7)


def test_context_ranks_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, i % 2, [float(x) for x in rng.normal(size=4)], [float(x) for x in rng.normal(size=4)])
                                  for i in range(30)], "id long, c long, p array<double>, t array<double>")
    one = M.context_ranks(rows, ["c"], "id", "p", "t").toPandas().set_index("id")["rank"]
    many = M.context_ranks(rows, ["c"], "id", "p", "t", block=3).toPandas().set_index("id")["rank"]
    assert one.sort_index().equals(many.sort_index())
    frame_ = rows.toPandas()
    for r in frame_.itertuples():
        others = frame_[frame_["c"] == r.c]
        d = others["t"].map(lambda t, p=r.p: np.abs(np.array(p) - np.array(t)).sum())
        own = np.abs(np.array(r.p) - np.array(r.t)).sum()
        assert one[r.id] == (d < own - 1e-12).sum()


def test_context_of_one_condition_gives_no_row(spark):
    rows = spark.createDataFrame([(1, 1, [1.0], [1.0])], "id long, c long, p array<double>, t array<double>")
    assert M.context_pds(rows, ["c"], "id", "p", "t").count() == 0


def test_shared_controls_give_the_same_mann_whitney_as_ranking_each_comparison(spark):
    rng = np.random.default_rng(5)
    rows = [("p", int(c), 0, float(v)) for c in (0, 1, 2) for v in rng.integers(0, 6, size=12 + c)]
    table = spark.createDataFrame(rows, "pool string, cond long, gene long, v double")
    got = {r.cond: r for r in M.de_scores(table, "cond", "pool", "gene", "v", F.col("cond") == 0).collect()}
    frame_ = pd.DataFrame(rows, columns=["pool", "cond", "gene", "v"])
    for c in (1, 2):
        both = frame_[frame_["cond"].isin([0, c])].assign(r=lambda d: d["v"].rank())
        n1 = (both["cond"] == c).sum()
        assert got[c].u == pytest.approx(both.loc[both["cond"] == c, "r"].sum() - n1 * (n1 + 1) / 2)


def test_normal_tail(spark):
    rows = spark.createDataFrame([(0.0,), (1.96,), (-1.96,)], "z double").select(M.two_sided_p(F.col("z")).alias("p"))
    assert [round(r.p, 6) for r in rows.collect()] == [1.0, round(math.erfc(1.96 / math.sqrt(2)), 6)] + [
        round(math.erfc(1.96 / math.sqrt(2)), 6)]


def raw(spark, *rows):
    return spark.createDataFrame([(f"{p}@{d}", "e", "l", "x", d, p, v) for p, d, v in rows],
                                 "condition_id string, edge_id string, cell_line_id string, drug string, dose_um double, "
                                 "plate string, m double")


@pytest.mark.parametrize("rows,replicates", [
    ([("plate6", 5.0, 1.0), ("plate14", 5.0, 3.0), ("plate2", 5.0, 8.0)], 2),
    ([("plate6", 0.5, 1.0), ("plate14", 0.5, 3.0)], 2), ([("plate6", 5.0, 1.0)], 1)])
def test_plates_merge_only_at_the_fixed_dose(spark, rows, replicates):
    edge = A.hierarchical_mean(raw(spark, *rows), "m")["edge"].first()
    assert edge.replicates == replicates and edge.plate_conditions == len(rows)


def test_single_repeat_has_zero_spread(spark):
    rows = spark.createDataFrame([("b", 0, 1.0), ("b", 0, 3.0)], "branch string, repeat_epoch long, m double")
    summary = A.summarize_branch(rows, ["m"])[1].first()
    assert summary["std"] == 0.0 and summary["mean"] == 2.0


def test_wide_vectors_are_averaged_in_chunks(spark):
    rows = [(i % 2, [float(i * j) for j in range(150)]) for i in range(6)]
    table = spark.createDataFrame(rows, "g long, v array<double>")
    wide = {r.g: r["mean"] for r in V.mean_vectors(table, ["g"], "v", 150).collect()}
    for g in (0, 1):
        assert wide[g] == pytest.approx(np.mean([r[1] for r in rows if r[0] == g], axis=0))


def test_failed_gate_is_reported_and_strict_fails(spark):
    rows = spark.createDataFrame([(0,), (2,)], "k long")
    assert not Q.run_checks([Q.contiguous_index(rows, "k", "c")]).first().passed
    with pytest.raises(Exception, match="check failed: c"):
        Q.run_checks([Q.contiguous_index(rows, "k", "c")], strict=True).collect()


def test_normal_tail_equals_erfc(spark):
    import math

    from cellset.operators.metrics import two_sided_p
    zs = [0.0, 1e-9, 0.3, -1.96, 3.999999, 4.0, 5.5, 8.0, -12.0, 37.0]
    rows = spark.createDataFrame([(z,) for z in [*zs, None, float("nan")]], "z double").select("z", two_sided_p(F.col("z")).alias("p")).collect()
    for r in rows:
        if r.z is None or r.z != r.z:
            assert r.p is None
        else:
            assert math.isclose(r.p, math.erfc(abs(r.z) / math.sqrt(2)), rel_tol=1e-9, abs_tol=1e-15)


def test_means_and_deltas_at_any_width(spark):
    import numpy as np

    from cellset.functions.vectors import mean_vectors, pearson
    from cellset.operators.aggregates import set_delta
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 768)).round(3)
    table = spark.createDataFrame([(i % 2, f"c{i % 3}", "p", v.tolist()) for i, v in enumerate(x)],
                                  "owner_type int, pair_id string, control_pool_id string, v array<double>")
    control = x[1::2].mean(0)
    for r in set_delta(table, "v", 768).collect():
        own = x[[i for i in range(0, 40, 2) if f"c{i % 3}" == r.pair_id]]
        assert r.treated_cells == len(own) and r.control_cells == 20 and np.allclose(r.delta, own.mean(0) - control)
    some = mean_vectors(table, ["control_pool_id"], "v", 768, weight=F.col("owner_type") == 1, extra={"n": F.count("*")}).first()
    assert some.n == 40 and np.allclose(some["mean"], control)
    pair = spark.createDataFrame([(x[0].tolist(), x[1].tolist())], "a array<double>, b array<double>").select(pearson(F.col("a"), F.col("b")).alias("r")).first()
    assert np.isclose(pair.r, np.corrcoef(x[0], x[1])[0, 1])


def drawn(spark, rows):
    return spark.createDataFrame(rows, "pair_id string, epoch int, side string, cell_index long")


def test_drawn_plan_takes_own_control_and_refuses_faults(spark):
    from cellset.plans import evaluation as E
    rows = [(p, e, side, base + more + e * 10 + i) for p, base in (("p", 0), ("q", 100)) for e in (0, 1)
            for side, more in (("control", 0), ("treated", 1000)) for i in (2, 0, 1)]
    vectors = spark.range(3000).selectExpr("id as cell_index", "array(cast(id as double), 1.0D) as v")
    names = spark.createDataFrame([("p", "e1"), ("q", "e2")], "pair_id string, edge_id string")
    plan = lambda sets, v=vectors, c=names: E.drawn_plan(sets, v, c, 3, "v", 2, ["edge_id"])
    got = plan(drawn(spark, rows)).orderBy("row_index").collect()
    assert [(r.row_index, r.repeat_epoch, r.pair_id, r.edge_id) for r in got] == [
        (0, 0, "p", "e1"), (1, 0, "q", "e2"), (2, 1, "p", "e1"), (3, 1, "q", "e2")]
    assert got[3].control == [110, 111, 112] and got[3].treated == [1110, 1111, 1112] and got[3].true_delta == [1000.0, 0.0]
    for sets, v, c, what in [
            (rows[:-1], vectors, names, "treated set without 3 members"), ([*rows[1:], rows[1]], vectors, names, "without 3 members"),
            ([r for r in rows if r[2] == "treated"], vectors, names, "control set without"), (rows, vectors.where("cell_index <> 111"), names, "finite vector"),
            (rows, vectors, names.where("pair_id = 'p'"), "unknown condition")]:
        with pytest.raises(Exception, match=what):
            plan(drawn(spark, sets), v, c).collect()


def test_candidates_without_defined_pearson_fail(spark):
    rows = spark.createDataFrame([([1.0, 1.0], [1.0, 2.0], [2.0, 1.0])], "t array<double>, a array<double>, b array<double>")
    with pytest.raises(Exception, match="no row has a defined Pearson"):
        M.select_candidate(rows, ["a", "b"], "t").collect()


def test_ambiguous_replicates_fail(spark):
    from cellset.operators import aggregates as A
    kinds = "condition_id string, edge_id string, cell_line_id string, drug string, dose_um double, plate string, repeat_epoch int, energy double"
    rows = [(f"c{i}", "e", "l", "d", 5.0, p, 0, float(i)) for i, p in enumerate(["plate6", "plate14", "plate2"])]
    level = A.hierarchical_mean(spark.createDataFrame(rows, kinds), "energy")
    assert {(r.replicate_id, r.energy) for r in level["replicate"].collect()} == {("plate6|plate14", 0.5), ("c2", 2.0)}
    with pytest.raises(Exception, match="ambiguous replicate of e"):
        A.hierarchical_mean(spark.createDataFrame([*rows, ("c9", "e", "l", "d", 5.0, "plate6", 0, 1.0)], kinds), "energy")["edge"].collect()


def test_signs_are_judged_over_the_whole_table(spark):
    from cellset.operators import infer
    import numpy as np
    cells = spark.range(6).selectExpr("id as cell_id", "array(named_struct('gene', id, 'count', if(id < 3, -1.0D, 1.0D))) as entries").repartition(6)
    each = lambda genes, counts, offsets: np.asarray(counts)[:, None]
    assert infer.infer_cells(cells, each, batch=1, signed=True).count() == 6
    with pytest.raises(ValueError, match="one sign"):
        infer.infer_cells(cells.where("cell_id < 3"), each, batch=1, signed=True)


def test_vectors_are_sent_as_often_however_large_their_group_is(spark):
    rows = spark.range(6000).selectExpr("id % 2 as g", "id", "array(cast(id as float), cast(1 as float)) as v").where("g = 0 or id < 600")
    packed = tiles.blocks(rows, ["g"], "id", "v")
    assert {r.g: r.blocks for r in packed.select("g", "blocks").distinct().collect()} == {0: tiles.GRID, 1: 2}
    assert packed.schema["flat"].dataType.simpleString() == "array<float>"
    both = tiles.pair_moments(tiles.block_pairs(packed, packed, ["g"], triangle=True), ["g"], 2, triangle=True)
    assert {r.g: (r.pairs, r.min, r.max) for r in both.collect()} == {0: (3000 * 2999 // 2, 2.0, 5998.0), 1: (300 * 299 // 2, 2.0, 598.0)}
