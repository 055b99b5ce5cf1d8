"""No join loses rows without a word: each operator with one row that has no partner."""

import pytest
from pyspark.sql import functions as F

from cellset.operators import clean
from cellset.operators import joins as J
from cellset.operators.aggregates import global_stats


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_lookup_strict_fails_even_if_the_value_is_not_read(spark):
    with pytest.raises(Exception, match="no v for k"):
        J.lookup_strict(frame(spark, [(1,), (2,)], "k int"), frame(spark, [(1, 5)], "k int, v int"), "k", "v").select("k").collect()


def test_condition_without_pool_is_reported(spark):
    out = J.attach_controls(frame(spark, [("a", "x", None), ("b", "y", None)], "control_pool_id string, line string, plate string"),
                            frame(spark, [("a", 3, "x", None)], "control_pool_id string, control_cells int, line string, plate string"),
                            ["line", "plate"]).orderBy("control_pool_id").collect()
    assert [(r.pool_found, r.line_agrees, r.plate_agrees) for r in out] == [(True, True, True), (False, False, False)]


def test_differences_count_lonely_keys(spark):
    a, b = frame(spark, [(1, 1.0), (2, 2.0)], "k int, v double"), frame(spark, [(1, 1.5), (3, 9.0)], "k int, v double")
    assert J.diff_results(a, b, ["k"], ["v"]).first().asDict() == {"rows": 1, "only_first": 1, "only_second": 1, "max_abs_v": 0.5}


def test_unplaced_plan_rows_stay(spark):
    plan = frame(spark, [(5, 0, "a"), (99, 0, "a"), (6, 0, "z"), (7, 1, "p"), (8, 1, "p")], "source_index long, owner_type int, owner_id string")
    ranges = frame(spark, [("a", 0, 10, 100)], "owner_id string, old_start long, old_stop long, new_start long")
    out = J.reindex_plan(plan, ranges, frame(spark, [(7, 1)], "source_index long, new_index long")).collect()
    assert {r.source_index: r.new_index for r in out} == {5: 105, 99: None, 6: None, 7: 1, 8: None}


def test_unknown_owner_is_reported(spark):
    cells = frame(spark, [(1, "a", "d", "s1"), (2, "z", "d", "s1")], "cell_id long, owner_id string, drug string, sample_id string")
    owners = frame(spark, [("a", "s1|s2", "d")], "owner_id string, samples string, drug string")
    assert [(r.cell_id, r.owner_known) for r in J.verify_owner(cells, owners, ["drug"]).collect()] == [(2, False)]


def test_members_and_targets_without_vectors_stay(spark):
    sets = frame(spark, [(1,), (2,)], "cell_index long")
    vectors = frame(spark, [(1, [1.0])], "cell_index long, v array<double>")
    assert {r.cell_index: r.v for r in J.gather(sets, vectors).collect()} == {1: [1.0], 2: None}
    plan = frame(spark, [(1, "val"), (2, "val")], "cell_index long, split string")
    out = J.paired_cells(plan, vectors.withColumnRenamed("v", "latent"), vectors.withColumnRenamed("v", "target"), "val").collect()
    assert {r.cell_index: r.complete for r in out} == {1: True, 2: False}
    moved = clean.condition_vectors(frame(spark, [("d", [1.0]), ("e", [1.0])], "drug string, v array<double>"),
                                    frame(spark, [("d", [2.0], 0.5)], "drug string, drug_vec array<double>, dose double"), "drug", "v", "m").collect()
    assert {r.drug: r.m for r in moved} == {"d": [2.0], "e": None}


def test_branches_and_parity_see_missing_rows(spark):
    a = frame(spark, [(1, 0.5, "x"), (2, 0.5, "x")], "k int, s double, digest string")
    out = J.align_branches(a, a.where("k = 1"), ["k"], "s").collect()
    assert {r.k: r.same_members for r in out} == {1: True, 2: False}
    v = frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], "k int, v array<double>")
    limits = {"max_abs": 1.0, "mean_abs": 1.0, "max_relative_l2": 1.0, "min_cosine": 0.0}
    row = J.parity(v, v.where("k = 1"), "k", "v", 1e-5, 1e-6, limits).first()
    assert (row.rows, row.missing, row.consistent) == (1, 1, False)
    assert J.parity(v, v, "k", "v", 1e-5, 1e-6, limits).first().consistent


def test_wide_tokens_are_unmapped_and_negatives_reported(spark):
    cells = frame(spark, [(1, [3_000_000_000, 7], [1.0, 2.5]), (2, [7], [-1.0]), (3, [], []), (4, [7, 7], [2.0, -3.0])],
                  "cell_id long, genes array<long>, expressions array<float>")
    vocab = frame(spark, [(7, 0)], "token_id long, gene_index long")
    audit = {r.cell_id: r for r in clean.cell_audit(cells, vocab).collect()}
    assert (audit[1].mapped_entries, audit[1].unmapped_entries, audit[1].non_integer_entries) == (1, 1, 1)
    unmapped = clean.cell_audit(cells.withColumn("expressions", F.expr("transform(expressions, (x, i) -> cast(if(i = 0, 1.5, 2.0) as float))")), vocab)
    assert {r.cell_id: r.non_integer_entries for r in unmapped.collect()}[1] == 0
    stats = global_stats(cells).first()
    assert (stats["count"], stats.negative_values) == (3, 1)
    assert global_stats(cells, limit=2).first()["count"] == 2
