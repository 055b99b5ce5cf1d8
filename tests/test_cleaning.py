import pytest

from cellset.operators import aggregates as A
from cellset.operators import clean

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([(7, 0), (8, 1), (9, 2)], "token_id long, gene_index long")


def cells(spark, *rows):
    return spark.createDataFrame([(i, g, e) for i, (g, e) in enumerate(rows)],
                                 "cell_id long, genes array<long>, expressions array<float>")


@pytest.mark.parametrize("genes,expressions,reason", [
    (None, [1.0], "missing_list"), ([], [], "missing_list"), ([7], [-2.0], "empty_after_sentinel"),
    ([7, 8], [1.0, -1.0], "negative_count"), ([7, 8], [1.0], "length_mismatch"), ([7, 8], [1.0, NAN], "not_finite"),
    ([7, 8], [1.0, INF], "not_finite"), ([1, 2], [1.0, 2.0], "no_mapped_gene"), ([7, 8], [0.0, 0.0], "zero_library"),
    ([7, 8], [0.0, 3.0], None), ([5, 7], [-1.0, 3.0], None)])
def test_validation_reasons(spark, vocab, genes, expressions, reason):
    row = clean.validate_counts(cells(spark, (genes, expressions)), vocab).first()
    assert row.reason == reason


def test_strict_validation_fails_the_job(spark, vocab):
    with pytest.raises(Exception, match="negative_count"):
        clean.validate_counts(cells(spark, ([7, 8], [1.0, -1.0])), vocab, strict=True).collect()


def test_collapse_sums_duplicates_in_gene_order(spark, vocab):
    table = clean.cleaned(cells(spark, ([9, 7, 9, 8, 7], [1.0, 2.0, 3.0, 4.0, 5.0])), vocab)
    entries = clean.collapse_entries(table).first().entries
    assert [(e.gene, e["count"]) for e in entries] == [(0, 7.0), (1, 4.0), (2, 4.0)]


def test_collapse_of_a_cell_without_entries(spark, vocab):
    table = clean.map_tokens(cells(spark, ([1], [1.0])), vocab)
    assert clean.collapse_entries(table).first().entries == []


def test_wide_vocabulary_uses_the_join_and_agrees(spark, vocab, monkeypatch):
    rows = cells(spark, ([9, 7, 1, 8], [1.0, 2.0, 3.0, 4.0]), ([1], [1.0]))
    dense = clean.map_tokens(rows, vocab).orderBy("cell_id").collect()
    monkeypatch.setattr(clean, "LOOKUP_LIMIT", 1)
    joined = clean.map_tokens(rows, vocab).select(*rows.columns, "entries").orderBy("cell_id").collect()
    assert [r.entries for r in dense] == [r.entries for r in joined]


def test_gene_stats_count_absent_genes_as_zero(spark, vocab):
    table = clean.collapse_entries(clean.cleaned(cells(spark, ([7], [1.0]), ([8], [1.0])), vocab))
    stats = {r.gene_index: r for r in A.gene_stats(table).collect()}
    from math import log1p
    value = log1p(10000.0)
    assert stats[0].mean == pytest.approx(value / 2)
    assert stats[0].variance == pytest.approx(value * value / 4)
    assert stats[0].detection_rate == 0.5


def test_global_stats_need_two_values(spark):
    with pytest.raises(Exception, match="fewer than two"):
        A.global_stats(cells(spark, ([7], [1.0]))).collect()


def test_dose_out_of_train_range_is_flagged(spark):
    rows = spark.createDataFrame([("a", "train", 5.0), ("b", "val", 10.0)], "pair_id string, split string, dose_um double")
    flags = {r.pair_id: r.dose_in_range for r in clean.scale_dose(rows).collect()}
    assert flags == {"a": True, "b": False}


def test_one_pass_panel_equals_ragged_panel(spark, small):
    """Long and ragged forms of the same cells give the same panel."""
    table = clean.cleaned(small.ragged, small.genes)
    ragged = {r.cell_id: r.target for r in clean.panel_target(table, small.panel, 20).collect()}
    long = {r.cell_id: r.target for r in clean.panel_target_long(clean.to_long(table), 20).collect()}
    assert ragged.keys() == long.keys()
    for key, target in ragged.items():
        assert long[key] == pytest.approx(target)


def test_cells_without_library_are_named_and_refused(spark):
    kind = "cell_id long, entries array<struct<gene:bigint,count:double>>"
    rows = [(1, [(0, 2.0), (1, 1.0)]), (2, [(0, 0.0)]), (3, []), (4, [(0, float("nan"))]), (None, [(0, 0.0)])]
    table = spark.createDataFrame(rows, kind)
    panel = spark.createDataFrame([(0, 0), (1, 1)], "gene_index long, panel_rank long")
    assert sorted(((r.cell_id or 0), r.reason) for r in clean.library_faults(table).collect()) == [
        (0, "library is not positive"), (2, "library is not positive"), (3, "no gene in the vocabulary"), (4, "library is not finite")]
    sound = clean.sound_cells(table)
    assert [r.cell_id for r in clean.panel_target(sound, panel, 2).collect()] == [1]
    for bad in (2, 3, 4):
        with pytest.raises(Exception, match=f"not positive and finite for cell {bad}"):
            clean.panel_target(table.where(f"cell_id = {bad}"), panel, 2).collect()


def test_wide_vocabularies_keep_rows_apart(spark, monkeypatch):
    """Cells that repeat an id keep their own entries, and a panel of wide gene indexes is found too."""
    rows = spark.createDataFrame([(1, [5, 9], [1.0, 2.0]), (1, [9], [4.0]), (None, [7], [1.0])], "cell_id long, genes array<long>, expressions array<float>")
    vocab = spark.createDataFrame([(5, 10**12), (9, 2 * 10**12)], "token_id long, gene_index long")
    monkeypatch.setattr(clean, "LOOKUP_LIMIT", 3)
    mapped = clean.map_tokens(rows, vocab)
    assert sorted((tuple(r.genes), [tuple(e) for e in r.entries]) for r in mapped.collect()) == [
        ((5, 9), [(10**12, 1.0), (2 * 10**12, 2.0)]), ((7,), []), ((9,), [(2 * 10**12, 4.0)])]
    panel = spark.createDataFrame([(2 * 10**12, 0)], "gene_index long, panel_rank long")
    out = clean.panel_target(mapped.where("size(entries) > 0"), panel, 1).collect()
    assert sorted(round(r.target[0], 6) for r in out) == sorted(round(__import__("math").log1p(x), 6) for x in (10_000 * 2 / 3, 10_000.0))


def test_lookup_is_as_wide_as_the_tokens_in_use(spark):
    wide = spark.range(200_000).selectExpr("id * 30 as token_id", "id as gene_index")
    rows = cells(spark, ([30, 7, 90, 30], [1.0, 2.0, 3.0, 4.0]), ([5], [1.0]))
    assert {r.token_id for r in clean.used_vocabulary(rows, wide, "token_id").collect()} == {30, 90}
    mapped = clean.map_tokens(rows, wide)
    plan = mapped._jdf.queryExecution().optimizedPlan().toString()
    assert "subquery" not in plan and "Join" not in plan
    assert [[(e.gene, e["count"]) for e in r.entries] for r in mapped.orderBy("cell_id").collect()] == [[(1, 1.0), (3, 3.0), (1, 4.0)], []]
    with pytest.raises(ValueError, match="not unique"):
        clean.map_tokens(rows, wide.unionAll(wide.where("token_id = 600")))
