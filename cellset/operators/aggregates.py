"""Statistics, audits and summaries. Everything merges partial results; no group is gathered in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellset.functions import vectors as V
from cellset.functions.numbers import defined, is_finite
from cellset.operators import clean
from cellset.operators.scale import exact_quantiles, first_in_order, set_digest, with_previous
from cellset.session import materialize

PROBS = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}  # fixed values: reported quantiles
MERGED_PLATES = ("plate6", "plate14")  # fixed values: plates that are one biological replicate ...
MERGED_DOSE = 5.0                      # fixed value: ... at this dose only


def long_stats(values: DataFrame, column: str) -> DataFrame:
    """One row: mean and sample standard deviation of ``log1p``."""
    x = F.log1p(column)
    return values.agg(F.count("*").alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))


def global_stats(cells: DataFrame, limit: int | None = None, order: str = "cell_id") -> DataFrame:
    """Mean and sample std of ``log1p(expression)`` over the values after sentinel removal, before mapping.

    ``limit`` keeps the first raw cells in ``order``, with or without values, by a boundary of their keys, so no cell is
    moved. Cells without expressions add nothing. A negative value after the leading marker has no logarithm here: it is
    counted in ``negative_values`` and in none of the other numbers.
    """
    if limit is not None:
        cells = first_in_order(cells, [order], limit)
    kept = clean.strip_sentinel(cells.where(F.size("expressions") > 0))
    values = kept.select(F.explode("expressions").alias("x")).where(F.col("x").isNotNull())
    fine = F.when(F.col("x") >= 0, F.log1p("x"))
    stats = values.agg(F.count(fine).alias("count"), F.avg(fine).alias("mean"), F.stddev_samp(fine).alias("std"),
                       F.count_if(F.col("x") < 0).alias("negative_values"))
    enough = F.assert_true(F.col("count") >= 2, F.lit("fewer than two values")).isNull()
    return stats.where(enough)


def gene_stats(cells: DataFrame) -> DataFrame:
    """Per-gene mean, population variance and detection rate of CP10K-log1p over all cells, zeros included.

    Cells carry collapsed ``entries``; absent genes count as zero because sums are divided by the cell count.
    """
    sized = clean.positive_library(cells.withColumn("library", clean.entry_library()))
    # one extra entry per cell (gene NULL) counts the cells in the same pass
    marker = F.array(F.struct(F.lit(None).cast("long").alias("gene"), F.lit(0.0).alias("count")))
    long = sized.select("library", F.explode(F.concat("entries", marker)).alias("e"))
    v = clean.cp10k(F.col("e.count"), F.col("library"))
    return _from_sums(long.groupBy(F.col("e.gene").alias("gene_index")).agg(
        F.count("*").alias("rows"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"),
        F.count_if(F.col("e.count") > 0).alias("present")))


def gene_stats_long(long: DataFrame) -> DataFrame:
    """The same from long counts ``cell_id, gene_index, count`` without duplicates."""
    sizes = clean.positive_library(clean.library_size(long)).withColumn("gene_index", F.lit(None).cast("long"))
    rows = clean.with_library(long).select("gene_index", "count", "library").unionByName(
        sizes.select("gene_index", F.lit(0.0).alias("count"), "library"))
    v = clean.cp10k(F.col("count"), F.col("library"))
    return _from_sums(rows.groupBy("gene_index").agg(
        F.count("*").alias("rows"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"),
        F.count_if(F.col("count") > 0).alias("present")))


def _from_sums(sums: DataFrame) -> DataFrame:
    """Divide the sums of each gene by the number of cells, which is the row count of the NULL gene."""
    table = materialize(sums)  # one row per gene
    cells = table.where("gene_index is null").agg(F.max("rows").cast("double").alias("n")).scalar()
    mean = F.col("s") / F.col("_n")
    return table.where("gene_index is not null").withColumn("_n", cells).select(
        "gene_index", mean.alias("mean"), F.greatest(F.col("ss") / F.col("_n") - mean * mean, F.lit(0.0)).alias("variance"),
        (F.col("present") / F.col("_n")).alias("detection_rate"))


def running_stats(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        F.count(column).alias("count"), F.min(column).alias("min"), F.max(column).alias("max"),
        F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def describe_exact(df: DataFrame, column: str, by: list[str] | None = None, ddof: int = 0) -> DataFrame:
    """count, mean, std, min, max and exact interpolated quantiles, per group; undefined values are left out."""
    keys = by or []
    rows = df.where(is_finite(F.col(column).cast("double")))
    spread = F.stddev_pop(column) if ddof == 0 else F.coalesce(F.stddev_samp(column), F.lit(0.0))
    base = rows.groupBy(*keys).agg(F.count("*").alias("count"), F.avg(column).alias("mean"), spread.alias("std"),
                                   F.min(column).alias("min"), F.max(column).alias("max"))
    long = exact_quantiles(rows, keys, column, list(PROBS.values()))
    wide = long.groupBy(*keys).agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
                                     for name, p in PROBS.items()])
    if not keys:
        return base.withColumns(clean.one_row(wide))
    on = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys])
    return base.alias("a").join(wide.alias("q"), on).select("a.*", *[f"q.{name}" for name in PROBS])


def describe_by_each(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One grouped description per key, stacked as ``grouping, key``."""
    expanded = df.select(column, F.explode(F.array(*[
        F.struct(F.lit(k).alias("grouping"), F.col(k).cast("string").alias("key")) for k in keys])).alias("_g"))
    return describe_exact(expanded.select(column, "_g.grouping", "_g.key"), column, ["grouping", "key"])


def distribution(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    full = describe_exact(df, column, by)
    return full.select(*(by or []), "min", "median", "mean", "max")


def vector_audit(vecs: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Value and norm statistics of a vector table; each row is reduced to a few numbers before any shuffle."""
    keys, v = by or [], F.col(column)
    rows = vecs.select(
        *keys, F.size(v).alias("_n"), V.total(v).alias("_s"), V.dot(v, v).alias("_ss"),
        F.array_min(v).cast("double").alias("_lo"), F.array_max(v).cast("double").alias("_hi"),
        V.count_where(v, lambda x: x < 0).alias("_neg"), V.count_where(v, lambda x: x > 0).alias("_pos"),
        V.all_finite(v).alias("_ok")).withColumn("norm", F.sqrt("_ss"))
    n, s = F.sum("_n"), F.sum("_s")
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.min("_lo").alias("value_min"), F.max("_hi").alias("value_max"),
        (s / n).alias("value_mean"),
        F.sqrt(F.greatest(F.sum("_ss") / n - (s / n) * (s / n), F.lit(0.0))).alias("value_std"),
        (F.sum("_neg") / n).alias("negative_ratio"), (F.sum("_pos") / n).alias("positive_ratio"),
        F.min("norm").alias("norm_min"), F.avg("norm").alias("norm_mean"), F.max("norm").alias("norm_max"),
        F.stddev_pop("norm").alias("norm_std"), F.bool_and("_ok").alias("finite"))
    medians = exact_quantiles(rows, keys, "norm", [0.5]).select(*keys, F.col("quantile").alias("norm_median"))
    if not keys:
        return base.withColumns(clean.one_row(medians))
    return base.join(medians, keys)


def preprocessing_audit(cells: DataFrame, vocab: DataFrame) -> DataFrame:
    """Description of the per-cell counters: one row per counter, plus sentinel share on every row."""
    audit = clean.cell_audit(cells, vocab)
    names = ["raw_entries", "kept_entries", "mapped_entries", "unmapped_entries", "duplicates_collapsed"]
    long = audit.select("had_sentinel", F.explode(F.array(*[
        F.struct(F.lit(n).alias("counter"), F.col(n).cast("double").alias("value")) for n in names])).alias("_c")
    ).select("had_sentinel", "_c.*")
    marked = long.groupBy("counter").agg(F.count_if("had_sentinel").alias("sentinel_cells"))
    return describe_exact(long, "value", ["counter"]).join(marked, "counter")


def with_replicates(plate_condition: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Biological replicate of each plate-condition: the two fixed plates merge only at the fixed dose, if both exist.

    A merged replicate of more than two plate-conditions is ambiguous and fails the job.
    """
    pair = F.col("plate").isin(*MERGED_PLATES) & (F.col("dose_um") == MERGED_DOSE)
    group = Window.partitionBy(*(by or []), "edge_id", "cell_line_id", "drug", "dose_um")
    both = reduce(lambda a, b: a & b, [F.coalesce(F.bool_or(F.col("plate") == p).over(group), F.lit(False))
                                       for p in MERGED_PLATES])
    merged = plate_condition.withColumns({"_merge": F.coalesce(pair & both, F.lit(False)), "_rows": F.count_if(pair).over(group)})
    two = F.assert_true(~F.col("_merge") | (F.col("_rows") == len(MERGED_PLATES)), F.concat_ws(
        " ", F.lit("ambiguous replicate of"), "edge_id")).isNull()
    return merged.where(two).withColumn("replicate_id", F.when(F.col("_merge"), "|".join(MERGED_PLATES)).otherwise(
        F.col("condition_id"))).drop("_merge", "_rows")


def hierarchical_mean(raw: DataFrame, metric: str, by: list[str] | None = None) -> dict[str, DataFrame]:
    """Equal-weight means: repeat -> plate-condition -> replicate -> dose -> edge, with counts carried up; inside each of ``by``."""
    keys = by or []
    plate = raw.groupBy(*keys, "condition_id", "edge_id", "cell_line_id", "drug", "dose_um", "plate").agg(
        F.avg(metric).alias(metric))
    replicate = with_replicates(plate, keys).groupBy(*keys, "edge_id", "cell_line_id", "drug", "dose_um", "replicate_id").agg(
        F.avg(metric).alias(metric), F.count("*").alias("plate_conditions"))
    dose = replicate.groupBy(*keys, "edge_id", "cell_line_id", "drug", "dose_um").agg(
        F.avg(metric).alias(metric), F.count("*").alias("replicates"),
        F.sum("plate_conditions").alias("plate_conditions"))
    edge = dose.groupBy(*keys, "edge_id", "cell_line_id", "drug").agg(
        F.avg(metric).alias(metric), F.count("*").alias("doses"), F.sum("replicates").alias("replicates"),
        F.sum("plate_conditions").alias("plate_conditions"))
    return {"plate_condition": plate, "replicate": replicate, "dose": dose, "edge": edge}


def mean_over_repeats(raw: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return raw.groupBy(*keys).agg(F.count("*").alias("repeats"), *[F.avg(m).alias(m) for m in metrics])


def set_delta(members: DataFrame, column: str, dim: int) -> DataFrame:
    """Mean treated vector minus mean control vector per condition.

    ``members`` has ``owner_type`` (0 treated, 1 control), ``pair_id`` (treated rows), ``control_pool_id`` and the
    vector. All means come from one aggregate; the small table of means is then joined with itself.
    """
    owner = F.when(F.col("owner_type") == 1, F.lit(None).cast("string")).otherwise(F.col("pair_id"))
    means = materialize(V.mean_vectors(
        members.withColumn("_owner", owner), ["control_pool_id", "_owner"], column, dim, "mean",
        extra={"cells": F.count("*")}))
    control = means.where("_owner is null").select("control_pool_id", F.col("mean").alias("_c"),
                                                   F.col("cells").alias("control_cells"))
    treated = means.where("_owner is not null").select(F.col("_owner").alias("pair_id"), "control_pool_id", "mean",
                                                       F.col("cells").alias("treated_cells"))
    return treated.join(control, "control_pool_id").select(
        "pair_id", "control_pool_id", "treated_cells", "control_cells",
        V.difference(F.col("mean"), F.col("_c")).alias("delta"))


def summarize_branch(metrics: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Macro means over defined values per (branch, repeat), then mean and sample std over repeats (0 for one)."""
    clean_rows = metrics.select("branch", "repeat_epoch", *[defined(F.col(c).cast("double")).alias(c) for c in columns])
    repeats = clean_rows.groupBy("branch", "repeat_epoch").agg(
        F.count("*").alias("conditions"),
        *[e for c in columns for e in (F.avg(c).alias(c), F.count(c).alias(f"{c}_valid_n"),
                                       (F.count("*") - F.count(c)).alias(f"{c}_nan_n"))])
    stacked = repeats.select("branch", F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in columns])).alias("_m")).select(
        "branch", "_m.*")
    summary = stacked.groupBy("branch", "metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.count("value").alias("valid_repeats"), (F.count("*") - F.count("value")).alias("nan_repeats"))
    return repeats, summary


def grain_counts(conditions: DataFrame, by: str = "split") -> DataFrame:
    return conditions.groupBy(by).agg(
        F.count("*").alias("conditions"), F.count_distinct("edge_id").alias("edges"),
        F.count_distinct("drug").alias("drugs"), F.count_distinct("control_pool_id").alias("pools"))


def split_distributions(conditions: DataFrame) -> DataFrame:
    """Counts by (split, dose) and by (split, cell line) in one aggregate."""
    split, dose, line = F.col("split"), F.col("dose_um"), F.col("cell_line_id")
    return conditions.groupingSets([[split, dose], [split, line]], split, dose, line).agg(
        F.count("*").alias("conditions"))


def profile_dimension(df: DataFrame, key: str, row_order: str, columns: list[str]) -> DataFrame:
    """Rows, distincts, missing values and duplicated rows per column; key range, contiguity and sortedness by ``row_order``.

    ``stored_order`` tells whether files are sorted as they lie, without a shuffle.
    """
    ordered = with_previous(df.select(row_order, key) if row_order != key else df.select(key), [row_order], key, "_before")
    head = ordered.agg(
        F.count("*").alias("rows"), F.min(key).alias("key_min"), F.max(key).alias("key_max"),
        F.coalesce(F.bool_and(F.col(key) >= F.coalesce(F.col("_before"), F.col(key))), F.lit(True)).alias("sorted"))
    stats = clean.one_row(head)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_c")
    ).select("_c.*")
    copies = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    present = F.col("value").isNotNull()
    per = copies.groupBy("column").agg(
        F.count_if(present).alias("distinct_values"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("missing_values"),
        F.coalesce(F.sum(F.when(present & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("duplicated_rows"))
    out = per.withColumns(stats)
    return out.withColumn("contiguous", (F.col("column") == key) & (
        F.col("distinct_values") == F.col("key_max") - F.col("key_min") + 1))


STRETCH = "shard string, first_row long, last_row long, n long, first {kind}, last {kind}, sorted boolean"


def stored_order(located: DataFrame, key: str) -> DataFrame:
    """One row: ``rows``, ``sorted``: whether ``key`` never falls in the order in which the rows lie in their files, by file name.

    ``located`` is a plain scan with ``shard, row``. A task reduces every stretch of a file that it reads to its ends, and the stretches
    (a few per file split) are joined in order, so no row is shuffled. NULL and NaN keys fail the job; an empty table is sorted.
    """
    kind = located.schema[key].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        now = None
        names = ["shard", "first_row", "last_row", "n", "first", "last", "sorted"]
        fields = None

        def row_of(x):
            return pa.RecordBatch.from_arrays([pa.array([x[n]], fields[n]) for n in names], names)

        for batch in batches:
            shard, row, values = batch.columns
            fields = {"shard": pa.string(), "first_row": pa.int64(), "last_row": pa.int64(), "n": pa.int64(), "first": values.type,
                      "last": values.type, "sorted": pa.bool_()}
            if values.null_count or (pa.types.is_floating(values.type) and np.isnan(values.to_numpy()).any()):
                raise ValueError(f"{key} is undefined in some rows")
            shards, rows, x = shard.to_numpy(zero_copy_only=False), row.to_numpy(), values.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (rows[1:] != rows[:-1] + 1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
                if a == b:
                    continue
                rising = bool((x[a + 1:b] >= x[a:b - 1]).all())
                part = {"shard": shards[a], "first_row": int(rows[a]), "last_row": int(rows[b - 1]), "n": int(b - a),
                        "first": values[int(a)].as_py(), "last": values[int(b) - 1].as_py(), "sorted": rising}
                if now and (now["shard"], now["last_row"] + 1) == (part["shard"], part["first_row"]):
                    now |= {"last_row": part["last_row"], "n": now["n"] + part["n"], "last": part["last"],
                            "sorted": now["sorted"] and rising and now["last"] <= part["first"]}
                else:
                    if now:
                        yield row_of(now)
                    now = part
        if now:
            yield row_of(now)

    stretches = materialize(located.select("shard", "row", key).mapInArrow(run, STRETCH.format(kind=kind)))
    # one row per stretch of a file
    before = Window.orderBy("shard", "first_row")
    met = F.coalesce(F.lag("last").over(before) <= F.col("first"), F.lit(True))
    return stretches.withColumn("_met", met).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.bool_and(F.col("sorted") & F.col("_met")), F.lit(True)).alias("sorted"))


def coverage(consumed: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Consumed rows, unique ids, missing, unexpected and repeated ids, and the digest of the id set."""
    seen = consumed.groupBy(key).agg(F.count("*").alias("_n"))
    both = seen.join(expected.select(key).withColumn("_want", F.lit(True)), key, "full_outer")
    text = F.when(F.col("_n").isNotNull(), F.col(key).cast("string"))
    return both.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("consumed_rows"), F.count("_n").alias("unique_ids"),
        F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_want").isNull()).alias("unexpected"),
        F.count_if(F.col("_n") > 1).alias("repeated"), set_digest(text).alias("digest"))


def membership_rows(sets: DataFrame) -> DataFrame:
    """One row per drawn set with its members in ascending order (a set has a fixed small size)."""
    return sets.groupBy("condition_id", "repeat_epoch", "side").agg(
        F.array_sort(F.collect_list("cell_index")).alias("members"))


def membership_text() -> Column:
    return F.concat_ws("|", "condition_id", F.col("repeat_epoch").cast("string"), "side",
                       F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


def membership_digest(sets: DataFrame) -> DataFrame:
    rows = membership_rows(sets)
    return rows.agg(F.count("*").alias("sets"), F.sum(F.size("members")).alias("members"),
                    set_digest(membership_text()).alias("digest"))


def plan_counts(plan: DataFrame, by: list[str]) -> DataFrame:
    return plan.groupBy(*by).agg(F.count("*").alias("rows"))


def corpus_mse(pairs: DataFrame, prediction: str = "prediction", target: str = "target") -> DataFrame:
    gap = V.difference(F.col(prediction), F.col(target))
    return pairs.agg(F.count("*").alias("cells"), (F.sum(V.dot(gap, gap)) / F.sum(F.size(target))).alias("mse"))


def progress_rollup(progress: DataFrame) -> DataFrame:
    """Totals over workers: remaining time is that of the slowest one."""
    left = F.col("planned") - F.col("processed")
    return progress.agg(
        F.count("*").alias("workers"), F.sum("processed").alias("processed"), F.sum(left).alias("remaining"),
        F.sum("rate").alias("rate"), F.max(F.try_divide(left, F.col("rate"))).alias("eta_seconds"),
        F.bool_and(left == 0).alias("complete"))
