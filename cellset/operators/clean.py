"""Row-level cleaning of ragged cells and of their long form.

A ragged cell stays one row from scan to result: vocabulary lookup, duplicate collapse, library size and panel
selection are array expressions, so none of them shuffles. The long forms take ``cell_id, gene_index, count``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellset.functions.vectors import all_finite, count_where, shifted
from cellset.operators.scale import dense_index, settled
from cellset.session import materialize

SCALE = 10_000.0   # fixed value: counts per ten thousand
EPSILON = 1e-6     # fixed value: added to the standard deviation of the z-score
MISSING = "N/A"    # fixed value: text of absent metadata
LOOKUP_LIMIT = 100_000     # slots of a lookup that is sent to the tasks
SMALL_VOCABULARY = 4_096   # keys below this need no pass that finds those in use


def drop_malformed(cells: DataFrame) -> DataFrame:
    """Keep cells whose two lists are present and not empty."""
    return cells.where((F.size("genes") > 0) & (F.size("expressions") > 0))


def strip_sentinel(cells: DataFrame) -> DataFrame:
    """Remove the leading marker (first expression negative) from both lists; adds ``had_sentinel``."""
    marked = F.coalesce(F.try_element_at("expressions", F.lit(1)) < 0, F.lit(False))
    rest = lambda c: F.when(F.col("had_sentinel"), F.slice(c, 2, F.greatest(F.size(c), F.lit(1)))).otherwise(
        F.col(c))
    return cells.withColumn("had_sentinel", marked).withColumns(
        {"genes": rest("genes"), "expressions": rest("expressions")})


def metadata_defaults(cells: DataFrame, columns: list[str], default: str = MISSING) -> DataFrame:
    return cells.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(default)) for c in columns})


def lookup_array(vocab: DataFrame, key: str, value: str) -> Column | None:
    """Dense array ``key -> value`` of whole numbers as a literal, or None when the keys are too many or too wide for it.

    A literal lies once in a task; an array column, or a subquery's result, would be copied into every row.
    """
    head = vocab.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n"),
                     F.count_distinct(key).alias("d")).first()
    if head.n != head.d:
        raise ValueError(f"vocabulary key {key} is not unique")
    if head.n == 0 or head.lo < 0 or head.hi >= LOOKUP_LIMIT:
        return None
    places = {r[0]: r[1] for r in vocab.select(key, value).collect()}
    text = ",".join("" if (v := places.get(k)) is None else str(v) for k in range(head.hi + 1))
    return F.split(F.lit(text), ",").try_cast("array<bigint>")


def used_vocabulary(cells: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """The part of a vocabulary that the cells name, by one pass over them; a vocabulary within ``SMALL_VOCABULARY`` is left as it is.

    So a lookup is as wide as the tokens in use, however large the vocabulary is.
    """
    head = vocab.agg(F.max(key).alias("hi"), F.count("*").alias("n"), F.count_distinct(key).alias("d")).first()
    if head.n != head.d:
        raise ValueError(f"vocabulary key {key} is not unique")
    if head.n == 0 or head.hi < SMALL_VOCABULARY:
        return vocab
    used = cells.select(F.explode("genes").alias("_used")).distinct()
    return materialize(vocab.join(used, F.col(key) == F.col("_used"), "left_semi"))


def slot(key: Column) -> Column:
    """Place in a dense lookup; keys that no lookup can hold become -1, which is nowhere."""
    return F.when((key >= 0) & (key < LOOKUP_LIMIT), key).otherwise(F.lit(-1)).cast("int")


def map_tokens(cells: DataFrame, vocab: DataFrame, key: str = "token_id", value: str = "gene_index") -> DataFrame:
    """Replace tokens by vocabulary positions; adds ``entries array<struct<gene, count>>`` in list order.

    By a dense array of the tokens in use inside the scan's stage; where these are too wide for that, ``map_tokens_joined`` gives the
    same result.
    """
    used = used_vocabulary(cells, vocab.select(key, value), key)
    lookup = lookup_array(used, key, value)
    if lookup is not None:
        pairs = F.zip_with("genes", "expressions", lambda g, e: F.struct(
            F.get(lookup, slot(g)).alias("gene"), e.cast("double").alias("count")))
        kept = F.filter(pairs, lambda p: p.getField("gene").isNotNull())
        return settled(cells.withColumn("entries", kept), "entries")
    return map_tokens_joined(cells, used, key, value)


def map_tokens_joined(cells: DataFrame, vocab: DataFrame, key: str = "token_id", value: str = "gene_index") -> DataFrame:
    """The same for a vocabulary of any size: entries are joined, and come back to their own row, whatever its ``cell_id``."""
    rows = materialize(cells.withColumn("_row", F.monotonically_increasing_id()))
    long = rows.select("_row", F.posexplode(F.arrays_zip("genes", "expressions")).alias("pos", "p"))
    mapped = long.join(vocab.select(F.col(key).alias("_key"), F.col(value).alias("gene")),
                       F.col("p.genes") == F.col("_key"))
    lists = mapped.groupBy("_row").agg(F.array_sort(F.collect_list(
        F.struct("pos", "gene", F.col("p.expressions").cast("double").alias("count")))).alias("_entries"))
    entries = F.transform("_entries", lambda r: F.struct(r.getField("gene").alias("gene"),
                                                         r.getField("count").alias("count")))
    none = F.array().cast("array<struct<gene:bigint,count:double>>")
    return rows.join(lists, "_row", "left").withColumn("entries", F.coalesce(entries, none)).drop("_entries", "_row")


def collapse_entries(cells: DataFrame) -> DataFrame:
    """Sum duplicate genes inside each row; entries come out sorted by gene.

    Sort once, mark where runs start, then sum each run's slice: linear after the sort.
    """
    table = settled(cells.withColumn("_s", F.sort_array("entries")), "_s")
    gene = lambda i: F.get(F.col("_s"), i - 1).getField("gene")
    starts = F.when(F.size("_s") > 0, F.filter(
        F.sequence(F.lit(1), F.greatest(F.size("_s"), F.lit(1))),
        lambda i: (i == 1) | (gene(i) != gene(i - 1)))).otherwise(F.array().cast("array<int>"))
    table = settled(table.withColumn("_b", starts), "_b")
    stop = lambda k: F.coalesce(F.get(F.col("_b"), k + 1), F.size("_s") + 1)
    runs = F.transform("_b", lambda b, k: F.struct(
        gene(b).alias("gene"),
        F.aggregate(F.slice("_s", b, stop(k) - b), F.lit(0.0), lambda s, e: s + e.getField("count")).alias("count")))
    return settled(table.withColumn("entries", runs).drop("_s", "_b"), "entries")


def entry_library(column: str = "entries") -> Column:
    """Library size of a row: sum over all mapped entries (not only the panel)."""
    return F.aggregate(column, F.lit(0.0), lambda s, e: s + e.getField("count"))


def validate_counts(cells: DataFrame, vocab: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``reason`` (NULL when valid) after sentinel removal; ``strict`` fails the job on the first bad row."""
    missing = ~F.coalesce((F.size("genes") > 0) & (F.size("expressions") > 0), F.lit(False))
    table = strip_sentinel(cells.withColumn("_missing", missing))
    # zip_with pads the shorter list, so unequal lists map without failing and are reported below
    table = map_tokens(table, vocab)
    counts = F.col("expressions")
    reason = (F.when(F.col("_missing"), "missing_list")
              .when(F.size("genes") != F.size("expressions"), "length_mismatch")
              .when(F.size("genes") == 0, "empty_after_sentinel")
              .when(~all_finite(counts), "not_finite")
              .when(F.exists(counts, lambda x: x < 0), "negative_count")
              .when(F.size("entries") == 0, "no_mapped_gene")
              .when(entry_library() <= 0, "zero_library"))
    table = table.withColumn("reason", reason).drop("_missing")
    if strict:
        table = table.where(F.assert_true(F.col("reason").isNull(), F.concat(
            F.lit("invalid cell "), F.col("cell_id").cast("string"), F.lit(": "), F.col("reason"))).isNull())
    return table


def split_quarantine(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the rest with their reason."""
    return validated.where("reason is null").drop("reason"), validated.where("reason is not null")


def cleaned(cells: DataFrame, vocab: DataFrame) -> DataFrame:
    """Valid cells with sentinel removed and mapped ``entries`` attached."""
    return split_quarantine(validate_counts(cells, vocab))[0]


def cell_audit(cells: DataFrame, vocab: DataFrame) -> DataFrame:
    """Per-cell preparation counters; lists of unequal length are reported, and mapped entries before and after collapse."""
    raw = drop_malformed(cells).withColumn("raw_entries", F.size("genes"))
    table = map_tokens(strip_sentinel(raw), vocab)
    distinct = F.size(F.array_distinct(F.transform("entries", lambda e: e.getField("gene"))))
    return table.select(
        "cell_id", "had_sentinel", "raw_entries", F.size("genes").alias("kept_entries"),
        F.size("entries").alias("mapped_entries"), (F.size("genes") - F.size("entries")).alias("unmapped_entries"),
        (F.size("entries") - distinct).alias("duplicates_collapsed"), distinct.alias("mapped_genes"),
        count_where(F.col("entries"), lambda e: e.getField("count") != F.rint(e.getField("count"))).alias("non_integer_entries"),
        (F.size("genes") == F.size("expressions")).alias("lists_match"))


def panel_target(cells: DataFrame, panel: DataFrame, width: int, name: str = "target") -> DataFrame:
    """``log1p(10000 * count / library)`` of the panel genes in panel order, absent genes 0.

    ``cells`` carry mapped ``entries``. Only entries of panel genes are kept before they are summed.
    """
    rank_of, place = lookup_array(panel, "gene_index", "panel_rank"), slot
    if rank_of is None:  # wide gene indexes: a map of the panel, which has ``width`` entries
        rank_of, place = panel.agg(F.map_from_entries(F.collect_list(F.struct("gene_index", "panel_rank")))).scalar(), None
    table = cells.withColumn("library", entry_library())
    if place is None:
        table = table.withColumn("_rank_of", rank_of)
    find = (lambda g: F.get(rank_of, place(g))) if place else (lambda g: F.try_element_at(F.col("_rank_of"), g))
    ranked = F.transform("entries", lambda e: F.struct(
        find(e.getField("gene")).alias("rank"), e.getField("count").alias("count")))
    hits = F.filter(ranked, lambda e: e.getField("rank").isNotNull())
    table = settled(table.withColumn("_hits", hits).drop("_rank_of"), "library", "_hits")
    one = lambda r: F.aggregate(
        F.filter("_hits", lambda e: e.getField("rank") == r), F.lit(0.0), lambda s, e: s + e.getField("count"))
    values = F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                         lambda r: F.log1p(F.lit(SCALE) * one(r) / F.col("library")))
    return settled(positive_library(table).withColumn(name, values).drop("_hits"), name)


def to_long(cells: DataFrame) -> DataFrame:
    """``cell_id, gene_index, count`` from mapped entries."""
    return cells.select("cell_id", F.explode("entries").alias("e")).select(
        "cell_id", F.col("e.gene").alias("gene_index"), F.col("e.count").alias("count"))


def positive_library(table: DataFrame) -> DataFrame:
    """``table`` with the check that every ``library`` is positive and finite: such a cell has no normalised values, so the job fails.

    ``library_faults`` names those cells beforehand, and ``sound_cells`` leaves them out on purpose.
    """
    name = F.concat(F.lit("library is not positive and finite"), *(
        [F.lit(" for cell "), F.coalesce(F.col("cell_id").cast("string"), F.lit("NULL"))] if "cell_id" in table.columns else []))
    sound = F.coalesce((F.col("library") > 0) & (F.col("library") < float("inf")), F.lit(False))
    return table.where(F.assert_true(sound, name).isNull())


def library_faults(cells: DataFrame) -> DataFrame:
    """``cell_id, reason`` of the cells with mapped ``entries`` that can't be normalised."""
    library = F.coalesce(entry_library(), F.lit(0.0))
    reason = F.when(F.coalesce(F.size("entries"), F.lit(0)) <= 0, "no gene in the vocabulary").when(
        F.isnan(library) | (library == float("inf")), "library is not finite").when(library <= 0, "library is not positive")
    return cells.select("cell_id", reason.alias("reason")).where("reason is not null")


def sound_cells(cells: DataFrame) -> DataFrame:
    """The cells with mapped ``entries`` whose library is positive and finite."""
    library = entry_library()
    return cells.where(F.coalesce((library > 0) & (library < float("inf")), F.lit(False)))


def collapse_duplicates(long: DataFrame) -> DataFrame:
    return long.groupBy("cell_id", "gene_index").agg(F.sum("count").alias("count"))


def library_size(long: DataFrame) -> DataFrame:
    return long.groupBy("cell_id").agg(F.sum("count").alias("library"))


def with_library(long: DataFrame) -> DataFrame:
    """Attach each cell's library as a join on its aggregate: a hot cell is summed map-side, never sorted whole."""
    return long.join(positive_library(library_size(long)), "cell_id")


def cp10k(count: Column, library: Column) -> Column:
    return F.log1p(F.lit(SCALE) * count / library)


def cp10k_log1p(long: DataFrame) -> DataFrame:
    return with_library(long).withColumn("value", cp10k(F.col("count"), F.col("library")))


def panel_target_long(long: DataFrame, width: int, name: str = "target") -> DataFrame:
    """Panel vector per cell from long counts whose first ``width`` gene indexes are the panel: one aggregate.

    Library and panel sums come from the same pass, so duplicates need no collapse of their own.
    """
    sums = [F.coalesce(F.sum(F.when(F.col("gene_index") == r, F.col("count"))), F.lit(0.0)).alias(f"_p{r}")
            for r in range(width)]
    table = long.groupBy("cell_id").agg(F.sum("count").alias("library"), *sums)
    return positive_library(table).select("cell_id", "library", F.array(*[
        cp10k(F.col(f"_p{r}"), F.col("library")) for r in range(width)]).alias(name))


def one_row(stats: DataFrame) -> dict[str, Column]:
    """Columns of a one-row frame as scalar subqueries."""
    packed = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    return {c: packed.getField(c) for c in stats.columns}


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return (F.log1p(x) - mean) / (std + F.lit(EPSILON))


def zscore_log1p(long: DataFrame, stats: DataFrame, name: str = "z") -> DataFrame:
    """Global z-score of ``log1p(count)``; no library normalisation."""
    s = one_row(stats)
    return long.withColumn(name, zscore(F.col("count"), s["mean"], s["std"]))


def inverse_check(long: DataFrame, stats: DataFrame, rtol: float = 1e-5, atol: float = 1e-4) -> DataFrame:
    """Undo the z-score and compare with the raw counts."""
    s = one_row(stats)
    back = F.expm1(F.col("z") * (s["std"] + F.lit(EPSILON)) + s["mean"])
    gap = F.abs(back - F.col("count"))
    return zscore_log1p(long, stats).agg(
        F.count("*").alias("values"), F.max(gap).alias("max_abs_error"),
        F.bool_and(gap <= F.lit(atol) + F.lit(rtol) * F.abs("count")).alias("passed"))


def compare_normalisation(long: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Difference of z-scores of the same counts under two statistics tables, on one scan."""
    a, b = one_row(first), one_row(second)
    gap = F.abs(zscore(F.col("count"), a["mean"], a["std"]) - zscore(F.col("count"), b["mean"], b["std"]))
    return long.agg(F.count("*").alias("values"), F.max(gap).alias("max_abs"), F.avg(gap).alias("mean_abs"))


def scale_dose(conditions: DataFrame, dose: str = "dose_um") -> DataFrame:
    """``log1p(dose) / log1p(largest train dose)`` and whether it lies in (0, 1]."""
    top = conditions.agg(F.max(F.when(F.col("split") == "train", F.col(dose))).alias("top")).scalar()
    scaled = F.log1p(F.col(dose)) / F.log1p(top)
    return conditions.withColumn("dose_scaled", scaled).withColumn(
        "dose_in_range", (F.col("dose_scaled") > 0) & (F.col("dose_scaled") <= 1))


def drug_vocabulary(conditions: DataFrame) -> DataFrame:
    """Distinct drugs in name order with ``drug_id`` 0..n-1."""
    return dense_index(conditions.select("drug").distinct(), ["drug"], "drug_id")


def featurize(conditions: DataFrame, vocab: DataFrame) -> DataFrame:
    """One-hot drug followed by the standardised log10 dose; statistics come from the train conditions."""
    logged = F.log10("dose_um")
    train = conditions.where("split = 'train'").agg(
        F.avg(logged).alias("mean"), F.stddev_pop(logged).alias("std"))
    s, width = one_row(train), vocab.agg(F.count("*").alias("n")).scalar()
    joined = conditions.join(vocab, "drug").withColumn("_n", width)
    hot = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1),
                      lambda i: F.when(i == F.col("drug_id"), 1.0).otherwise(0.0))
    return joined.withColumn("_dose", (logged - s["mean"]) / s["std"]).withColumn(
        "features", F.concat(hot, F.array("_dose"))).drop("_n", "_dose")


def condition_vectors(sets: DataFrame, drug_vecs: DataFrame, drug: str, vector: str, name: str) -> DataFrame:
    """Control vectors moved by their condition's drug vector times its scaled dose (``drug_vec``, ``dose``).

    Rows whose drug has no vector stay, with a NULL result.
    """
    return sets.join(drug_vecs, drug, "left").withColumn(name, shifted(F.col(vector), F.col("drug_vec"), F.col("dose")))


def eligible(conditions: DataFrame, size: int, lines: DataFrame | None = None) -> DataFrame:
    """Conditions flagged usable, large enough on both sides, and of a wanted cell line."""
    kept = conditions.where((F.col("eligible") == 1) & (F.col("treated_cells") >= size)
                            & (F.col("control_cells") >= size))
    return kept if lines is None else kept.join(lines.select("cell_line_id"), "cell_line_id", "left_semi")


def project_contract(df: DataFrame, contract: dict[str, tuple[str, str]]) -> DataFrame:
    """``{new name: (source column, type)}``: rename, narrow and drop in one projection."""
    return df.select(*[F.col(src).cast(kind).alias(new) for new, (src, kind) in contract.items()])


def negative_ratio(v: Column) -> Column:
    return count_where(v, lambda x: x < 0) / F.size(v)

