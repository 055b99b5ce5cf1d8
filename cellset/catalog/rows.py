"""Row-level queries: cleaning, normalisation, projections, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellset.catalog.registry import query, r6
from cellset.functions.hashing import cell_key, locator_text, seeded_hash
from cellset.functions.numbers import compact, defined, is_finite, rounded
from cellset.functions import vectors as V
from cellset.operators import clean
from cellset.operators.aggregates import long_stats
from cellset.sources.surrogates import DIM, PANEL, Tables


@query("p01_drop_malformed", """
select cell_id, len(genes) as n_genes, len(expressions) as n_expressions from fx_ragged
where genes is not null and expressions is not null and len(genes) > 0 and len(expressions) > 0""")
def p01(t: Tables):
    return clean.drop_malformed(t.ragged).select(
        "cell_id", F.size("genes").alias("n_genes"), F.size("expressions").alias("n_expressions"))


@query("p02_strip_sentinel", """
select cell_id, had_sentinel, len(genes) as n_genes, coalesce(list_sum(expressions), 0.0) as sum_expr,
 cast(coalesce(list_sum(genes), 0) as bigint) as sum_token from fx_stripped""")
def p02(t: Tables):
    kept = clean.strip_sentinel(clean.drop_malformed(t.ragged))
    return kept.select("cell_id", "had_sentinel", F.size("genes").alias("n_genes"),
                       V.total(F.col("expressions")).alias("sum_expr"),
                       F.aggregate("genes", F.lit(0).cast("long"), lambda s, x: s + x).alias("sum_token"))


@query("p03_map_tokens", """
with e as (select cell_id, genes[i] as token_id, expressions[i] as count, i from
  (select cell_id, genes, expressions, unnest(range(1, len(genes) + 1)) as i from fx_stripped)),
 m as (select e.cell_id, g.gene_index, e.count, row_number() over (partition by e.cell_id order by i) as place
  from e join fx_genes g on e.token_id = g.token_id)
select cell_id, count(*) as mapped, cast(sum(gene_index * place) as bigint) as order_sum, coalesce(sum(count * place), 0) as count_sum
from m group by cell_id""")
def p03(t: Tables):
    """All cells with both lists, sound or not; a gene without a count keeps its place."""
    mapped = clean.map_tokens(clean.strip_sentinel(clean.drop_malformed(t.ragged)), t.genes).where(F.size("entries") > 0)
    place = F.transform("entries", lambda e, i: e.getField("gene") * (i + 1))
    weight = F.transform("entries", lambda e, i: F.coalesce(e.getField("count"), F.lit(0.0)) * (i + 1))
    return mapped.select("cell_id", F.size("entries").cast("long").alias("mapped"),
                         F.aggregate(place, F.lit(0).cast("long"), lambda s, x: s + x).alias("order_sum"),
                         V.total(weight).alias("count_sum"))


@query("p04_metadata_defaults", """
select cell_id, coalesce(barcode, 'N/A') as barcode, coalesce(plate, 'N/A') as plate, drug from fx_ragged""")
def p04(t: Tables):
    return clean.metadata_defaults(t.ragged, ["barcode", "plate"]).select("cell_id", "barcode", "plate", "drug")


@query("p05_validate_counts", """
with m as (select r.cell_id, count(g.gene_index) as mapped, sum(case when g.gene_index is not null then e end) as library
 from (select cell_id, unnest(genes) as g0, unnest(expressions) as e from fx_stripped) r
 left join fx_genes g on r.g0 = g.token_id group by r.cell_id)
select f.cell_id, case when s.cell_id is null then 'missing_list'
 when len(s.genes) <> len(s.expressions) then 'length_mismatch'
 when len(s.genes) = 0 then 'empty_after_sentinel'
 when len(list_filter(s.expressions, lambda x: x < 0)) > 0 then 'negative_count'
 when coalesce(m.mapped, 0) = 0 then 'no_mapped_gene'
 when m.library <= 0 then 'zero_library' end as reason
from fx_ragged f left join fx_stripped s on f.cell_id = s.cell_id left join m on f.cell_id = m.cell_id""")
def p05(t: Tables):
    return clean.validate_counts(t.ragged, t.genes).select("cell_id", "reason")


@query("p06_collapse_duplicates", f"""
select cell_id, count(*) as genes, cast(sum(gene_index * place) as bigint) as order_sum, {r6("sum(count * place)")} as count_sum
from (select cell_id, gene_index, count, row_number() over (partition by cell_id order by gene_index) as place
 from (select cell_id, gene_index, sum(count) as count from fx_mapped_long group by cell_id, gene_index) a) m
where cell_id in (select cell_id from fx_mapped_lib) group by cell_id""")
def p06(t: Tables):
    once = clean.collapse_entries(clean.cleaned(t.ragged, t.genes))
    place = F.transform("entries", lambda e, i: e.getField("gene") * (i + 1))
    weight = F.transform("entries", lambda e, i: e.getField("count") * (i + 1))
    return once.select("cell_id", F.size("entries").cast("long").alias("genes"),
                       F.aggregate(place, F.lit(0).cast("long"), lambda s, x: s + x).alias("order_sum"),
                       rounded(V.total(weight)).alias("count_sum"))


@query("p06_collapse_duplicates_long", """
select cell_id, gene_index, sum(count) as count from fx_counts group by cell_id, gene_index""")
def p06_long(t: Tables):
    return clean.collapse_duplicates(t.counts)


@query("p07_library_size", "select cell_id, library from fx_mapped_lib")
def p07(t: Tables):
    return clean.cleaned(t.ragged, t.genes).select("cell_id", clean.entry_library().alias("library"))


@query("p07_library_size_long", "select cell_id, sum(count) as library from fx_counts group by cell_id")
def p07_long(t: Tables):
    return clean.library_size(t.counts)


@query("p08_cell_audit", """
with e as (select cell_id, unnest(genes) as tok from fx_stripped),
 m as (select e.cell_id, count(*) as mapped, count(distinct g.gene_index) as uniq
  from e join fx_genes g on e.tok = g.token_id join fx_stripped s on s.cell_id = e.cell_id
  group by e.cell_id)
select s.cell_id, s.had_sentinel, len(f.genes) as raw_entries, len(s.genes) as kept_entries,
 coalesce(m.mapped, 0) as mapped_entries, len(s.genes) - coalesce(m.mapped, 0) as unmapped_entries,
 coalesce(m.mapped - m.uniq, 0) as duplicates_collapsed, coalesce(m.uniq, 0) as mapped_genes,
 (select count(*) from (select unnest(s.genes) as tok, unnest(s.expressions) as x) u join fx_genes g on u.tok = g.token_id where x <> floor(x)) as non_integer_entries,
 len(s.genes) = len(s.expressions) as lists_match
from fx_stripped s join fx_ragged f on s.cell_id = f.cell_id left join m on m.cell_id = s.cell_id""")
def p08(t: Tables):
    return clean.cell_audit(t.ragged, t.genes)


@query("p09_cp10k_log1p", f"""
select c.cell_id, c.gene_index, {r6("ln(1 + 10000.0 * sum(c.count) / l.library)")} as value
from fx_counts c join fx_lib l on c.cell_id = l.cell_id group by c.cell_id, c.gene_index, l.library""")
def p09(t: Tables):
    return clean.cp10k_log1p(clean.collapse_duplicates(t.counts)).select(
        "cell_id", "gene_index", rounded(F.col("value")).alias("value"))


@query("p10_panel_target", f"""
select l.cell_id, p.panel_rank, {r6("ln(1 + 10000.0 * coalesce(sum(m.count), 0) / max(l.library))")} as value
from fx_mapped_lib l cross join fx_panel p
left join fx_mapped_long m on m.cell_id = l.cell_id and m.gene_index = p.gene_index group by l.cell_id, p.panel_rank""")
def p10(t: Tables):
    target = clean.panel_target(clean.cleaned(t.ragged, t.genes), t.panel, PANEL)
    return target.select("cell_id", F.posexplode("target").alias("panel_rank", "v")).select(
        "cell_id", F.col("panel_rank").cast("long").alias("panel_rank"), rounded(F.col("v")).alias("value"))


STATS = "stats as (select avg(ln(1 + expr)) as mean, stddev_samp(ln(1 + expr)) as std from fx_entries)"


@query("p11_zscore_log1p", f"""
with {STATS}
select gene_index, count(*) as n, {r6("min((ln(1 + count) - mean) / (std + 1e-6))")} as min_z,
 {r6("avg((ln(1 + count) - mean) / (std + 1e-6))")} as mean_z, {r6("max((ln(1 + count) - mean) / (std + 1e-6))")} as max_z
from fx_counts cross join stats group by gene_index""")
def p11(t: Tables):
    return clean.zscore_log1p(t.counts, long_stats(t.entries, "expr")).groupBy("gene_index").agg(
        F.count("*").alias("n"), rounded(F.min("z")).alias("min_z"), rounded(F.avg("z")).alias("mean_z"),
        rounded(F.max("z")).alias("max_z"))


@query("p12_inverse_check", f"""
with {STATS}, b as (select count, abs(exp((ln(1 + count) - mean) / (std + 1e-6) * (std + 1e-6) + mean) - 1 - count) as gap
 from fx_counts cross join stats)
select count(*) as "values", {r6("max(gap)")} as max_abs_error, bool_and(gap <= 1e-4 + 1e-5 * abs(count)) as passed from b""")
def p12(t: Tables):
    return clean.inverse_check(t.counts, long_stats(t.entries, "expr")).withColumn(
        "max_abs_error", rounded(F.col("max_abs_error")))


@query("p13_scale_dose", f"""
with m as (select max(case when split = 'train' then dose_um end) as top from fx_labelled),
 d as (select pair_id, split, ln(1 + dose_um) / ln(1 + top) as s from fx_labelled cross join m)
select pair_id, split, {r6("s")} as dose_scaled, s > 0 and s <= 1 as dose_in_range from d""")
def p13(t: Tables):
    return clean.scale_dose(t.labelled).select(
        "pair_id", "split", rounded(F.col("dose_scaled")).alias("dose_scaled"), "dose_in_range")


@query("p14_featurize", f"""
with v as (select drug, row_number() over (order by drug) - 1 as drug_id from (select distinct drug from fx_labelled) d),
 s as (select avg(log10(dose_um)) as mean, stddev_pop(log10(dose_um)) as std from fx_labelled where split = 'train'),
 f as (select c.pair_id, x.i, case when x.i = (select count(*) from v) then (log10(c.dose_um) - s.mean) / s.std
   when x.i = v.drug_id then 1.0 else 0.0 end as value
  from fx_labelled c join v on c.drug = v.drug cross join s
  cross join (select unnest(range(0, (select count(*) from v) + 1)) as i) x)
select pair_id, i, {r6("value")} as value from f""")
def p14(t: Tables):
    rows = clean.featurize(t.labelled, clean.drug_vocabulary(t.labelled))
    return rows.select("pair_id", F.posexplode("features").alias("i", "v")).select(
        "pair_id", F.col("i").cast("long").alias("i"), rounded(F.col("v")).alias("value"))


@query("p15_condition_vectors", f"""
with d as (select label, dim, avg(v) as m from fx_vec_full where label <> 0 group by label, dim)
select c.vec_id, c.label, c.dim as gene, {r6("c.v + d.m * (d.label / 9.0)")} as value
from fx_vec_full c join d on c.dim = d.dim and c.label = d.label
union all select vec_id, label, -1, null from embeddings where label = 0""")
def p15(t: Tables):
    """Rows of label 0 have no drug vector and stay, undefined."""
    vecs = t.vectors.withColumn("v", F.col("embedding"))
    drugs = V.mean_vectors(vecs.where("label <> 0"), ["label"], "v", DIM, "drug_vec").withColumn(
        "dose", F.col("label") / 9.0)
    moved = clean.condition_vectors(vecs.select("vec_id", "label", "v"), drugs, "label", "v", "p")
    return moved.select("vec_id", "label", F.posexplode_outer("p").alias("gene", "x")).select(
        "vec_id", "label", F.coalesce(F.col("gene").cast("long"), F.lit(-1)).alias("gene"), rounded(F.col("x")).alias("value"))


@query("p16_eligible", """
select c.pair_id, c.treated_cells, p.control_cells from fx_conditions c join fx_pools p on c.control_pool_id = p.control_pool_id
where c.treated_cells >= 16 and p.control_cells >= 16 and c.plate <> 'plate2' and c.cell_line_id in ('ASIA', 'EUROPE')""")
def p16(t: Tables):
    rows = t.conditions.join(t.pools.select("control_pool_id", "control_cells"), "control_pool_id").withColumn(
        "eligible", (F.col("plate") != "plate2").cast("int"))
    lines = t.read("region").where(F.col("r_name").isin("ASIA", "EUROPE")).select(F.col("r_name").alias("cell_line_id"))
    return clean.eligible(rows, 16, lines).select("pair_id", "treated_cells", "control_cells")


@query("p17_clamp_nonneg", f"""
select vec_id, {r6("avg(case when v < 0 then 1.0 else 0.0 end)")} as negative_ratio, {r6("sum(greatest(v, 0))")} as clamped_sum,
 {r6("min(greatest(v, 0))")} as clamped_min from fx_vec_full group by vec_id""")
def p17(t: Tables):
    kept = V.nonnegative(F.col("embedding"))
    return t.vectors.select("vec_id", rounded(clean.negative_ratio(F.col("embedding"))).alias("negative_ratio"),
                            rounded(V.total(kept)).alias("clamped_sum"), rounded(F.array_min(kept)).alias("clamped_min"))


@query("p18_project_contract", """
select pair_id as condition_id, cast(treated_cells as smallint) as treated_cached_cell_count, cast(dose_um as real) as dose,
 edge_id from fx_conditions""")
def p18(t: Tables):
    return clean.project_contract(t.conditions, {
        "condition_id": ("pair_id", "string"), "treated_cached_cell_count": ("treated_cells", "smallint"),
        "dose": ("dose_um", "float"), "edge_id": ("edge_id", "string")})


@query("p19_compare_normalisation", f"""
with {STATS}, s2 as (select avg(ln(1 + count)) as m2, stddev_samp(ln(1 + count)) as d2 from fx_counts),
 z as (select abs((ln(1 + count) - mean) / (std + 1e-6) - (ln(1 + count) - m2) / (d2 + 1e-6)) as gap
  from fx_counts cross join stats cross join s2)
select count(*) as "values", {r6("max(gap)")} as max_abs, {r6("avg(gap)")} as mean_abs from z""")
def p19(t: Tables):
    out = clean.compare_normalisation(t.counts, long_stats(t.entries, "expr"), long_stats(t.counts, "count"))
    return out.select("values", rounded(F.col("max_abs")).alias("max_abs"), rounded(F.col("mean_abs")).alias("mean_abs"))


@query("f01_strings", """
select c_custkey, concat('drug=', c_mktsegment, '|pair_id=', cast(c_custkey as varchar)) as label,
 lpad(cast(c_custkey as varchar), 8, '0') as obs_name,
 regexp_replace(concat('ENSG', cast(c_custkey as varchar), '.', cast(c_nationkey as varchar)), '\\.\\d+$', '') as stripped,
 list_contains(string_split('BUILDING|MACHINERY', '|'), c_mktsegment) as listed from customer""")
def f01(t: Tables):
    key = F.col("c_custkey").cast("string")
    return t.read("customer").select(
        "c_custkey", F.concat(F.lit("drug="), "c_mktsegment", F.lit("|pair_id="), key).alias("label"),
        F.lpad(key, 8, "0").alias("obs_name"),
        F.regexp_replace(F.concat(F.lit("ENSG"), key, F.lit("."), F.col("c_nationkey").cast("string")),
                         r"\.\d+$", "").alias("stripped"),
        F.array_contains(F.split(F.lit("BUILDING|MACHINERY"), r"\|"), F.col("c_mktsegment")).alias("listed"))


@query("f02_hashes", """
select o_orderkey, sha256(concat('42|phase|', o_orderstatus, '|', cast(o_orderkey as varchar))) as priority,
 sha256(concat('v1|file=orders|row=', cast(o_orderkey as varchar))) as cell_id from orders""")
def f02(t: Tables):
    return t.read("orders").select(
        "o_orderkey", seeded_hash("phase", F.col("o_orderstatus"), F.col("o_orderkey")).alias("priority"),
        cell_key("v1", locator_text(F.lit("orders"), F.col("o_orderkey"))).alias("cell_id"))


@query("f03_math", f"""
select l_orderkey, l_partkey, l_suppkey, l_linenumber, {r6("ln(1 + l_quantity)")} as a, {r6("exp(l_discount) - 1")} as b,
 {r6("log10(l_extendedprice)")} as c, {r6("sqrt(l_quantity)")} as d, cast(ceil(l_extendedprice / 1000) as bigint) as e,
 {r6("abs(l_discount - l_tax)")} as f from lineitem""")
def f03(t: Tables):
    return t.read("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", rounded(F.log1p("l_quantity")).alias("a"),
        rounded(F.expm1("l_discount")).alias("b"), rounded(F.log10("l_extendedprice")).alias("c"),
        rounded(F.sqrt("l_quantity")).alias("d"), F.ceil(F.col("l_extendedprice") / 1000).alias("e"),
        rounded(F.abs(F.col("l_discount") - F.col("l_tax"))).alias("f"))


@query("f04_vectors", f"""
select a.vec_id, {r6("sqrt(sum(a.v * a.v))")} as l2, {r6("sum(abs(a.v))")} as l1,
 {r6("sum(a.v * c.m) / greatest(sqrt(sum(a.v * a.v)) * sqrt(sum(c.m * c.m)), 1e-12)")} as cos,
 {r6("sqrt(sum((a.v - c.m) * (a.v - c.m)))")} as dist, {r6("avg(a.v)")} as mean
from fx_vec_full a join (select dim, avg(v) as m from fx_vec_full group by dim) c on a.dim = c.dim group by a.vec_id""")
def f04(t: Tables):
    center = V.mean_vectors(t.vectors, [], "embedding", DIM, "m").scalar()
    v, m = F.col("embedding"), F.col("m")
    return t.vectors.withColumn("m", center).select(
        "vec_id", rounded(V.l2_norm(v)).alias("l2"), rounded(V.total(F.transform(v, F.abs))).alias("l1"),
        rounded(V.cosine(v, m)).alias("cos"), rounded(V.l2_distance(v, m)).alias("dist"),
        rounded(V.total(v) / F.size(v)).alias("mean"))


@query("f04_mean_pooling", f"""
select vec_id, k as dim, {r6("avg(v)")} as value from (select vec_id, dim % 16 as k, v from fx_vec_full) f group by vec_id, k""")
def f04_pool(t: Tables):
    """Each vector is a [4, 16] token matrix; pooling averages the tokens inside the row."""
    pooled = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: V.total(F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda r: F.element_at("embedding", r * 16 + k))) / 4)
    return t.vectors.select("vec_id", F.posexplode(pooled).alias("dim", "v")).select(
        "vec_id", F.col("dim").cast("long").alias("dim"), rounded(F.col("v")).alias("value"))


@query("f05_lookup", "select p.p_partkey, coalesce(g.gene_index, -1) as gene_index from part p left join fx_genes g on p.p_partkey = g.token_id")
def f05(t: Tables):
    return t.read("part").select("p_partkey").join(
        t.genes.select("token_id", "gene_index"), F.col("p_partkey") == F.col("token_id"), "left").select(
        "p_partkey", F.coalesce("gene_index", F.lit(-1)).alias("gene_index"))


@query("f06_json", """
select event_id, cast(json_extract_string(props, '$.k') as bigint) as k,
 concat('{"k":', json_extract_string(props, '$.k'), ',"missing":null}') as text from events""")
def f06(t: Tables):
    parsed = F.from_json("props", "k long")
    return t.read("events").select("event_id", parsed.getField("k").alias("k"), F.to_json(
        F.struct(parsed.getField("k").alias("k"), defined(F.lit(float("nan"))).alias("missing")),
        {"ignoreNullFields": "false"}).alias("text"))


@query("f07_undefined", f"""
select l_returnflag, count(*) as n, count(case when l_discount > 0 then 1 end) as defined_n,
 {r6("avg(case when l_discount > 0 then l_tax / l_discount end)")} as mean_ratio from lineitem group by l_returnflag""")
def f07(t: Tables):
    ratio = F.when(F.col("l_discount") > 0, F.col("l_tax") / F.col("l_discount")).otherwise(F.lit(float("nan")))
    rows = t.read("lineitem").select("l_returnflag", defined(ratio).alias("ratio"))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("ratio").alias("defined_n"),
                                            rounded(F.avg("ratio")).alias("mean_ratio"))


@query("f08_predicates", """
select vec_id, list_bool_and(list_transform(embedding, lambda x: isfinite(x))) as finite,
 list_bool_or(list_transform(embedding, lambda x: x < 0)) as has_negative,
 list_bool_or(list_transform(embedding, lambda x: x > 0)) as has_positive,
 len(list_distinct(embedding)) < len(embedding) as has_duplicate from embeddings""")
def f08(t: Tables):
    v = F.col("embedding")
    return t.vectors.select("vec_id", V.all_finite(v).alias("finite"), F.exists(v, lambda x: x < 0).alias("has_negative"),
                            F.exists(v, lambda x: x > 0).alias("has_positive"),
                            (F.size(F.array_distinct(v)) < F.size(v)).alias("has_duplicate"))


@query("f07_compact_text", """
select o_orderkey, printf('%.10g', o_totalprice / 7) as a, printf('%.10g', 1.0 / (o_orderkey + 1)) as b from orders""")
def f07_text(t: Tables):
    key = F.col("o_orderkey")
    return t.read("orders").where(is_finite(key.cast("double"))).select(
        "o_orderkey", compact(F.col("o_totalprice") / 7).alias("a"), compact(1.0 / (key + 1)).alias("b"))
