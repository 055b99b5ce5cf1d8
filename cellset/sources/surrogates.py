"""The cell data model expressed over the given tables, as Spark frames and as DuckDB view text.

orders/customer/nation/region give cells with condition metadata, lineitem their long count entries, part the
feature vocabulary, documents the ragged cells (one document row = one cell, its words = its entries), and
embeddings the vectors.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellset.functions.vectors import difference, mean_vectors
from cellset.operators.scale import dense_index, settled, spread
from cellset.session import materialize

PANEL = 20  # fixed value: panel width
DIM = 64    # fixed value: width of embeddings.embedding
TOKENS = 1000  # fixed value: number of distinct token ids a word can have
REPEATS = 5  # fixed value: evaluation repeats
SET_SIZE, POOL_CAP = 16, 32  # fixed values: cells per set and control cells per pool on these tables


class Tables:
    """Surrogate views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def cells(self) -> DataFrame:
        """One row per cell with its condition metadata."""
        vehicle = F.col("o_orderpriority") == "5-LOW"
        dose = (F.when(F.col("o_orderpriority") == "1-URGENT", 5.0).when(F.col("o_orderpriority") == "2-HIGH", 0.5)
                .when(F.col("o_orderpriority") == "3-MEDIUM", 0.05).when(vehicle, 0.0))
        return (self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
                .join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
                .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
                .select(F.col("o_orderkey").alias("cell_id"),
                        F.when(vehicle, "DMSO").otherwise(F.col("c_mktsegment")).alias("drug"),
                        F.col("r_name").alias("cell_line_id"),
                        F.when(F.col("o_orderstatus") == "F", "plate6").when(F.col("o_orderstatus") == "O", "plate14")
                        .otherwise("plate2").alias("plate"),
                        dose.alias("dose_um"),
                        F.concat(F.lit("s"), (F.col("o_orderkey") % 4).cast("string")).alias("sample_id"),
                        vehicle.cast("int").alias("owner_type")))

    @cached_property
    def entries(self) -> DataFrame:
        """Long counts: ``cell_id, token_id, expr``."""
        return self.read("lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("token_id"),
                                            F.col("l_quantity").cast("double").alias("expr"))

    @cached_property
    def genes(self) -> DataFrame:
        """Vocabulary. Part keys run from 0 and every tenth is left out, so the sorted position has a closed form."""
        key = F.col("p_partkey")
        return self.read("part").where(key % 10 != 9).select(
            key.alias("token_id"), F.col("p_name").alias("gene_symbol"),
            F.concat(F.lit("ENSG"), F.lpad(key.cast("string"), 11, "0")).alias("ensembl_id"),
            (key - F.floor(key / 10)).alias("gene_index"))

    @cached_property
    def panel(self) -> DataFrame:
        return self.genes.where(F.col("gene_index") < PANEL).select(
            F.col("gene_index").alias("panel_rank"), "gene_index", "token_id")

    @cached_property
    def counts(self) -> DataFrame:
        """Long counts of mapped genes: ``cell_id, gene_index, count``."""
        return self.entries.join(self.genes.select("token_id", "gene_index"), "token_id").select(
            "cell_id", "gene_index", F.col("expr").alias("count"))

    @cached_property
    def conditions(self) -> DataFrame:
        """A derived dimension, written once because most queries read it several times."""
        treated = self.cells.where((F.col("owner_type") == 0) & F.col("dose_um").isNotNull())
        return materialize(treated.groupBy("cell_line_id", "drug", "dose_um", "plate").agg(
            F.count("*").alias("treated_cells")).select(
            "cell_line_id", "drug", "dose_um", "plate", F.concat_ws("|", "cell_line_id", "drug").alias("edge_id"),
            F.concat_ws("|", "cell_line_id", "plate").alias("control_pool_id"),
            F.concat_ws("|", "cell_line_id", "drug", "plate", F.col("dose_um").cast("string")).alias("pair_id"),
            "treated_cells"))

    @cached_property
    def pools(self) -> DataFrame:
        return self.cells.where("owner_type = 1").groupBy("cell_line_id", "plate").agg(
            F.count("*").alias("control_cells")).select(
            F.concat_ws("|", "cell_line_id", "plate").alias("control_pool_id"), "cell_line_id", "plate",
            "control_cells")

    @cached_property
    def splits(self) -> DataFrame:
        """Train/val/test by edge; line and drug positions come from the (few) distinct names."""
        edges = self.conditions.select("edge_id", "cell_line_id", "drug").distinct()
        lines = edges.agg(F.array_sort(F.collect_set("cell_line_id")).alias("a")).scalar()
        drugs = edges.agg(F.array_sort(F.collect_set("drug")).alias("a")).scalar()
        turn = F.pmod(2 * (F.array_position(drugs, F.col("drug")) - 1)
                      + F.array_position(lines, F.col("cell_line_id")) - 1, F.lit(5))
        return edges.select("edge_id", F.when(turn == 4, "test").when(turn == 3, "val")
                            .when(F.col("drug") == "MACHINERY", "val").otherwise("train").alias("split"))

    @cached_property
    def labelled(self) -> DataFrame:
        """Conditions with their split."""
        return self.conditions.join(self.splits, "edge_id")

    @cached_property
    def owned(self) -> DataFrame:
        """Cells with their owner: the condition of a treated cell, the pool of a control cell."""
        owner = F.when(F.col("owner_type") == 0, F.concat_ws("|", "cell_line_id", "drug", "plate",
                                                             F.col("dose_um").cast("string"))).otherwise(
            F.concat_ws("|", "cell_line_id", "plate"))
        return self.cells.where("dose_um is not null").withColumn("owner_id", owner)

    @cached_property
    def indexed(self) -> DataFrame:
        """Owned cells with their contiguous global index: treated owners first, then pools."""
        return dense_index(self.owned, ["owner_type", "owner_id", "cell_id"], "cell_index")

    @cached_property
    def owners(self) -> DataFrame:
        """``owner_type, owner_id, cells``: conditions and pools stacked."""
        return self.owned.groupBy("owner_type", "owner_id").agg(F.count("*").alias("cells"))

    @cached_property
    def ragged(self) -> DataFrame:
        """Ragged cells from documents: parallel token and count lists, some of them malformed on purpose."""
        words = F.col("_words")
        initial = lambda w: F.when(F.length(w) == 0, 0).otherwise(F.ascii(w))
        key = F.col("doc_id")
        genes = F.transform(words, lambda w: F.pmod(initial(w) * 131 + F.length(w) * 17, F.lit(TOKENS)).cast("long"))
        counts = F.transform(words, lambda w, i: F.pmod(F.length(w) * 7 + i, F.lit(5)).cast("float"))
        counts = F.when(key % 83 == 11, F.concat(counts, F.array(F.lit(-1.0).cast("float")))).otherwise(counts)
        genes = F.when(key % 79 == 3, F.slice(genes, 2, F.size(genes))).otherwise(genes)
        genes = F.when(key % 83 == 11, F.concat(genes, F.array(F.lit(1).cast("long")))).otherwise(genes)
        marked = key % 2 == 0
        genes = F.when(marked, F.concat(F.array(F.lit(-1).cast("long")), genes)).otherwise(genes)
        counts = F.when(marked, F.concat(F.array(F.lit(-1.0).cast("float")), counts)).otherwise(counts)
        gone = F.when(key % 89 == 7, F.lit(None)).when(key % 97 == 5, F.slice(genes, 1, 0)).otherwise(genes)
        documents = spread(self.read("documents").select("doc_id", "text", "lang", "source")).withColumn("_words", F.split("text", " "))
        return settled(settled(documents, "_words").select(
            key.alias("cell_id"), gone.alias("genes"), counts.alias("expressions"),
            F.when(key % 3 == 0, "DMSO").otherwise(F.col("source")).alias("drug"),
            F.concat(F.lit("s"), (key % 4).cast("string")).alias("sample"),
            F.when(key % 10 != 0, F.concat(F.lit("bc"), key.cast("string"))).alias("barcode"),
            F.col("lang").alias("cell_line_id"),
            F.when(key % 11 != 0, F.concat(F.lit("plate"), (key % 3).cast("string"))).alias("plate")),
            "genes", "expressions")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select("vec_id", "label", "embedding")

    @cached_property
    def vec_repeats(self) -> DataFrame:
        """Vectors taking part in each repeat (each repeat leaves one fifth out)."""
        repeats = F.explode(F.array(*[F.lit(i) for i in range(REPEATS)])).alias("repeat_epoch")
        return self.vectors.select("vec_id", "label", F.col("embedding").alias("v"), repeats).where(
            F.col("vec_id") % REPEATS != F.col("repeat_epoch"))

    @cached_property
    def deltas(self) -> DataFrame:
        """``repeat_epoch, label, true_delta[64], pred_delta[64]``; the prediction uses the even half.

        All means come from one scan; the table of means is small.
        """
        even = F.col("vec_id") % 2 == 0
        half = F.array(*[F.avg(F.when(even, F.col("v")[i].cast("double"))) for i in range(DIM)])
        means = materialize(mean_vectors(self.vec_repeats, ["repeat_epoch", "label"], "v", DIM, "t", extra={"p": half}))
        control = means.where("label = 0").select("repeat_epoch", F.col("t").alias("c"))
        return means.where("label <> 0").join(control, "repeat_epoch").select(
            "repeat_epoch", "label", difference(F.col("t"), F.col("c")).alias("true_delta"),
            difference(F.col("p"), F.col("c")).alias("pred_delta"))


VIEWS: dict[str, str] = {
    "fx_cells": """
select o.o_orderkey as cell_id,
 case when o.o_orderpriority='5-LOW' then 'DMSO' else c.c_mktsegment end as drug,
 r.r_name as cell_line_id,
 case o.o_orderstatus when 'F' then 'plate6' when 'O' then 'plate14' else 'plate2' end as plate,
 cast(case o.o_orderpriority when '1-URGENT' then 5.0 when '2-HIGH' then 0.5
      when '3-MEDIUM' then 0.05 when '5-LOW' then 0.0 end as double) as dose_um,
 concat('s', cast(o.o_orderkey % 4 as varchar)) as sample_id,
 case when o.o_orderpriority='5-LOW' then 1 else 0 end as owner_type
from orders o join customer c on o.o_custkey=c.c_custkey
 join nation n on c.c_nationkey=n.n_nationkey join region r on n.n_regionkey=r.r_regionkey""",
    "fx_entries": """
select l_orderkey as cell_id, l_partkey as token_id, cast(l_quantity as double) as expr from lineitem""",
    "fx_genes": """
select p_partkey as token_id, p_name as gene_symbol,
 concat('ENSG', lpad(cast(p_partkey as varchar), 11, '0')) as ensembl_id,
 row_number() over (order by p_partkey) - 1 as gene_index
from part where p_partkey % 10 <> 9""",
    "fx_panel": """
select row_number() over (order by gene_index) - 1 as panel_rank, gene_index, token_id
from fx_genes where gene_index < 20""",
    "fx_counts": """
select e.cell_id, g.gene_index, e.expr as count from fx_entries e join fx_genes g on e.token_id=g.token_id""",
    "fx_lib": """
select cell_id, sum(count) as library from fx_counts group by cell_id""",
    "fx_conditions": """
select cell_line_id, drug, dose_um, plate, concat(cell_line_id,'|',drug) as edge_id,
 concat(cell_line_id,'|',plate) as control_pool_id,
 concat(cell_line_id,'|',drug,'|',plate,'|',cast(dose_um as varchar)) as pair_id,
 count(*) as treated_cells
from fx_cells where owner_type=0 and dose_um is not null group by cell_line_id, drug, dose_um, plate""",
    "fx_pools": """
select concat(cell_line_id,'|',plate) as control_pool_id, cell_line_id, plate, count(*) as control_cells
from fx_cells where owner_type=1 group by cell_line_id, plate""",
    "fx_splits": """
select edge_id, case when (2*d+r) % 5 = 4 then 'test' when (2*d+r) % 5 = 3 then 'val'
  when drug='MACHINERY' then 'val' else 'train' end as split
from (select edge_id, drug, dense_rank() over (order by cell_line_id)-1 as r, dense_rank() over (order by drug)-1 as d
      from (select distinct edge_id, cell_line_id, drug from fx_conditions) e) i""",
    "fx_labelled": """
select c.*, s.split from fx_conditions c join fx_splits s on c.edge_id=s.edge_id""",
    "fx_owned": """
select *, case when owner_type = 0 then concat(cell_line_id,'|',drug,'|',plate,'|',cast(dose_um as varchar))
  else concat(cell_line_id,'|',plate) end as owner_id from fx_cells where dose_um is not null""",
    "fx_indexed": """
select *, row_number() over (order by owner_type, owner_id, cell_id) - 1 as cell_index from fx_owned""",
    "fx_ranges": """
select owner_type, owner_id, cells, cast(sum(cells) over (order by owner_type, owner_id) - cells as bigint) as start,
 cast(sum(cells) over (order by owner_type, owner_id) as bigint) as stop
from (select owner_type, owner_id, count(*) as cells from fx_owned group by owner_type, owner_id) o""",
    "fx_cand": """
select l.*, p.control_cells, concat(l.cell_line_id, '|', cast(l.dose_um as varchar)) as stratum
from fx_labelled l join fx_pools p on l.control_pool_id = p.control_pool_id
where l.treated_cells >= 16 and p.control_cells >= 16 and l.drug in (select drug from fx_labelled where split = 'train')""",
    "fx_quota": """
select split, stratum, total // n + case when r <= total % n then 1 else 0 end as quota
from (select split, stratum, row_number() over (partition by split order by sha256(concat('42|stratum|', stratum))) as r,
  count(*) over (partition by split) as n, case split when 'train' then 60 when 'val' then 15 else 20 end as total
 from fx_cand group by split, stratum) s""",
    "fx_options": """
select split, drug, stratum, arg_min(pair_id, pick) as pair_id, min(pick) as pick, count(*) as n
from (select *, sha256(concat('42|required-pick|', split, '|', drug, '|', pair_id)) as pick from fx_cand) c
group by split, drug, stratum""",
    "fx_drug_order": """
select split, drug, row_number() over (partition by split order by sum(n), sha256(concat('42|required-drug|', split, '|', drug))) as k
from fx_options group by split, drug""",
    "fx_picks": """
select split, cast(0 as bigint) as k, cast([] as varchar[]) as used, cast(null as varchar) as pair_id from (select distinct split from fx_cand) s
union all
select o.split, o.k + 1, list_append(o.used, arg_min(o.stratum, o.key)), arg_min(o.pair_id, o.key)
from (select p.split, p.k, p.used, o.stratum, o.pair_id,
   concat(lpad(cast(1000 - (q.quota - len(list_filter(p.used, lambda x: x = o.stratum))) as varchar), 6, '0'), o.pick) as key
  from fx_picks p join fx_drug_order d on d.split = p.split and d.k = p.k + 1
  join fx_options o on o.split = d.split and o.drug = d.drug join fx_quota q on q.split = o.split and q.stratum = o.stratum
  where q.quota > len(list_filter(p.used, lambda x: x = o.stratum))) o group by o.split, o.k, o.used""",
    "fx_rounds": """
select c.*, q.quota - (select count(*) from fx_picks f join fx_cand g on g.pair_id = f.pair_id
   where g.split = c.split and g.stratum = c.stratum) as need,
 row_number() over (partition by c.split, c.stratum, drug order by sha256(concat('42|condition|', c.split, '|', pair_id))) - 1 as dr,
 row_number() over (partition by c.split, c.stratum, control_pool_id order by sha256(concat('42|condition|', c.split, '|', pair_id))) - 1 as cr
from fx_cand c join fx_quota q on q.split = c.split and q.stratum = c.stratum
where c.pair_id not in (select pair_id from fx_picks where pair_id is not null)""",
    "fx_selected": """
select pair_id from fx_picks where pair_id is not null union all
select pair_id from (select pair_id, need, row_number() over (partition by split, stratum order by greatest(dr, cr), dr, cr,
  sha256(concat('42|condition|', split, '|', pair_id))) as place from fx_rounds) r where place <= need""",
    "fx_chosen": """
select c.*, row_number() over (order by case split when 'train' then 1 when 'val' then 2 else 3 end, cell_line_id, dose_um, plate, pair_id) - 1
 as condition_index from fx_cand c where pair_id in (select pair_id from fx_selected)""",
    "fx_chosen_pools": """
select p.*, row_number() over (order by plate, cell_line_id, control_pool_id) - 1 as control_pool_index,
 least(control_cells, 32) as cached_cells from fx_pools p where control_pool_id in (select control_pool_id from fx_chosen)""",
    "fx_chosen_ranges": """
select owner_type, owner_index, cast(sum(cells) over (order by owner_type, owner_index) - cells as bigint) as start,
 cast(sum(cells) over (order by owner_type, owner_index) as bigint) as stop
from (select 0 as owner_type, condition_index as owner_index, treated_cells as cells from fx_chosen
 union all select 1, control_pool_index, cached_cells from fx_chosen_pools) o""",
    "fx_words": """
select doc_id, lang, source, string_split(text, ' ') as w from documents""",
    "fx_ragged_a": """
select doc_id, lang, source,
 list_transform(w, lambda x: cast((case when length(x)=0 then 0 else unicode(x) end * 131 + length(x) * 17) % 1000 as bigint)) as g,
 list_transform(range(1, len(w) + 1), lambda i: cast((length(w[i]) * 7 + i - 1) % 5 as double)) as e from fx_words""",
    "fx_ragged_b": """
select doc_id, lang, source,
 case when doc_id % 83 = 11 then list_append(case when doc_id % 79 = 3 then g[2:] else g end, 1)
      else case when doc_id % 79 = 3 then g[2:] else g end end as g,
 case when doc_id % 83 = 11 then list_append(e, -1.0) else e end as e from fx_ragged_a""",
    "fx_ragged": """
select doc_id as cell_id,
 case when doc_id % 89 = 7 then null when doc_id % 97 = 5 then cast([] as bigint[])
      when doc_id % 2 = 0 then list_prepend(-1, g) else g end as genes,
 case when doc_id % 2 = 0 then list_prepend(-1.0, e) else e end as expressions,
 case when doc_id % 3 = 0 then 'DMSO' else source end as drug,
 concat('s', cast(doc_id % 4 as varchar)) as sample,
 case when doc_id % 10 <> 0 then concat('bc', cast(doc_id as varchar)) end as barcode,
 lang as cell_line_id,
 case when doc_id % 11 <> 0 then concat('plate', cast(doc_id % 3 as varchar)) end as plate
from fx_ragged_b""",
    "fx_stripped": """
select cell_id, drug, sample, barcode, cell_line_id, plate,
 case when expressions[1] < 0 then genes[2:] else genes end as genes,
 case when expressions[1] < 0 then expressions[2:] else expressions end as expressions,
 coalesce(expressions[1] < 0, false) as had_sentinel
from fx_ragged where genes is not null and expressions is not null and len(genes) > 0 and len(expressions) > 0""",
    "fx_clean": """
select * from fx_stripped where len(genes) > 0 and len(genes) = len(expressions)
 and len(list_filter(expressions, lambda x: x < 0)) = 0""",
    "fx_ragged_long": """
select cell_id, genes[i] as token_id, expressions[i] as expr, i - 1 as pos
from (select cell_id, genes, expressions, unnest(range(1, len(genes) + 1)) as i from fx_clean)""",
    "fx_mapped_long": """
select e.cell_id, g.gene_index, e.expr as count, e.pos from fx_ragged_long e join fx_genes g on e.token_id=g.token_id""",
    "fx_mapped_lib": """
select cell_id, sum(count) as library from fx_mapped_long group by cell_id having sum(count) > 0""",
    "fx_vec_long": """
select vec_id, label, i-1 as gene, cast(embedding[i] as double) as v
from (select vec_id, label, embedding, unnest(range(1,65)) as i from embeddings)""",
    "fx_vec_full": """
select vec_id, label, i-1 as dim, cast(embedding[i] as double) as v
from (select vec_id, label, embedding, unnest(range(1,65)) as i from embeddings)""",
    "fx_repeats": """
select unnest(range(0, 5)) as repeat_epoch""",
    "fx_delta": """
select r.repeat_epoch, f.label, f.gene, avg(f.v) - max(k.cv) as true_delta,
 avg(case when f.vec_id % 2 = 0 then f.v end) - max(k.cv) as pred_delta
from fx_vec_long f cross join fx_repeats r
join (select q.repeat_epoch, g.gene, avg(g.v) as cv from fx_vec_long g cross join fx_repeats q
      where g.label=0 and g.vec_id % 5 <> q.repeat_epoch group by q.repeat_epoch, g.gene) k
  on k.repeat_epoch=r.repeat_epoch and k.gene=f.gene
where f.label<>0 and f.vec_id % 5 <> r.repeat_epoch
group by r.repeat_epoch, f.label, f.gene""",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of the views it uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if body is not text and name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    # "recursive" is allowed whether or not a view refers to itself
    head = ",\n".join(f"{name} as ({VIEWS[name]})" for name in needed)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with recursive {head},\n{body[5:]}"
    return f"with recursive {head}\n{body}"
