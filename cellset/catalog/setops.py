"""Set operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellset.catalog.registry import query
from cellset.operators import setops as O
from cellset.sources.surrogates import Tables


@query("o01_union_all", """
select pair_id, split from fx_labelled where split = 'train' union all select pair_id, split from fx_labelled where split = 'val'
union all select pair_id, split from fx_labelled where split = 'test'""")
def o01(t: Tables):
    rows = t.labelled.select("pair_id", "split")
    return O.union_all(*[rows.where(F.col("split") == s) for s in ("train", "val", "test")])


@query("o02_missing", "select o_orderkey from orders except select l_orderkey from lineitem")
def o02(t: Tables):
    return O.missing(t.read("orders").select("o_orderkey"),
                     t.read("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("o03_overlap", """
select drug, string_agg(split, ',' order by split) as found_in from (select distinct drug, split from fx_labelled) d
group by drug having count(*) > 1""")
def o03(t: Tables):
    return O.overlap(t.labelled, "drug", "split")


@query("o03_intersection", "select l_suppkey as key from lineitem intersect select s_suppkey from supplier")
def o03_both(t: Tables):
    return O.intersection(t.read("lineitem").select(F.col("l_suppkey").alias("key")),
                          t.read("supplier").select(F.col("s_suppkey").alias("key")), "key")


@query("o04_duplicates", """
select l_orderkey, l_partkey, count(*) as copies from lineitem group by l_orderkey, l_partkey having count(*) > 1""")
def o04(t: Tables):
    return O.duplicates(t.read("lineitem"), ["l_orderkey", "l_partkey"])


@query("o05_set_relation", """
with a as (select distinct l_orderkey as k from lineitem), b as (select distinct o_orderkey as k from orders),
 f as (select a.k as x, b.k as y from a full outer join b on a.k = b.k)
select count(x) as first, count(y) as second, count(case when y is null then 1 end) as only_first,
 count(case when x is null then 1 end) as only_second,
 count(case when y is null then 1 end) = 0 and count(case when x is null then 1 end) = 0 as equal,
 count(case when y is null then 1 end) = 0 as subset from f""")
def o05(t: Tables):
    return O.set_relation(t.read("lineitem").select(F.col("l_orderkey").alias("k")),
                          t.read("orders").select(F.col("o_orderkey").alias("k")), "k")
