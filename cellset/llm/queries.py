"""Registered queries of the subpackage, each over whole tables, and their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellset.llm import katz
from cellset.llm.chat import TURN_END, TURN_START, formatted_chats
from cellset.llm.exact_dup import marked_copies
from cellset.llm.licenses import PERCENT as LICENSE_PERCENT
from cellset.llm.licenses import TEMPLATES, license_lines
from cellset.llm.mixing import mixed
from cellset.llm.near_dup import marked_near_copies
from cellset.llm.order_minhash import fingerprints
from cellset.llm.packing import packed_documents
from cellset.llm.quality import scored
from cellset.llm.resampling import resampled
from cellset.llm.substrings import text_sha256, without_repeats
from cellset.llm.token_store import stored_documents
from cellset.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, coded

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return table.select(*columns) if columns else table


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_copies(documents(spark, sf_dir, "doc_id", "text"), carry=["doc_id"])


OP10_SQL = f"""
with d as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
 doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from d"""



def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir, "doc_id", "text"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(documents(spark, sf_dir, "doc_id", "text", "source"), carry=["doc_id"])
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_lines(documents(spark, sf_dir, "doc_id", "text"))


def lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def grams_sql(text: str) -> str:
    """DuckDB list of the distinct word bigrams of a normalised text."""
    words = f"string_split(trim(regexp_replace({lowered(text)}, '[^0-9a-z]+', ' ', 'g')), ' ')"
    return f"list_distinct([concat({words}[i], ' ', {words}[i + 1]) for i in range(1, len({words}))])"


OP2_SQL = f"""
with t(license, template) as (values {', '.join(f"('{n}', '{x}')" for n, x in TEMPLATES)}),
tg as (select license, {grams_sql('template')} as tg from t),
l as (select doc_id, string_split(text, chr(10)) as lines from documents where text is not null),
u as (select doc_id, unnest(range(0, len(lines))) as line, unnest(lines) as said from l),
g as (select doc_id, line, {grams_sql('said')} as g from u),
m as (select doc_id, line, license, 2.0::double * len(list_intersect(g, tg)) / (len(g) + len(tg)) as dice,
  200 * len(list_intersect(g, tg)) >= {LICENSE_PERCENT} * (len(g) + len(tg)) as hit
  from g join tg on len(g) > 0 and 2 * least(len(g), len(tg)) * 100 >= {LICENSE_PERCENT} * (len(g) + len(tg)))
select doc_id, line, license, dice from m where hit
qualify row_number() over (partition by doc_id, line order by dice desc, license) = 1"""


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP5_SQL = f"""
with c as (select conv_id, count(*) as n, list(struct_pack(role := role, said := text) order by turn, role, text) as turns
  from conversations where conv_id is not null group by conv_id),
k as (select min(conv_id) as conv_id, n, turns, count(*) as n_copies from c group by n, turns)
select conv_id, n as n_turns, n_copies, list_aggregate([concat('{TURN_START}', coalesce(t.role, 'user'), chr(10),
  coalesce(t.said, ''), '{TURN_END}', chr(10)) for t in turns], 'string_agg', '') as rendered
from k where not exists (select 1 from c longer where longer.n > k.n and longer.turns[1] = k.turns[1] and longer.turns[1:k.n] = k.turns)"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return scored(documents(spark, sf_dir, "doc_id", "text"), labels)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked_near_copies(documents(spark, sf_dir, "doc_id", "text"))
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op6_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scored(documents(spark, sf_dir, "doc_id", "text"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir, "doc_id", "text"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", text_sha256("kept_text").alias("kept_sha256"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_documents(documents(spark, sf_dir, "doc_id", "text")).withColumnRenamed("id", "doc_id")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampled(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return rows.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op12_sql() -> str:
    """Every part against every entry of its codebook, round after round; doubles hold the integers exactly."""
    texts = [f"""with v as (select row_number() over () as r, vec_id, label, [floor({SCALE} * x::double) for x in embedding] as q
  from embeddings where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
x as (select r, vec_id, q, p, q[p * len(q) // {PARTS} + 1:(p + 1) * len(q) // {PARTS}] as part from v, range({PARTS}) t(p)),
c0 as (select p, e, part as entry from (select p, part, row_number() over (partition by p order by vec_id, q) - 1 as e from x) where e < {ENTRIES})"""]
    for i in range(ROUNDS + 1):
        texts.append(f"""a{i} as (select r, p, part, min(struct_pack(d := list_inner_product(part, part) + list_inner_product(entry, entry)
  - 2 * list_inner_product(part, entry), e := e)) as best from x join c{i} using (p) group by r, p, part)""")
        if i < ROUNDS:
            texts.append(f"""u{i} as (select p, best.e as e, k, floor(sum(part[k]) / count(*)) as m from (select *, unnest(range(1, len(part) + 1)) as k from a{i})
  group by p, best.e, k),
m{i} as (select p, e, list(m order by k) as entry from u{i} group by p, e),
c{i + 1} as (select p, e, coalesce(m.entry, c.entry) as entry from c{i} c left join m{i} m using (p, e))""")
    texts.append(f"""o as (select r, string_agg(lower(lpad(to_hex(best.e), 2, '0')), '' order by p) as code, cast(sum(best.d) as bigint) as error
  from a{ROUNDS} group by r),
h as (select sha256(string_agg(cast(m as bigint)::varchar, ',' order by p, e, k)) as s from
  (select p, e, unnest(entry) as m, unnest(range(len(entry))) as k from c{ROUNDS}))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, (select s from h) as codebooks_sha256
from v join o using (r)""")
    return ",\n".join(texts)


OP8_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
  (cast(concat('0x', substr(md5(concat('mix|', doc_id)), 1, 13)) as bigint) + 0.5::double) / 4503599627370496.0::double as u from documents),
s as (select source, cast(sum(size) as bigint) as source_size,
  (row_number() over (order by source is null, source) - 1) % 3 + 1 as weight from d group by source),
o as (select *, row_number() over (order by (3 * source_size)::double / weight, source is null, source) as place from s),
c as (select *, coalesce(sum(3 * source_size) over before, 0) as caps, coalesce(sum(weight) over before, 0) as weights from o
  window before as (order by place rows between unbounded preceding and 1 preceding)),
l as (select max(((select sum(source_size) from s) - caps)::double / ((select sum(weight) from s) - weights)::double) as level from c),
t as (select source, source_size, least((3 * source_size)::double, level * weight) as target from s, l),
r as (select *, case when source_size > 0 then target / source_size else 0.0::double end as ratio from t),
w as (select source, source_size, target, floor(ratio) as whole, ratio - floor(ratio) as share from r),
k as (select d.doc_id, d.size, w.*, case when share > 0 and size > 0 then (u / (1 - u)) / (share / (1 - share)) end as key
  from d join w on d.source is not distinct from w.source),
b as (select *, coalesce(sum(case when key is not null then size else 0 end) over (partition by source order by key nulls last, doc_id
  rows between unbounded preceding and 1 preceding), 0) as before from k),
f as (select *, target - whole * source_size as rest, key is not null and before + size <= target - whole * source_size as fits from b),
g as (select *, rest - coalesce(sum(case when fits then size else 0 end) over (partition by source), 0) as gap from f),
h as (select *, case when key is not null and not fits and abs(size - gap) < gap then abs(size - gap) end as miss from g),
e as (select *, row_number() over (partition by source order by miss nulls last, key nulls last, doc_id) as place from h)
select doc_id, size, source_size, target,
 cast(size * (whole + case when fits or miss is not null and place = 1 then 1 else 0 end) as bigint) as taken from e"""

QUERIES = {
    "op1_pack": op1_pack,
    "op2_license_scan": op2_license_scan,
    "op3_near_dedup": op3_near_dedup,
    "op4_quality": op4_quality,
    "op5_chat_format": op5_chat_format,
    "op6_katz_score": op6_katz_score,
    "op7_fingerprint": op7_fingerprint,
    "op8_mix": op8_mix,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_token_files": op11_token_files,
    "op12_vector_codes": op12_vector_codes,
    "op13_resample": op13_resample,
}
ORACLES = {
    "op2_license_scan": OP2_SQL,
    "op5_chat_format": OP5_SQL,
    "op8_mix": OP8_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op12_vector_codes": op12_sql(),
}
