"""Document fingerprints by Order MinHash, with DataFrame operations only.

A text is a sequence of tokens (runs without white space, cut after ``TOKEN`` characters). Its k-mers are ``K`` consecutive tokens,
and equal k-mers are told apart by their occurrence number. Numbered k-mers are hashed into ``BUCKETS`` buckets; of each bucket
the two least are selected, put back into the order they have in the text, and hashed as a tuple. Two texts agree in a
bucket only if they share the selected k-mers in the same order, so the share of agreeing buckets falls with every
edit and every move. Everything happens inside the row, by arrays that are sorted twice; nothing is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellset.llm.common import fresh
from cellset.operators.scale import settled, with_previous
from cellset.session import materialize

TOKEN = 16
K = 2
#: A power of two; bits of a bucket and of a tuple hash fill a 32-bit entry.
BUCKETS = 64
BUCKET_BITS = 6


def with_signature(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the array ``name`` of 32-bit entries, one per filled bucket: bucket number and tuple hash.

    Each step is settled before the next one reads it, as an expression inside a lambda is evaluated for each element. Texts
    without tokens (NULL too) have no entries; one of fewer than ``K`` tokens has one k-mer of all.
    """
    step = fresh(df, f"{name}_a", f"{name}_b", f"{name}_c", f"{name}_d")
    a, b, c, d = step
    grams = ", ".join(f"get({a}, i + {j})" for j in range(K))
    df = df.withColumn(a, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]{1,%d}" % TOKEN), F.lit(0)))
    df = settled(df, a)
    # k-mers with their places, equal ones side by side in the order of the text
    df = df.withColumn(b, F.when(F.size(a) > 0, F.sort_array(F.expr(
        f"transform(sequence(0, greatest(size({a}) - {K}, 0)), i -> struct(xxhash64({grams}) as h, i as p))")))).drop(a)
    df = settled(df, b)
    df = df.withColumn(c, F.expr(f"filter(sequence(0, size({b}) - 1), j -> j = 0 or {b}[greatest(j - 1, 0)].h <> {b}[j].h)"))
    df = settled(df, c)
    # runs of equal k-mers: the place in the run is the occurrence number
    numbered = f"""flatten(transform({c}, (s, r) -> transform(slice({b}, s + 1, coalesce(get({c}, r + 1), size({b})) - s),
        (x, o) -> struct(xxhash64(x.h, o) as g, x.p as p, x.h as h))))"""
    df = df.withColumn(d, F.sort_array(F.expr(numbered))).drop(b, c)
    df = settled(df, d)
    bucket = f"shiftright({{}}, {64 - BUCKET_BITS})"
    kept = f"filter({d}, (x, j) -> j < 2 or {bucket.format('x.g')} <> {bucket.format(f'{d}[greatest(j - 2, 0)].g')})"
    df = settled(df.withColumn(d, F.expr(kept)), d)
    heads = f"""filter(transform({d}, (x, j) -> struct(j = 0 or {bucket.format('x.g')} <> {bucket.format(f'{d}[greatest(j - 1, 0)].g')} as head,
        x as x, case when {bucket.format(f'get({d}, j + 1).g')} = {bucket.format('x.g')} then get({d}, j + 1) end as y)), t -> t.head)"""
    # entry: bucket number in the high bits, tuple hash of the selected k-mers in text order in the low ones
    entry = f"""cast(shiftleft({bucket.format('t.x.g')}, {32 - BUCKET_BITS}) | (xxhash64(
        if(t.y is null or t.x.p < t.y.p, t.x.h, t.y.h), if(t.y is null or t.x.p < t.y.p, t.y.h, t.x.h)) & {(1 << (32 - BUCKET_BITS)) - 1})
        as int)"""
    df = df.withColumn(name, F.expr(f"transform({heads}, t -> {entry})")).drop(d)
    return settled(df, name).withColumn(name, F.coalesce(name, F.array().cast("array<int>")))


def fingerprint(signature: str) -> Column:
    """Signature as text: eight hex digits per entry; empty for a text without tokens."""
    return F.array_join(F.transform(F.col(signature), lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Share of agreeing buckets among those that either text fills; 1 if neither fills any."""
    number = lambda c: F.transform(F.col(c), lambda x: F.shiftright(x, 32 - BUCKET_BITS))
    filled = F.size(F.array_union(number(a), number(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(filled, F.lit(1)))


def ring(docs: DataFrame) -> DataFrame:
    """``id, key, n, next_id, next_key``: the document after each one by descending id (NULL last), then key; last to first."""
    known = materialize(docs.select("id", "key", "n").distinct().withColumn("me", F.struct("id", "key")))
    follow = with_previous(known, [F.col("id").asc_nulls_first(), "key"], "me", "after")
    first = known.agg(F.max("me")).scalar()
    return materialize(follow.withColumn("after", F.coalesce("after", first)).select(
        "id", "key", "n", F.col("after.id").alias("next_id"), F.col("after.key").alias("next_key")))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, fingerprint, next_id, near_next`` and the same for the edited text, one row per row of ``df``.

    The edited text has its last third (rounded down) of characters replaced by the first as many, or all, of the next
    document by descending id. NULL texts count as empty. Documents are told apart by id and text: rows equal in both are
    one document and get equal results. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    order = ring(docs.withColumn("n", F.length("text").cast("long")))
    signed = with_signature(docs, "text", "sig")
    # every document gives the first characters of its text to the one before it
    asked = order.select(F.col("id").alias("to_id"), F.col("key").alias("to_key"), F.floor(F.col("n") / 3).cast("int").alias("k"),
                         "next_id", "next_key")
    given = signed.join(asked, signed["id"].eqNullSafe(asked["next_id"]) & (signed["key"] == asked["next_key"])).select(
        "to_id", "to_key", "next_id", "k", F.expr("substring(text, 1, k)").alias("head"), F.col("sig").alias("next_sig"))
    given = given.groupBy("to_id", "to_key").agg(F.first(F.struct("next_id", "k", "head", "next_sig")).alias("g")).select(
        "to_id", "to_key", "g.*")
    both = signed.join(given, signed["id"].eqNullSafe(given["to_id"]) & (signed["key"] == given["to_key"])).select(
        "id", "sig", "next_id", "next_sig", F.length("text").cast("long").alias("n_chars"),
        F.concat(F.expr("substring(text, 1, length(text) - k)"), "head").alias("edited"))
    edited = with_signature(settled(both, "edited"), "edited", "edited_sig")
    return edited.select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("sig").alias("fingerprint"), fingerprint("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))
