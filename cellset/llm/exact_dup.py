"""Exact deduplication with a split for heavy hitters.

Texts are equal when they are identical after lower-casing A-Z; they are compared by SHA-256. A Misra-Gries summary of
``counters`` entries per task finds every digest that may hold more than ``2 / (counters + 1)`` of the rows. At most
``counters`` candidates can pass the test on the merged summaries, whatever the input's size, so they may be broadcast:
their exact size and winner are counted (with partial aggregation), and their losing rows are settled in the scan's
own tasks. Only the other digests, none of them frequent, are shuffled.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellset.llm.common import ascii_lower, byte_text, fresh, in_small_batches, texts_of
from cellset.session import materialize

COUNTERS = 4096


@F.arrow_udf(T.BinaryType())
def text_digest(text: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(ascii_lower(x)).digest() for x in texts_of(text)], pa.binary())


def summarise(counters: int):
    """Misra-Gries over one task; a NULL key carries the number of rows."""
    def run(iterator):
        kept, rows = Counter(), 0
        for batch in iterator:
            rows += batch.num_rows
            kept.update(batch.column(0).to_pylist())
            if len(kept) > counters:
                least = sorted(kept.values(), reverse=True)[counters]
                kept = Counter({k: v - least for k, v in kept.items() if v > least})
        yield pa.RecordBatch.from_arrays([pa.array([*kept, None], pa.binary()),
                                          pa.array([*kept.values(), rows], pa.int64())], ["key", "n"])
    return run


def heavy_candidates(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``key`` of every digest that may be frequent: at most ``counters`` rows (their estimates sum to all rows at most).

    ``digests`` has one binary column without NULL.
    """
    merged = digests.mapInArrow(summarise(counters), "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    merged = materialize(merged)
    rows = merged.where("key is null").agg(F.sum("n")).scalar()
    return merged.where("key is not null").where(F.col("n") * (counters + 1) > rows).select("key")


def marked_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
                  counters: int = COUNTERS, drop: bool = False) -> DataFrame:
    """Rows of ``df`` (or their ``carry`` columns) with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Of equal texts the row with the largest id stays. With ``drop`` only the rows that stay are returned, and losing
    copies of frequent texts leave before any shuffle. NULL text counts as empty. NULL ids come last; a group
    without ids has a NULL ``keep_id``. Of rows that repeat the winning id exactly one stays, chosen by a hash of its
    columns. Input columns named like result columns are replaced. An empty table gives an empty result.
    """
    results = ["keep_id", "group_size", "kept", "text_sha256"]
    clash = [c for c in df.columns if c.lower() in results and c not in (id_col, text_col)]
    df = in_small_batches(df.drop(*clash))
    carry = [c for c in (carry or df.columns) if c in df.columns]
    digest, heavy_key, heavy_n, heavy_id, place = fresh(df, "_digest", "_heavy", "_heavy_n", "_heavy_id", "_place")
    with_digest = df.withColumn(digest, text_digest(byte_text(text_col)))
    slim = materialize(with_digest.select(F.col(id_col), F.col(digest)))
    candidates = F.broadcast(heavy_candidates(slim.select(digest), counters))
    winners = slim.join(candidates, slim[digest] == candidates["key"]).groupBy("key").agg(
        F.count("*").alias(heavy_n), F.max(id_col).alias(heavy_id)).withColumnRenamed("key", heavy_key)
    winners = F.broadcast(materialize(winners))

    base = slim if set(carry) <= {id_col} else with_digest.select(*carry, *[c for c in (id_col,) if c not in carry], digest)
    joined = base.join(winners, base[digest] == winners[heavy_key], "left")
    lost = F.col(heavy_key).isNotNull() & ~F.col(id_col).eqNullSafe(F.col(heavy_id))
    group = Window.partitionBy(digest)
    columns = [c for c in base.columns if c != digest]
    first = group.orderBy(F.col(id_col).desc_nulls_last(), F.xxhash64(*columns))
    rest = joined.where(~lost).withColumns({
        place: F.row_number().over(first),
        "keep_id": F.when(F.col(heavy_key).isNull(), F.max(id_col).over(group)).otherwise(F.col(heavy_id)),
        "group_size": F.coalesce(F.col(heavy_n), F.count("*").over(group)),
    })
    rest = rest.withColumn("kept", F.col(place) == 1)
    shown = [*carry, "keep_id", "group_size", "kept", F.lower(F.hex(digest)).alias("text_sha256")]
    if drop:
        return rest.where("kept").select(*shown)
    losers = joined.where(lost).withColumns({
        "keep_id": F.col(heavy_id), "group_size": F.col(heavy_n), "kept": F.lit(False)})
    return rest.select(*shown).unionByName(losers.select(*shown))


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of equal texts (see ``marked_copies``); columns unchanged."""
    renamed = df.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    place = {c: f"c{i}" for i, c in enumerate(df.columns)}
    kept = marked_copies(renamed, place[id_col], place[text_col], drop=True)
    return kept.select([F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])
