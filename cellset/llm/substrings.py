"""Substring deduplication by super-k-mer partitioning.

A *window* is ``WINDOW`` consecutive words of one text, and its *minimiser* is the least hash among its ``MINIMISER``-word
sequences. Consecutive windows with the same minimiser form a *super-k-mer*. Equal windows have equal minimisers, so every
repeat is found inside the bucket of one minimiser:

1. Only ``(minimiser, place)`` of each super-k-mer is shuffled first. A bucket with one window source can't hold a repeat.
2. Super-k-mers of the remaining buckets travel as one packed string each to their bucket. There the words become numbers, the
   windows are sorted by hash, and sorted neighbours are compared word by word.
3. A bucket of more than ``BUCKET`` super-k-mers, or ``EACH`` times as many words (a passage that very many texts share, or a
   very long periodic text), isn't gathered: each of its windows travels as a 128-bit digest to one of several parts of
   the bucket, chosen by text and place, so that equal windows are spread too. Two of a part are repeated; what is single in its
   part is counted over all parts by an ordinary aggregation. This is as complete as the other way.
4. The spans that repeated windows cover go back to their texts.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellset.llm.common import byte_text, in_small_batches, slices, texts_of
from cellset.llm.near_dup import hashed_words, mixed_bits
from cellset.session import materialize

WINDOW = 35
MINIMISER = 8
#: Super-k-mers of one bucket that are sorted in one task.
BUCKET = 20_000
#: Words of such a bucket, per super-k-mer of the bound.
EACH = 64
#: Words sorted at once inside a task; a bucket that is gathered is never split.
CHUNK = 250_000
#: End of a span that covers the rest of a text.
WHOLE = (1 << 31) - 1
STEP = np.uint64(0x9E3779B97F4A7C15)


def chained(values: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every ``width`` consecutive numbers, by doubling."""
    parts, have = {1: mixed_bits(values + STEP)}, 1
    while have * 2 <= width:
        x = parts[have]
        parts[have * 2] = mixed_bits(x[:-have] * STEP + x[have:]) if len(x) > have else x[:0]
        have *= 2
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    result, at = parts[have][:n], have
    while at < width:
        size = 1 << ((width - at).bit_length() - 1)
        result = mixed_bits(result * STEP + parts[size][at:at + n])
        at += size
    return result


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive numbers."""
    x, have = values, 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return x if have == width else np.minimum(x[:len(x) - (width - have)], x[width - have:])


def super_kmers(words: list[bytes], window: int = WINDOW, minimiser: int = MINIMISER):
    """``(minimiser hashes, first windows, numbers of windows, weights)`` of one text.

    The weight is 2 where a minimiser stands at several places of the super-k-mer, as then its windows may repeat each
    other.
    """
    if len(words) < window:
        return None
    seeds = chained(hashed_words(words), minimiser)
    span = window - minimiser + 1
    least = least_of(seeds, span)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    runs = np.diff(np.append(starts, len(least)))
    weights = np.ones(len(starts), np.int64)
    if len(np.unique(seeds)) < len(seeds):
        twice = np.zeros(len(seeds) + 1, np.int64)
        for gap in range(1, min(span, len(seeds) - 1) + 1):
            twice[1:len(seeds) - gap + 1] |= seeds[:-gap] == seeds[gap:]
        twice = np.cumsum(twice)
        weights += twice[starts + runs + span - 1] > twice[starts]
    return least[starts].view(np.int64), starts, runs, weights


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, key, text``: id and a hash of the text tell rows apart."""
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), byte_text(text_col).alias("text"))


def runs_of(docs: DataFrame, id_kind: str, window: int, minimiser: int) -> DataFrame:
    def run(iterator):
        for batch in slices(iterator):
            take, parts = [], []
            for i, text in enumerate(texts_of(batch.column(2))):
                if (found := super_kmers(text.split(), window, minimiser)) is not None:
                    parts.append(found)
                    take.append(np.full(len(found[0]), i))
            if not parts:
                continue
            least, starts, runs, weights = (np.concatenate(x) for x in zip(*parts, strict=True))
            take = pa.array(np.concatenate(take))
            yield pa.RecordBatch.from_arrays(
                [pa.array(least), batch.column(0).take(take), batch.column(1).take(take), pa.array(starts, pa.int32()),
                 pa.array(runs, pa.int32()), pa.array(weights, pa.int32())], ["bucket", "id", "key", "start", "run", "weight"])

    return docs.mapInArrow(run, f"bucket long, id {id_kind}, key long, start int, run int, weight int")


def per_text(docs: DataFrame, found: DataFrame, value: str, how: str) -> DataFrame:
    """``docs`` with the list of ``value`` structs of their text; a text's list is bounded by its own words."""
    lists = found.groupBy(F.col("id").alias("l_id"), F.col("key").alias("l_key")).agg(F.collect_list(value).alias("found"))
    on = docs["id"].eqNullSafe(lists["l_id"]) & (docs["key"] == lists["l_key"])
    return docs.join(lists, on, how).select("id", "key", "text", "found")


SPAN = "bucket long, id {kind}, key long, start int, packed binary, hot boolean"


def spans_of(docs: DataFrame, live: DataFrame, id_kind: str, window: int) -> DataFrame:
    """``SPAN`` rows: super-k-mers with their words, or each window's digest where the bucket has ``parts``."""
    def span_batch(batch, take, rows):
        take = pa.array(take, pa.int64())
        bucket, start, packed, hot = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int64()), batch.column(0).take(take), batch.column(1).take(take), pa.array(start, pa.int32()),
             pa.array(packed, pa.binary()), pa.array(hot, pa.bool_())], ["bucket", "id", "key", "start", "packed", "hot"])

    def run(iterator):
        for batch in slices(iterator):
            take, rows = [], []
            for i, (text, found) in enumerate(zip(texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                words, own = text.split(), None
                for x in found:
                    first, end, parts = x["start"], x["start"] + x["run"], x["parts"]
                    if not parts:
                        take.append(i)
                        rows.append((x["bucket"], first, b" ".join(words[first:end + window - 1]), False))
                        continue
                    if own is None:
                        own = xxhash.xxh3_64_intdigest(repr((batch.column(0)[i].as_py(), batch.column(1)[i].as_py())).encode())
                    for at in range(first, end):
                        digest = xxhash.xxh3_128_digest(b" ".join(words[at:at + window]))
                        part = xxhash.xxh3_64_intdigest(b"%d" % at, seed=own) % parts
                        take.append(i)
                        rows.append((xxhash.xxh3_64_intdigest(digest, seed=part) - (1 << 63), at, digest, True))
                        if len(rows) >= BUCKET:
                            yield span_batch(batch, take, rows)
                            take, rows = [], []
            yield span_batch(batch, take, rows)

    rows = per_text(docs, live.withColumn("x", F.struct("bucket", "start", "run", "parts")), "x", "inner")
    return rows.mapInArrow(run, SPAN.format(kind=id_kind))


def repeated_windows(packed: list[bytes], window: int) -> list[np.ndarray]:
    """For each string the windows (first words) whose words occur more than once in all strings, by sorting."""
    number: dict[bytes, int] = {}
    words = [x.split(b" ") for x in packed]
    values = np.array([number.setdefault(w, len(number)) for x in words for w in x], np.uint64)
    sizes = np.array([len(x) for x in words])
    ends = np.cumsum(sizes)
    hashes = chained(values, window)
    inside = np.ones(len(values), bool)
    for back in range(1, window):
        inside[np.maximum(ends - back, ends - sizes)] = False
    places = np.flatnonzero(inside[:len(hashes)])
    order = places[np.argsort(hashes[places], kind="stable")]
    same_hash = hashes[order[1:]] == hashes[order[:-1]]
    views = np.lib.stride_tricks.sliding_window_view(values, window) if len(values) >= window else np.empty((0, window))
    again = np.zeros(len(order), bool)
    at = np.flatnonzero(same_hash)
    equal = np.ones(len(at), bool)
    for lo in range(0, len(at), 65_536):
        part = at[lo:lo + 65_536]
        equal[lo:lo + 65_536] = (views[order[part]] == views[order[part + 1]]).all(axis=1)
    if equal.all():
        again[at] = again[at + 1] = True
    else:  # different windows under one hash: count whole windows
        counts = Counter(views[p].tobytes() for p in order)
        again = np.array([counts[views[p].tobytes()] > 1 for p in order], bool)
    marked = np.sort(order[again])
    cuts = np.searchsorted(marked, ends)
    firsts = ends - sizes
    return [marked[lo:hi] - first for lo, hi, first in zip(np.append(0, cuts[:-1]), cuts, firsts, strict=True)]


def covered(places: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Merged spans ``[from, to)`` of the windows at ascending ``places``."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > window)
    return list(zip(places[np.append(0, cut + 1)].tolist(), (places[np.append(cut, len(places) - 1)] + window).tolist(), strict=True))


FOUND = "id {kind}, key long, first int, last int, digest binary, weight int"


def settled_rows(rows: list[tuple], window: int) -> list[tuple]:
    """``FOUND`` rows of whole buckets. A digest comes with a weight: 1 for a window that is single here, 2 where there are more."""
    out = []
    plain = [r for r in rows if not r[5]]
    for (_, row_id, key, start, _, _), places in zip(plain, repeated_windows([r[4] for r in plain], window) if plain else [], strict=True):
        out += [(row_id, key, start + a, start + b, None, None) for a, b in covered(places, window)]
    counts = Counter(r[4] for r in rows if r[5])
    for _, row_id, key, start, digest, hot in rows:
        if hot:
            out.append((row_id, key, start, start + window, *((None, None) if counts[digest] > 1 else (digest, 1))))
    return out + [(None, None, None, None, digest, 2) for digest, n in counts.items() if n > 1]


def sorted_buckets(spans: DataFrame, id_kind: str, window: int, chunk: int) -> DataFrame:
    """``FOUND`` rows of all buckets, each sorted as a whole in one task."""
    def run(iterator):
        rows, size, kind = [], 0, None

        def batch_of(out):
            columns = zip(*out, strict=True)
            types = (kind, pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                              ["id", "key", "first", "last", "digest", "weight"])

        for batch in slices(iterator):
            kind, out = batch.schema.field("id").type, []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= chunk and row[0] != rows[-1][0]:
                    out += settled_rows(rows, window)
                    rows, size = [], 0
                rows.append(row)
                size += 1 if row[5] else row[4].count(b" ") + 1
            if out:
                yield batch_of(out)
        if rows and (out := settled_rows(rows, window)):
            yield batch_of(out)

    return spans.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, FOUND.format(kind=id_kind))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    minimiser: int = MINIMISER, bucket: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """``id, n_words, n_removed, kept_text``: texts without the words that a repeated window covers.

    Words are separated by ASCII white space and unchanged; the kept ones are joined by one space. A window is repeated if
    its words also start at any other place, of the same text or another; all its places are removed. Texts
    shorter than a window keep everything; NULL counts as empty. Rows that repeat an id are told apart by their text,
    and equal rows repeat each other; any number of them costs no more than as many different rows. Other columns are ignored; an empty table gives an empty result.
    """
    id_kind = df.schema[id_col].dataType.simpleString()
    docs = keyed(in_small_batches(df), id_col, text_col)
    runs = materialize(runs_of(docs, id_kind, window, minimiser))
    # every window of a row that is there twice is repeated; the others only need one of its copies to meet
    twice = materialize(runs.where("start = 0").groupBy(F.col("id").alias("t_id"), F.col("key").alias("t_key")).agg(
        F.count("*").alias("rows")).where("rows > 1").select("t_id", "t_key"))
    is_twice = F.col("id").eqNullSafe(F.col("t_id")) & (F.col("key") == F.col("t_key"))
    runs = runs.join(twice, is_twice, "left_anti").unionByName(runs.join(twice, is_twice, "left_semi").groupBy("bucket", "id", "key", "start").agg(
        F.first("run").alias("run"), F.first("weight").alias("weight")))
    buckets = runs.groupBy("bucket").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.sum("run").alias("windows")).where(
        "w > 1").selectExpr("bucket", f"if(n > {bucket} or windows + n * {window - 1} > {bucket * EACH}, windows div {bucket} + 1, 0) as parts")
    live = materialize(runs.drop("weight").join(buckets, "bucket"))
    found = materialize(sorted_buckets(spans_of(docs, live, id_kind, window), id_kind, window, chunk))
    single = found.where("weight is not null")
    again = single.groupBy("digest").agg(F.sum("weight").alias("w")).where("w > 1").select("digest")
    found = found.where("weight is null").unionByName(
        single.where("weight = 1").join(again, "digest", "left_semi").select(*found.columns)).select("id", "key", "first", "last")
    found = found.join(twice, is_twice, "left_anti").unionByName(
        twice.selectExpr("t_id as id", "t_key as key", "0 as first", f"{WHOLE} as last"))

    def run(iterator):
        for batch in slices(iterator):
            n, removed, kept = [], [], []
            for text, spans in zip(texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                left, at = [], 0
                for first, last in sorted((x["first"], x["last"]) for x in spans or ()):
                    left += words[at:first]
                    at = max(at, last)
                left += words[at:]
                n.append(len(words)), removed.append(len(words) - len(left)), kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(kept, pa.string())], [id_col, "n_words", "n_removed", "kept_text"])

    rows = per_text(docs, found.withColumn("x", F.struct("first", "last")), "x", "left")
    return rows.mapInArrow(run, f"`{id_col}` {id_kind}, n_words long, n_removed long, kept_text string")


def text_sha256(text: str):
    return F.sha2(F.col(text).cast("binary"), 256)


def brute_force(texts: list[bytes], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """``(n_words, n_removed, sha256)`` of each text, by counting all windows in memory; for tests on small inputs."""
    words = [x.split() for x in texts]
    counts = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
