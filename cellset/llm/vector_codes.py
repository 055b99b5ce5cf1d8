"""Product codes of vectors in exact integer arithmetic, the nearest entry found by Orchard's search.

Every vector is cut into parts with a codebook each. For every entry of a codebook the others are listed by distance. A search
walks along the list of its best entry so far, jumps to the list of a better one when it finds it, passes over entries that it
has seen, and ends where the list goes beyond twice the distance to the best entry: by the triangle inequality nothing
behind that can be as near. A whole batch searches at once, a short stretch of every open search's list at a time.

Codebooks have at most ``ENTRIES`` entries, so they travel through the driver; of the vectors only sums per entry do, one row
per entry and component from each task.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellset.llm.common import in_small_batches
from cellset.session import materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Searches that go on at once; each remembers which entries it has seen.
TOGETHER = 16_384
#: Entries of its list that a search looks at in one step.
STRETCH = 128
#: A label with more than this share of all rows is joined by broadcast: there are at most as many.
HOT_LABELS = 1000


@dataclass
class Codebook:
    """``entries [k, width]`` with, for each entry, the others by distance: ``others [k, k]`` and ``gaps [k, k]`` (squared, closed by a bound)."""

    entries: np.ndarray
    others: np.ndarray
    gaps: np.ndarray
    by_sum: np.ndarray


def codebook(entries: np.ndarray) -> Codebook:
    entries = np.asarray(entries, np.int64)
    k = len(entries)
    gaps = np.empty((k, k), np.int64)
    for i in range(k):
        gaps[i] = ((entries - entries[i]) ** 2).sum(axis=1)
        gaps[i, i] = -1  # itself first
    others = np.argsort(gaps, axis=1, kind="stable")
    gaps = np.take_along_axis(gaps, others, axis=1)
    end = np.full((k, 1), np.iinfo(np.int64).max)
    return Codebook(entries, np.hstack([others[:, 1:], np.zeros((k, 1), np.int64)]), np.hstack([gaps[:, 1:], end]),
                    np.argsort(entries.sum(axis=1), kind="stable"))


def nearest(points: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, int]:
    """``(entry, squared distance)`` of each point's nearest entry, ties to the lower index, and the number of distances taken."""
    found, least, taken = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64), 0
    for at in range(0, len(points), TOGETHER):
        found[at:at + TOGETHER], least[at:at + TOGETHER], n = searched(points[at:at + TOGETHER], book)
        taken += n
    return found, least, taken


def searched(points: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, int]:
    n, k = len(points), len(book.entries)
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(book.entries).max(initial=0)))
    kind = np.float64 if 4 * points.shape[1] * most * most < 1 << 53 else np.int64  # doubles hold such integers exactly
    x, e = points.astype(kind), book.entries.astype(kind)
    x2, e2 = (x * x).sum(axis=1), (e * e).sum(axis=1)

    beyond = np.inf if kind is np.float64 else np.iinfo(np.int64).max
    sums = book.entries.sum(axis=1)[book.by_sum]
    best = book.by_sum[np.minimum(np.searchsorted(sums, points.sum(axis=1)), k - 1)]
    every = np.arange(n)
    least = (x2 - 2 * (x * e[best]).sum(axis=1) + e2[best]).astype(np.int64)
    seen = np.zeros((n, k), bool)
    seen[every, best] = True
    place, open_, taken = np.zeros(n, np.int64), every, n
    while True:
        open_ = open_[book.gaps[best[open_], place[open_]] <= 4 * least[open_]]
        if not len(open_):
            return best, least, taken
        # searches at the same place of the same list take their distances together
        at = best[open_] * k + place[open_]
        order = np.argsort(at, kind="stable")
        for who in np.split(open_[order], np.flatnonzero(np.diff(at[order])) + 1):
            entry, start = best[who[0]], place[who[0]]
            end = min(start + STRETCH, k - 1)
            other, gaps = book.others[entry, start:end], book.gaps[entry, start:end]
            by_index = np.argsort(other)
            other, gaps = other[by_index], gaps[by_index]
            new = (gaps <= 4 * least[who, None]) & ~seen[who[:, None], other]
            taken += int(new.sum())
            seen[who[:, None], other] |= new
            distance = np.where(new, x2[who, None] - 2 * (x[who] @ e[other].T) + e2[other], beyond)
            nearest_one = distance.argmin(axis=1)  # the first, so ties go to the lower index
            distance = distance[np.arange(len(who)), nearest_one]
            found = other[nearest_one]
            better = (distance < least[who]) | ((distance == least[who]) & (found < best[who]))
            place[who] = np.where(better, 0, end)
            who = who[better]
            best[who], least[who] = found[better], distance[better]


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, parts: int) -> DataFrame:
    """``id, label, vector``: components times ``scale`` rounded down; rows without a vector, or with NULL or non-finite components, are left out."""
    def run(iterator):
        for batch in iterator:
            lists = batch.column(2)
            rows = np.asarray(lists.is_valid())
            values, starts = lists.flatten(), np.zeros(len(lists) + 1, np.int64)
            sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            np.cumsum(sizes, out=starts[1:])
            x = np.asarray(values.cast(pa.float64()).fill_null(np.nan), np.float64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            rows &= bad[starts[1:]] == bad[starts[:-1]]
            chosen = np.repeat(rows, sizes)
            x = np.floor(x[chosen] * scale)
            limit = math.isqrt((1 << 63) // (16 * max(int(sizes.max(initial=0)) // parts, 1))) - 1
            if len(x) and np.abs(x).max() > min(limit, (1 << 31) - 1):
                raise ValueError(f"components beyond {limit // scale} can't be coded in 64-bit integers")
            ends = np.append(0, np.cumsum(sizes[rows]))
            vectors = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.astype(np.int32)))
            mask = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), vectors], ["id", "label", "vector"])

    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, label_col)}
    return in_small_batches(df).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).mapInArrow(
        run, f"id {kinds[id_col]}, label {kinds[label_col]}, vector array<int>")


def matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Vectors of equal length as ``[row, part, component]``."""
    return np.asarray(column.flatten(), np.int64).reshape(len(column), parts, -1)


def entry_sums(table: DataFrame, books: list[Codebook]) -> DataFrame:
    """``part, entry, place, n, total``: how many parts are nearest to each entry, and the sums of their components."""
    def run(iterator):
        n = [np.zeros(len(b.entries), np.int64) for b in books]
        total = [np.zeros(b.entries.shape, np.int64) for b in books]
        for batch in iterator:
            if not batch.num_rows:
                continue
            for part, points in enumerate(matrix(batch.column(0), len(books)).transpose(1, 0, 2)):
                found, _, _ = nearest(points, books[part])
                n[part] += np.bincount(found, minlength=len(n[part]))
                np.add.at(total[part], found, points)
        for part, book in enumerate(books):
            used = np.flatnonzero(n[part])
            width = book.entries.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used) * width, part, np.int32)), pa.array(np.repeat(used, width).astype(np.int32)),
                 pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))), pa.array(np.repeat(n[part][used], width)),
                 pa.array(total[part][used].reshape(-1))], ["part", "entry", "place", "n", "total"])

    rows = table.select("vector").mapInArrow(run, "part int, entry int, place int, n long, total long")
    return rows.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def fitted(table: DataFrame, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """Codebooks ``[entry, component]`` per part: the first vectors by id, moved to the rounded-down means of their parts in each round."""
    seeds = table.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    books = list(np.array([r.vector for r in seeds], np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        # one row per entry and component
        for r in entry_sums(table, [codebook(b) for b in books]).collect():
            books[r.part][r.entry, r.place] = r.total // r.n
    return books


def digest_of(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def coded(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
          entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``id, label, code, error, label_error, codebooks_sha256`` of every row with a whole vector.

    ``code`` has two hex digits per part; ``error`` is the squared distance to the coded vector and ``label_error`` its sum over
    equal labels (NULLs together). NULL ids come last among the seeds, and rows that repeat an id are ordered by their
    vectors; with fewer than ``entries`` rows there are as many entries. An empty table, or one without whole vectors, gives an empty result.
    Vectors of different lengths, or of one that ``parts`` doesn't divide, and components too large for 64-bit distances are a ``ValueError``.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits, so there are 1 to 256 entries")
    table = materialize(whole_vectors(df, id_col, vector_col, label_col, scale, parts))
    size = table.agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    if size.low is not None and (size.low != size.high or size.low % parts):
        raise ValueError(f"vectors of {size.low} to {size.high} components can't be cut into {parts} equal parts")
    found = fitted(table, parts, entries, rounds) if size.low is not None else []
    books = [codebook(b) for b in found]

    def run(iterator):
        for batch in iterator:
            if not batch.num_rows:
                continue
            code, error = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
            for part, points in enumerate(matrix(batch.column(2), parts).transpose(1, 0, 2)):
                code[:, part], least, _ = nearest(points, books[part])
                error += least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code]), pa.array(error)],
                                             ["id", "label", "code", "error"])

    kinds = {c: table.schema[c].dataType.simpleString() for c in ("id", "label")}
    rows = materialize(table.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long"))
    return with_label_error(rows).withColumn("codebooks_sha256", F.lit(digest_of(found)))


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with the sum of ``error`` over equal labels; labels with a large share of the rows are few and are not shuffled."""
    sums = materialize(rows.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    bound = (sums.agg(F.sum("n")).first()[0] or 0) // HOT_LABELS
    hot, rest = sums.where(F.col("n") > bound).drop("n"), sums.where(F.col("n") <= bound).drop("n")
    on = F.col("label").eqNullSafe(F.col("l"))
    # at most HOT_LABELS rows
    met = rows.join(F.broadcast(hot), on, "left")
    other = met.where("label_error is null").select(*rows.columns).join(rest, on)
    return met.where("label_error is not null").unionByName(other).drop("l")
