"""Importance resampling towards a target distribution, over hashed n-grams found by prefix CRCs.

Each text is normalised to words joined by one space and scanned once; the running CRC-32 at every word end is kept. The CRC of any
run of words follows from two of them: ``crc(A + B) = shift(crc(A), len(B)) xor crc(B)``, where the shift by a number of bytes
is a linear map over GF(2). So no n-gram is ever cut out or hashed by itself. Shifts of up to ``TABLED`` bytes are looked up in tables
of four bytes each; longer ones are put together from powers of two.

Three passes: bucket counts of the documents and of the target (tasks send one row per bucket), scores, ranks by distributed
index. Only the ``BUCKETS`` counts pass through the driver.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellset.llm.common import byte_text, in_small_batches, slices, texts_of
from cellset.operators.scale import dense_index
from cellset.session import materialize

BUCKETS = 10_000
ORDERS = 3
SEED = 42
PERCENT = 5
#: Words that a document needs to be drawn.
ENOUGH = 20
#: Shifts with a table of their own (4 KB each).
TABLED = 256
#: The polynomial of zlib's CRC-32, lowest power in the highest bit.
POLYNOMIAL = 0xEDB88320
#: A-Z become a-z, other ASCII characters but digits and a-z become white space; bytes from 128 on stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Words of one batch whose n-grams are hashed together.
CHUNK = 200_000


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and any non-ASCII characters."""
    return text.translate(WORD_BYTES).split()


@lru_cache(maxsize=1)
def byte_step() -> np.ndarray:
    """Effect of one zero byte on the 256 values of a register's lowest byte."""
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, values >> 1 ^ np.uint32(POLYNOMIAL), values >> 1)
    return values


def tables_of(columns: np.ndarray) -> np.ndarray:
    """Lookup tables ``[4, 256]`` of the linear map with the given images of the 32 bits."""
    out = np.zeros((4, 256), np.uint32)
    values = np.arange(256)
    for bit in range(8):
        out ^= np.where(values >> bit & 1, columns.reshape(4, 8)[:, bit, None], np.uint32(0)).astype(np.uint32)
    return out


def applied(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The map of ``tables`` on each of ``crc``."""
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


@lru_cache(maxsize=1)
def short_shifts() -> np.ndarray:
    """Tables ``[bytes, 4, 256]`` of the shifts by 0 to ``TABLED - 1`` zero bytes."""
    columns, out = np.uint32(1) << np.arange(32, dtype=np.uint32), []
    for _ in range(TABLED):
        out.append(tables_of(columns))
        columns = columns >> 8 ^ byte_step()[columns & 255]
    return np.array(out)


@lru_cache(maxsize=64)
def power_shift(power: int) -> np.ndarray:
    """Tables of the shift by ``2 ** power`` bytes, by squaring."""
    if power == 0:
        return short_shifts()[1]
    half = power_shift(power - 1)
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    return tables_of(applied(half, applied(half, bits)))


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """``crc`` of a text as it stands in the CRC of that text with ``n_bytes`` more bytes."""
    tables = short_shifts().reshape(-1)
    at = (n_bytes % TABLED).astype(np.int64) << 10
    out = tables[at + (crc & 255)] ^ tables[at + 256 + (crc >> 8 & 255)] ^ tables[at + 512 + (crc >> 16 & 255)] ^ tables[at + 768 + (crc >> 24)]
    rest, power = n_bytes // TABLED, TABLED.bit_length() - 1
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = applied(power_shift(power), out[odd])
        rest, power = rest >> 1, power + 1
    return out


def running_crcs(words: list[bytes]) -> list[int]:
    """CRC-32 of the words joined by spaces, at the end of every word, in one scan."""
    crc32 = zlib.crc32
    return list(accumulate(words[1:], lambda crc, word: crc32(word, crc32(b" ", crc)), initial=crc32(words[0]))) if words else []


def features_of(texts: list[list[bytes]], orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """``(crc, text)``: CRC-32 of every run of 1 to ``orders`` words of each text, with the text's number."""
    sizes = np.array([len(w) for w in texts], np.int64)
    if not sizes.sum():
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    ends = np.array([c for w in texts for c in running_crcs(w)], np.uint32)
    lengths = np.array([len(w) for words in texts for w in words], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # CRC of what stands before a word: the end of the word before it and one space, nothing before the first
    before = np.append(np.uint32(0), ends[:-1]) ^ np.uint32(0xFFFFFFFF)
    before = (before >> 8 ^ byte_step()[(before ^ 32) & 255]) ^ np.uint32(0xFFFFFFFF)
    before[place == 0] = 0
    to = np.cumsum(lengths + 1)
    start = to - lengths - 1
    crcs, owners = [], []
    for n in range(1, orders + 1):
        last = np.flatnonzero(place >= n - 1)
        first = last - (n - 1)
        crcs.append(ends[last] ^ shifted(before[first], to[last] - 1 - start[first]))
        owners.append(owner[last])
    return np.concatenate(crcs), np.concatenate(owners)


def parts_of(words: list[bytes], most: int, overlap: int):
    """Stretches of a long text that together hold each run of words once: ``(words, words of the stretch before)``."""
    for at in range(0, max(len(words), 1), most):
        lead = min(at, overlap)
        yield words[at - lead:at + most], lead


def bucket_rows(texts: list[bytes], buckets: int, orders: int):
    """``(first text, buckets of all features, their texts)`` in chunks of about ``CHUNK`` words; a long text is one chunk or several."""
    group, size, first = [], 0, 0
    for i, text in enumerate(texts):
        words = words_of(text)
        if len(words) > CHUNK:
            if group:
                yield first, *hashed(group, buckets, orders)
            for part, lead in parts_of(words, CHUNK, orders - 1):
                values, _ = hashed([part], buckets, orders)
                if lead:  # runs inside the lead belong to the stretch before
                    again, _ = hashed([part[:lead]], buckets, orders)
                    values = np.repeat(np.arange(buckets), np.bincount(values, minlength=buckets) - np.bincount(again, minlength=buckets))
                yield i, values, np.zeros(len(values), np.int64)
            group, size, first = [], 0, i + 1
            continue
        group.append(words)
        size += len(words)
        if size >= CHUNK:
            yield first, *hashed(group, buckets, orders)
            group, size, first = [], 0, i + 1
    if group:
        yield first, *hashed(group, buckets, orders)


def hashed(texts: list[list[bytes]], buckets: int, orders: int) -> tuple[np.ndarray, np.ndarray]:
    crc, owner = features_of(texts, orders)
    return (crc % np.uint32(buckets)).astype(np.int64), owner


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """``bucket, n``: features of all texts in each bucket that has any. NULL has none."""
    def run(iterator):
        total = np.zeros(buckets, np.int64)
        for batch in slices(iterator):
            for _, values, _ in bucket_rows(texts_of(batch.column(0)), buckets, orders):
                total += np.bincount(values, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["bucket", "n"])

    rows = in_small_batches(df).select(byte_text(text_col).alias("text")).mapInArrow(run, "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS,
                 orders: int = ORDERS) -> np.ndarray:
    """For every bucket thousandths of the log ratio of its smoothed shares in ``target`` and ``docs``, rounded down."""
    counted = bucket_counts(docs, text_col, buckets, orders).withColumn("side", F.lit(0)).unionByName(
        bucket_counts(target, target_col, buckets, orders).withColumn("side", F.lit(1)))
    counts = np.zeros((2, buckets), np.int64)
    for row in counted.collect():  # two rows a bucket at most
        counts[row.side, row.bucket] = row.n
    (s, t), (all_s, all_t) = counts, counts.sum(axis=1)
    ratio = ((t + 1.0) * (all_s + buckets)) / ((s + 1.0) * (all_t + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", orders: int = ORDERS) -> DataFrame:
    """``id, n_words, n_features, weight``: number of features and the sum of their gains, for every row."""
    def run(iterator):
        for batch in slices(iterator):
            texts = texts_of(batch.column(1))
            n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for first, values, owner in bucket_rows(texts, len(gains), orders):
                np.add.at(weight, first + owner, gains[values])
                n += np.bincount(first + owner, minlength=len(texts))
            words = np.array([len(words_of(t)) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(weight)],
                                             ["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_small_batches(docs).select(F.col(id_col).alias("id"), byte_text(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
              percent: int = PERCENT, enough: int = ENOUGH, seed: int = SEED, buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """``id, n_words, n_features, weight, score, rank`` of every row; ``rank`` counts the drawn ones from 1.

    ``percent`` hundredths of the rows with ``enough`` words are drawn: those with the highest sums of weight and Gumbel noise, which is
    fixed by id and seed. Ties go to the smaller id, NULL last; rows with equal id and score are interchangeable. NULL
    and empty texts have no features and weight 0; an empty target leaves all gains to the smoothing. An empty table gives
    an empty result. Other columns are ignored.
    """
    gains = bucket_gains(docs, target, text_col, target_col, buckets, orders)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    # written first, as the sort's sample of the keys would scan all texts once more
    rows = materialize(weighted(docs, gains, id_col, text_col, orders).withColumn("score", F.col("weight") + noise))
    able = F.col("n_words") >= enough
    placed = dense_index(rows, [(~able).cast("int").asc(), F.col("score").desc(), F.col("id").asc_nulls_last()], "_place")
    drawn = placed.where(able).count() * percent // 100
    return placed.select("id", "n_words", "n_features", "weight", "score",
                         F.when(able & (F.col("_place") < drawn), F.col("_place") + 1).cast("long").alias("rank"))
