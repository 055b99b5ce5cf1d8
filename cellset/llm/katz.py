"""Katz backoff language model: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

The corpus is first written as *chunks* of whole documents: a local vocabulary and one number per token. Tables of n-gram counts are
partitioned by key range. To read or add up a table, every chunk sends each partition its own distinct keys in
ascending order, once per chunk however often they occur, with its local sums; the partition adds equal keys up and sends the
totals back to each chunk, in the same order and without the keys. A frequent n-gram is therefore at most one entry
per chunk, and no task holds more than one partition or one chunk.

Orders go up one by one. For each context, the *owner* chunks of its n-grams (the first training chunk that has one) contribute
the discounted counts and the lower-order probabilities of the n-grams that were seen, each exactly once, so that
``alpha = (1 - seen mass) / (1 - lower-order mass of seen words)`` is exact. A token is then evaluated recursively: the discounted
estimate if its n-gram was seen, else ``alpha`` of the context times the estimate with a shorter context.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellset.llm.common import ascii_lower, byte_text, in_small_batches, texts_of
from cellset.llm.near_dup import mixed_bits
from cellset.session import durable_dir, materialize

ORDER = 2
#: Counts above this are trusted and not discounted.
GT_MAX = 5
#: Tokens of a chunk, from which it is closed; documents are never split.
CHUNK = 600_000
#: Tokens of the corpus for each partition of a table of n-grams; word and context tables get a quarter as many partitions.
PART_TOKENS = 750_000
HELD_OUT_OF, HELD_OUT = 7, 2
#: Words can't contain white space, so these are no words: the end of a text, and what stands before its first word.
END, BEGIN = b" ", b"\n"
CHUNKS = "chunk long, n_tokens long, ids array<{kind}>, held array<boolean>, lengths binary, codes binary, hashes binary"
REPLY = "chunk long, tag int, part int, totals binary, owned binary, stats array<long>"


def held_out(id_col: str) -> Column:
    """CRC-32 of the id as text, modulo 7, is 2; a NULL id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def planes(columns: np.ndarray) -> bytes:
    """Columns of numbers, first bytes first, so that the empty high bytes of small numbers lie together and compress away."""
    columns = np.ascontiguousarray(columns)
    return packed(columns.view(np.uint8).reshape(*columns.shape, columns.itemsize).transpose(0, 2, 1))


def from_planes(blob: bytes, kind: type, n: int) -> np.ndarray:
    """Columns of ``n`` numbers from their ``planes``."""
    parts = np.frombuffer(blob, np.uint8).reshape(-1, np.dtype(kind).itemsize, n).transpose(0, 2, 1)
    return np.ascontiguousarray(parts).view(kind).reshape(-1, n)


def chunks_of(df: DataFrame, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """Written table of ``CHUNKS``: per document its tokens as places in the chunk's ascending list of word hashes."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(iterator):
        known: dict[bytes, int] = {}
        ids, held, codes, lengths, size = [], [], [], [], 0
        id_type = pa.null()

        def closed():
            words = list(known)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            order = np.argsort(hashes)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(id_type)),
                 pa.array([held], pa.list_(pa.bool_())), pa.array([packed(np.array(lengths, np.int64))], pa.binary()),
                 pa.array([planes(place[np.concatenate(codes)][None, :])], pa.binary()), pa.array([packed(hashes[order])], pa.binary())],
                ["chunk", "n_tokens", "ids", "held", "lengths", "codes", "hashes"])

        for batch in iterator:
            id_type = batch.column(0).type
            for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                words = ascii_lower(text).split()
                words.append(END)
                codes.append(np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, len(words)))
                ids.append(doc_id), held.append(out), lengths.append(len(words))
                size += len(words)
                if size >= chunk:
                    yield closed()
                    known.clear()
                    ids, held, codes, lengths, size = [], [], [], [], 0
        if ids:
            yield closed()

    rows = in_small_batches(df).select(F.col(id_col), held_out(id_col).alias("_held"), byte_text(text_col).alias("_text"))
    chunks = rows.mapInArrow(run, CHUNKS.format(kind=kind)).withColumn("chunk", F.monotonically_increasing_id())
    # bucketed by chunk, so that replies can be joined with the chunks without shuffling these
    name = f"chunks_{uuid.uuid4().hex}"
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks.write.bucketBy(buckets, "chunk").option("path", f"{durable_dir(df.sparkSession)}/{name}").option(
        "compression", "zstd").saveAsTable(name)
    return df.sparkSession.table(name)


@dataclass
class Chunk:
    """One chunk in memory. ``keys[o]`` are the distinct n-grams of length ``o`` and ``contexts[o]`` what stands before their last
    token, as ascending hashes; ``gram[o]`` and ``context[o]`` number them for each token."""
    train: np.ndarray
    lengths: np.ndarray
    keys: dict[int, np.ndarray]
    gram: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]
    context: dict[int, np.ndarray]

    @classmethod
    def of(cls, row: dict, order: int) -> Chunk:
        lengths = np.frombuffer(row["lengths"], np.int64)
        codes = from_planes(row["codes"], np.uint32, len(row["codes"]) // 4)[0].astype(np.int64)
        hashes = np.frombuffer(row["hashes"], np.uint64)
        chunk = cls(np.repeat(~np.array(row["held"], bool), lengths), lengths, {1: hashes}, {1: codes}, {}, {})
        words = hashes[codes]
        # tokens of the text before this one
        since = np.arange(len(codes), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
        begin = np.uint64(xxhash.xxh3_64_intdigest(BEGIN))
        before = np.zeros(len(codes), np.uint64)
        for o in range(2, order + 1):
            word = np.full(len(codes), begin, np.uint64)
            known = np.flatnonzero(since >= o - 1)
            word[known] = words[known - (o - 1)]
            del known
            before = mixed_bits(before * np.uint64(3) + word)
            chunk.keys[o], chunk.gram[o] = np.unique(mixed_bits(before ^ (words * np.uint64(5))), return_inverse=True)
            chunk.contexts[o], chunk.context[o] = np.unique(before, return_inverse=True)
        return chunk

    def counts(self, o: int) -> np.ndarray:
        """Training occurrences of each distinct n-gram of length ``o``."""
        return np.bincount(self.gram[o], weights=self.train, minlength=len(self.keys[o])).astype(np.uint32)


def keys_of(blob: bytes) -> np.ndarray:
    return np.cumsum(from_planes(blob, np.uint64, len(blob) // 8)[0], dtype=np.uint64)


def requests(frame: DataFrame, make, parts: int) -> DataFrame:
    """``part, chunk, keys, sums``: what ``make(row)`` returns as (ascending keys, sums by column), cut by key range."""
    def run(iterator):
        bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
        for batch in iterator:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys, sums = make(row)
                out, at = [], 0
                for part, end in enumerate([*np.searchsorted(keys, bounds).tolist(), len(keys)]):
                    if end > at:
                        # differences of ascending keys have empty high bytes, which the shuffle compresses away
                        steps = np.diff(keys[at:end], prepend=np.uint64(0))
                        out.append((part, row["chunk"], planes(steps[None, :]), planes(sums[:, at:end])))
                        at = end
                if out:
                    columns = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                        ["part", "chunk", "keys", "sums"])

    return frame.mapInArrow(run, "part int, chunk long, keys binary, sums binary")


def answered(asked: DataFrame, tag: int, kind: type, settle) -> DataFrame:
    """Written replies (``REPLY``): equal keys of a part added up and ``settle(sums)`` sent back to every chunk that asked.

    ``owned`` marks the entries of the first chunk with a positive first sum. A row without chunk carries statistics of
    the part: entries with the counts 1 to ``GT_MAX + 1``, all counts, and entries that have any.
    """
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        keys = [keys_of(r["keys"]) for r in rows]
        sums = np.concatenate([from_planes(r["sums"], kind, len(k)) for r, k in zip(rows, keys, strict=True)], axis=1)
        every = np.concatenate(keys)
        distinct, place = np.unique(every, return_inverse=True)
        totals = np.array([np.bincount(place, weights=x, minlength=len(distinct)) for x in sums])
        owned = np.zeros(len(every), bool)
        mine = np.flatnonzero(sums[0] > 0)
        owned[mine[np.unique(place[mine], return_index=True)[1]]] = True
        counts = totals[0].astype(np.int64)
        stats = [int((counts == r).sum()) for r in range(1, GT_MAX + 2)] + [int(counts.sum()), int((counts > 0).sum())]
        reply = settle(totals)[:, place]
        ends = np.cumsum([len(k) for k in keys])
        cuts = list(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True))
        part = rows[0]["part"]
        return pa.Table.from_arrays(
            [pa.array([*(r["chunk"] for r in rows), None], pa.int64()), pa.array([tag] * (len(rows) + 1), pa.int32()),
             pa.array([part] * (len(rows) + 1), pa.int32()), pa.array([*(planes(reply[:, a:b]) for a, b in cuts), None], pa.binary()),
             pa.array([*(packed(np.packbits(owned[a:b])) for a, b in cuts), None], pa.binary()),
             pa.array([*(None for _ in rows), stats], pa.list_(pa.int64()))],
            ["chunk", "tag", "part", "totals", "owned", "stats"])

    return materialize(asked.groupBy("part").applyInArrow(run, REPLY))


def statistics(replies: DataFrame) -> list[int]:
    sums = replies.where("chunk is null").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n"))
    found = {r.pos: r.n for r in sums.collect()}  # GT_MAX + 3 rows
    return [found.get(i, 0) for i in range(GT_MAX + 3)]


def with_replies(chunks: DataFrame, replies: list[DataFrame]) -> DataFrame:
    """Each chunk with its replies: one blob per tag and part."""
    every = replies[0]
    for more in replies[1:]:
        every = every.unionByName(more)
    lists = every.where("chunk is not null").groupBy("chunk").agg(
        F.collect_list(F.struct("tag", "part", "totals", "owned")).alias("replies"))
    return chunks.join(lists, "chunk")


def read_replies(row: dict, sizes: dict[int, int], kinds: dict[int, type]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Totals (by column) and owner marks of each tag, in the order of the chunk's keys."""
    blobs: dict[int, list] = {}
    for r in sorted(row["replies"], key=lambda r: (r["tag"], r["part"])):
        blobs.setdefault(r["tag"], []).append(r)
    out = {}
    for tag, parts in blobs.items():
        width = 2 if tag < 0 else 1
        size = width * np.dtype(kinds[tag]).itemsize
        totals = [from_planes(r["totals"], kinds[tag], len(r["totals"]) // size) for r in parts]
        owned = [np.unpackbits(np.frombuffer(r["owned"], np.uint8), count=t.shape[1]).astype(bool) for r, t in zip(parts, totals, strict=True)]
        out[tag] = (np.concatenate(totals, axis=1), np.concatenate(owned))
        assert out[tag][0].shape[1] == sizes[tag]
    return out


def discounts(n: list[int]) -> np.ndarray:
    """Katz's factors for the counts 0 to ``GT_MAX + 1`` from the numbers ``n`` of n-grams with the counts 1, 2, ...

    Where Good-Turing gives no factors between 0 and 1 fewer counts are discounted; at the least single ones lose a half.
    """
    for k in range(GT_MAX, 0, -1):
        if min(n[:k + 1]) <= 0:
            continue
        rest = (k + 1) * n[k] / n[0]
        if rest >= 1:
            continue
        d = [((r + 1) * n[r] / (r * n[r - 1]) - rest) / (1 - rest) for r in range(1, k + 1)]
        if all(0 < x <= 1 for x in d):
            return np.array([1.0, *d, *[1.0] * (GT_MAX + 1 - k)])
    return np.array([1.0, 0.5, *[1.0] * GT_MAX])


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return counts * factors[np.minimum(counts, GT_MAX + 1).astype(np.int64)]


def weights(n: np.ndarray, kept: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """``norm, alpha`` of contexts with ``n`` occurrences, discounted counts that sum to ``kept`` and lower-order mass ``lower``.

    An n-gram has probability ``discounted count * norm``. If discounting leaves less than ``1 / (n + 1)``, that much is set aside.
    An unseen context has norm 0 and alpha 1.
    """
    some = np.maximum(n, 1.0)
    left = np.maximum(1 - kept / some, 1 / (some + 1))
    norm = np.where(n > 0, (1 - left) / np.where(kept > 0, kept, 1.0), 0.0)
    return np.array([norm, np.where(n > 0, left / (1 - lower), 1.0)])


@dataclass(frozen=True)
class Model:
    """What every task may know of the model: sizes and discounts, a few numbers per order."""
    tokens: int
    words: int
    factors: tuple[np.ndarray, ...]
    norm: float
    unknown: float

    @classmethod
    def of(cls, stats: list[list[int]]) -> Model:
        factors = tuple(discounts(n) for n in stats)
        small, tokens = stats[0][:GT_MAX + 1], stats[0][GT_MAX + 1]
        lost = sum((1 - factors[0][r + 1]) * (r + 1) * m for r, m in enumerate(small))
        norm, unknown = weights(np.array([float(tokens)]), np.array([tokens - lost]), np.zeros(1))[:, 0]
        return cls(tokens, stats[0][GT_MAX + 2], factors, float(norm), float(unknown))

    def probability(self, chunk: Chunk, replies: dict, order: int) -> np.ndarray:
        """Of each token, after at most ``order - 1`` tokens; all unknown words are one."""
        counts = replies[1][0][0].astype(np.float64)
        p = np.where(counts > 0, discounted(counts, self.factors[0]) * self.norm, self.unknown)[chunk.gram[1]]
        for o in range(2, order + 1):
            seen = replies[o][0][0].astype(np.float64)[chunk.gram[o]]
            norm, alpha = replies[-o][0][:, chunk.context[o]]
            p = np.where(seen > 0, discounted(seen, self.factors[o - 1]) * norm, alpha * p)
        return p


def kinds_of(order: int) -> dict[int, type]:
    return {o: np.uint32 for o in range(1, order + 1)} | {-o: np.float64 for o in range(2, order + 1)}


def sizes_of(chunk: Chunk) -> dict[int, int]:
    return {o: len(k) for o, k in chunk.keys.items()} | {-o: len(k) for o, k in chunk.contexts.items()}


def counted(order: int):
    def make(row):
        chunk = Chunk.of(row, order)
        return chunk.keys[order], chunk.counts(order)[None, :]
    return make


def context_sums(model: Model, order: int):
    """Of each context: occurrences, discounted counts and lower-order mass of the seen n-grams that this chunk owns."""
    def make(row):
        chunk = Chunk.of(row, order)
        replies = read_replies(row, sizes_of(chunk), kinds_of(order))
        lower = model.probability(chunk, replies, order - 1)
        totals, owned = replies[order]
        token = np.zeros(len(chunk.keys[order]), np.int64)
        token[chunk.gram[order]] = np.arange(len(chunk.train))  # any token of each n-gram
        at, total = token[owned], totals[0, owned].astype(np.float64)
        context = chunk.context[order][at]
        values = (total, discounted(total, model.factors[order - 1]), lower[at])
        return chunk.contexts[order], np.array([np.bincount(context, v, len(chunk.contexts[order])) for v in values])
    return make


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk: int = CHUNK,
           part_tokens: int = PART_TOKENS) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``df``.

    Tokens are the words (A-Z lower-cased) of the whole text and one end. Rows that aren't held out are learned from.
    ``base_score`` is the add-one unigram score, ``score`` the Katz model's, both log10; all unknown words are one word. NULL
    text counts as empty: one end token. Rows with equal ids are scored and counted one by one. Without training rows every
    token is unknown and has probability 1. Other columns are ignored; an empty table gives an empty result.
    """
    chunks = chunks_of(df, id_col, text_col, chunk)
    size = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    parts = {o: max(1, -(-size // part_tokens)) for o in range(2, order + 1)}
    few = max(1, size // (4 * part_tokens))
    counts_only = lambda totals: totals[:1].astype(np.uint32)
    replies = [answered(requests(chunks, counted(1), few), 1, np.uint32, counts_only)]
    stats = [statistics(replies[0])]
    for o in range(2, order + 1):
        replies.append(answered(requests(chunks, counted(o), parts[o]), o, np.uint32, counts_only))
        stats.append(statistics(replies[-1]))
        sums = requests(with_replies(chunks, replies), context_sums(Model.of(stats), o), few)
        replies.append(answered(sums, -o, np.float64, lambda t: weights(*t)))
    model = Model.of(stats)
    kind = df.schema[id_col].dataType.simpleString()

    def run(iterator):
        for batch in iterator:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = Chunk.of(row, order)
                got = read_replies(row, sizes_of(own), kinds_of(order))
                count = got[1][0][0].astype(np.float64)[own.gram[1]]
                base = np.log10((count + 1) / (model.tokens + model.words + 1))
                first = np.cumsum(own.lengths) - own.lengths
                per_text = lambda x: np.add.reduceat(x, first)  # noqa: B023, E731  every text has its end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], batch.schema.field("ids").type.value_type), pa.array(row["held"], pa.bool_()),
                     pa.array(own.lengths, pa.int64()), pa.array(per_text((count > 0).astype(np.int64)), pa.int64()),
                     pa.array([model.tokens] * len(first), pa.int64()), pa.array(per_text(base)),
                     pa.array(per_text(np.log10(model.probability(own, got, order))))],
                    [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_replies(chunks, replies).mapInArrow(
        run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
