"""Best-fit packing of documents into sequences by minimum bin slack.

Only the histogram of lengths decides which lengths share a sequence, and it has at most ``capacity`` rows whatever the
input's size. Per bin the largest length left is placed, and a subset-sum over the other available lengths, kept as the
bits of one integer, finds the fullest feasible combination. That combination (a *pattern*) is used as often as the
counts allow before the next one is sought, so the work depends on the number of different lengths alone. Pieces find
their places by their rank among the pieces of equal length; ranks are counted per input partition and shifted, so a
length that a third of all pieces share is never gathered in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellset.llm.common import byte_text, fresh, in_small_batches, texts_of
from cellset.session import materialize

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Words kept with their ids in one Python worker (about 200 bytes each).
CACHED_WORDS = 600_000
PIECES = "piece int, start long, length long, ids_crc32 long"


#: ASCII marks; a run of them after a letter or digit is a piece of its own for the default tokenizer.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def ends_alphanumeric(word: bytes) -> bool:
    """Whether the last character is a digit or a letter of basic Latin, its supplement or extensions."""
    last = word[-1:] if word[-1:] < b"\x80" else word.decode()[-1].encode()
    return last.isalnum() or (len(last) == 2 and last.decode().isalpha() and last.decode() < "\u0250")


class WordIds(dict):
    """Token ids of one white-space-free word as little-endian unsigned 32-bit bytes, remembered.

    Only for tokenizers that treat texts as the default one: pieces never span ASCII white space, A-Z are lower-cased, and a
    run of ASCII letters is one piece that normalisation leaves alone.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: Texts with one of these (in any case, as the tokenizer may lower-case) are encoded as a whole.
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(MARKS)
        if word.isalpha():
            ids = np.array([t.id for t in self.model.tokenize(word.decode())], "<u4").tobytes()
        elif len(stem) < len(word) and ends_alphanumeric(stem):
            ids = self[stem] + self[word[len(stem):]]
        else:
            ids = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if len(self) > CACHED_WORDS:
            self.clear()
        lower = text.lower()
        if any(token in lower for token in self.special):
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, lower.split()))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
              tokenizer: str = TOKENIZER) -> DataFrame:
    """Token pieces ``id, piece, start, length, ids_crc32`` of every row: ids of the whole text, then id 0, cut at ``capacity``.

    NULL text counts as empty and gives one piece of length 1; a text that spells a special token of the tokenizer gets its id, as
    the tokenizer itself does it. Ids may be NULL or repeat; each row gives its own pieces.
    """
    def run(iterator):
        encode = word_ids(public_tokenizers.path(tokenizer)).encode
        step = 4 * capacity
        for batch in iterator:
            take, rows = [], []
            for i, text in enumerate(texts_of(batch.column(1))):
                ids = encode(text) + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    take.append(i)
                    rows.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
            piece, start, length, crc = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                [id_col, "piece", "start", "length", "ids_crc32"])

    kind = df.schema[id_col].dataType.simpleString()
    return in_small_batches(df).select(id_col, byte_text(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, {PIECES}")


def fullest(room: int, counts: dict[int, int]) -> list[int]:
    """Lengths (with repeats, within ``counts``) whose sum is the largest that ``room`` can hold.

    Bit ``s`` of ``reach`` says that sum ``s`` can be made; larger lengths are tried first, and the search ends once the
    room can be filled wholly.
    """
    reach, steps, full, inside = 1, [], 1 << room, (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left:
            size = min(size, left)
            steps.append((reach, length, size))
            reach |= (reach << (length * size)) & inside
            left -= size
            size *= 2
        if reach & full:
            break
    total, chosen = reach.bit_length() - 1, []
    for before, length, size in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * size
            total -= length * size
    return chosen


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """``(repeats, lengths)`` of the sequences that use up the histogram."""
    counts, found = {k: n for k, n in histogram.items() if n}, []
    while counts:
        largest = max(counts)
        others = {k: n - (k == largest) for k, n in counts.items() if n - (k == largest)}
        lengths = [largest, *fullest(capacity - largest, others)]
        used = Counter(lengths)
        repeats = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= repeats * n
            if not counts[k]:
                del counts[k]
        found.append((repeats, lengths))
    return found


def slots_of(found: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first rank, end rank, first sequence, per sequence, offset)`` for each length of each pattern."""
    ranks, sequence, out = Counter(), 0, []
    for repeats, lengths in found:
        offset = 0
        for length, n in Counter(lengths).items():
            out.append((length, ranks[length], ranks[length] + repeats * n, sequence, n, offset))
            ranks[length] += repeats * n
            offset += n * length
        sequence += repeats
    return out


def packed(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: whole rows of lengths 1 to ``capacity`` packed into sequences.

    Sequences are gapless from offset 0 and hold ``capacity`` at most. Full pieces are sequences of their own, with
    negative ids. Equal lengths are interchangeable, so ties are broken by place in the input. An empty table gives
    an empty result; columns named like the new ones are replaced. The histogram (at most ``capacity`` rows) is the
    only data that passes through the driver.
    """
    clash = [c for c in pieces.columns if c.lower() in ("sequence_id", "offset")]
    pieces = pieces.drop(*clash)
    mark, part, rank, shift = fresh(pieces, "_mark", "_part", "_rank", "_shift")
    rows = materialize(pieces.withColumn(mark, F.monotonically_increasing_id()).withColumn(part, F.shiftright(mark, 33)))
    full = rows.where(F.col(length_col) >= capacity)
    short = rows.where(F.col(length_col) < capacity)
    counts = materialize(short.groupBy(length_col, part).agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in counts.groupBy(length_col).agg(F.sum("n")).collect()}
    slots = pieces.sparkSession.createDataFrame(
        slots_of(patterns(histogram, capacity)),
        "slot_length long, lo long, hi long, first long, per long, base long")
    before = Window.partitionBy(length_col).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.col(length_col).alias("at_length"), F.col(part).alias("at_part"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias(shift))
    local = F.row_number().over(Window.partitionBy(length_col, part).orderBy(mark)) - 1
    ranked = short.withColumn(rank, local).join(
        shifts, (F.col(length_col) == F.col("at_length")) & (F.col(part) == F.col("at_part"))).withColumn(
        rank, F.col(rank) + F.col(shift))
    # at most a few slots for each length and pattern: bounded by the capacity, not by the input
    placed = ranked.join(F.broadcast(slots), (F.col(length_col) == F.col("slot_length"))
                         & (F.col(rank) >= F.col("lo")) & (F.col(rank) < F.col("hi")))
    turn = F.col(rank) - F.col("lo")
    columns = [F.col(f"`{c}`") for c in pieces.columns]
    inside = placed.select(*columns, (F.col("first") + F.floor(turn / F.col("per"))).cast("long").alias("sequence_id"),
                           (F.col("base") + turn % F.col("per") * F.col(length_col)).cast("long").alias("offset"))
    alone = full.select(*columns, (-1 - F.col(mark)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return inside.unionByName(alone)


def packed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                     tokenizer: str = TOKENIZER) -> DataFrame:
    """Every piece of every document with its place (see ``pieces_of`` and ``packed``)."""
    return packed(pieces_of(df, id_col, text_col, capacity, tokenizer), capacity)
