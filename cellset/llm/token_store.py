"""Token ids of documents as Parquet files that can be read in parts.

Texts are range-partitioned by id, so the files in name order hold the documents in ascending id order. Each task encodes its
range and writes one file: the ids as a list column, delta-packed or by dictionary, in row groups and pages of set sizes, with
the page indexes that Parquet's writer adds. Beside the ids stand their number and their place in the file, so metadata is
read without the ids, and an id range opens only the pages that can hold it. A manifest with one row per file gives the
ids before each file; no pass over the texts is needed to know it in advance.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellset.llm.common import in_small_batches, slices
from cellset.session import durable_dir

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Words kept with their ids in one Python worker (about 200 bytes each), half of them from before the last change of generation.
CACHED_WORDS = 900_000
#: Marks that end a word without being part of it.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Letters up to here are letters in every version of Unicode.
LATIN_END = "\u0250"
#: White space beside a space or line break, where splitting at those would change the pieces.
WIDE_SPACE = re.compile(r"\s[ \n]|[ \n]\s")
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
COLUMNS = "part int, local_start long, n_tokens long, ids array<int>"


def byte_letters() -> dict[int, str]:
    """The visible letter that byte-level tokenizers write for each byte: itself if it is visible, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class WordIds(dict):
    """Ids of ``before + word`` as little-endian unsigned 32-bit bytes, remembered; ``before`` is a space or nothing.

    For byte-level tokenizers whose pieces never span a single space or line break between two visible characters, take such a
    space to the word behind it, and end a run of letters before marks. Two generations of words are kept: the older one is
    forgotten when the younger one is full, but for the words that were used again.
    """

    def __init__(self, tokenizer: Tokenizer, before: str):
        super().__init__()
        self.tokenizer, self.model, self.before = tokenizer, tokenizer.model, before
        self.letters, self.ends = byte_letters(), {}
        self.head = self.spelt(before)
        self.old: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def spelt(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.letters)

    def end(self, marks: str) -> bytes:
        if marks not in self.ends:
            if len(self.ends) > 1000:
                self.ends.clear()
            self.ends[marks] = self.plain(marks)
        return self.ends[marks]

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            stem = word.rstrip(MARKS)
            if not stem.isalpha() or not (stem.isascii() or max(stem) < LATIN_END):
                ids = self.plain(self.before + word)
            elif len(stem) < len(word):
                ids = self[stem] + self.end(word[len(stem):])
            else:
                spelt = word if word.isascii() else self.spelt(word)
                ids = array("I", [t.id for t in self.model.tokenize(self.head + spelt)]).tobytes()
        self[word] = ids
        return ids

    def turn(self, most: int) -> None:
        if len(self) > most:
            self.old = dict(self)
            self.clear()


class TextIds:
    """Ids of whole texts, exactly as the tokenizer itself gives them, put together from the ids of words."""

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        self.later, self.first = WordIds(tokenizer, " "), WordIds(tokenizer, "")
        self.line_end = self.first.plain("\n")

    def line(self, words: list[str]) -> bytes:
        return self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:]))

    def encode(self, text: str) -> bytes:
        self.later.turn(CACHED_WORDS * 4 // 10), self.first.turn(CACHED_WORDS // 10)
        if WIDE_SPACE.search(text):
            return self.line(SINGLE_SPACE.split(text))
        return self.line_end.join([self.line(x.split(" ")) for x in text.split("\n")])


@lru_cache(maxsize=2)
def text_ids(path: str) -> TextIds:
    return TextIds(path)


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """``id, part, local_start, n_tokens, ids`` in ascending id order over all partitions; ``part`` is the partition's number.

    Every text gets ``end_id`` behind its ids; NULL counts as empty. NULL ids come last; rows that repeat an id follow each other by
    a hash of their texts, and no number of them lands in one task.
    """
    def run(iterator):
        encode, total = text_ids(public_tokenizers.path(tokenizer)).encode, 0
        end = array("I", [end_id]).tobytes()
        for batch in slices(iterator):
            rows = [encode(text or "") + end for text in batch.column(2).to_pylist()]
            n = np.array([len(x) // 4 for x in rows], np.int64)
            ends = np.cumsum(n)
            ids = pa.Array.from_buffers(pa.int32(), int(n.sum()), [None, pa.py_buffer(b"".join(rows))])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(total + ends - n), pa.array(n), lists],
                ["id", "part", "local_start", "n_tokens", "ids"])
            total += int(n.sum())

    rows = in_small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"),
                                       F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_last(), "hash", "row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = df.schema[id_col].dataType.simpleString()
    return ranged.select("id", F.spark_partition_id().alias("part"), "text").mapInArrow(run, f"id {kind}, {COLUMNS}")


def write_tokens(rows: DataFrame, folder: str, encoding: str = "delta", group_bytes: int = 32 << 20, page_bytes: int = 128 << 10,
                 page_rows: int = 1000) -> None:
    """Write ``encoded`` rows and their manifest (``part, first_token, n_documents``) under ``folder``.

    ``encoding`` of the ids is ``delta`` or ``dictionary``; row groups hold about ``group_bytes``, pages at most ``page_bytes`` and
    ``page_rows`` rows. An empty table gives files without rows and an empty manifest.
    """
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"unknown encoding {encoding}")
    writer = rows.write.option("compression", "zstd")
    for key, value in {
        "parquet.writer.version": "v2", "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
        "parquet.block.size": str(group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows),
    }.items():
        writer = writer.option(key, value)
    writer.parquet(f"{folder}/tokens")
    sizes = rows.sparkSession.read.parquet(f"{folder}/tokens").groupBy("part").agg(
        F.sum("n_tokens").alias("n"), F.count("*").alias("n_documents"))
    # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_token"), "n_documents").coalesce(1).write.parquet(
        f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str, low=None, high=None) -> DataFrame:
    """``id, start, n_tokens, ids`` of the documents with ids from ``low`` to ``high``; ``start`` counts the ids of all documents before.

    Without ``ids`` only the metadata columns are read; the id range reaches the page indexes.
    """
    rows, manifest = spark.read.parquet(f"{folder}/tokens"), spark.read.parquet(f"{folder}/manifest")
    if low is not None:
        rows = rows.where(F.col("id") >= low)
    if high is not None:
        rows = rows.where(F.col("id") <= high)
    # the manifest has one row per file
    return rows.join(F.broadcast(manifest), "part").select(
        "id", (F.col("first_token") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def with_checksums(rows: DataFrame) -> DataFrame:
    """``id, start, n_tokens, ids_crc32``: number and CRC-32 of the ids as they stand in ``rows``."""
    def run(iterator):
        for batch in iterator:
            lists = batch.column(2)
            ends = np.asarray(lists.offsets)
            values = np.asarray(lists.values).view("<u4")
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                                             ["id", "start", "n_tokens", "ids_crc32"])

    kind = rows.schema["id"].dataType.simpleString()
    return in_small_batches(rows).select("id", "start", "ids").mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long")


def stored_documents(df: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
                     **layout) -> DataFrame:
    """Encode and write every row of ``df`` and read it back (``id, start, n_tokens, ids_crc32``).

    Files lie in ``folder`` (default: a new one in the shared folder). Other columns of ``df`` are ignored.
    """
    folder = folder or os.path.join(durable_dir(df.sparkSession), f"tokens-{uuid.uuid4().hex}")
    write_tokens(encoded(df, id_col, text_col, tokenizer), folder, **layout)
    return with_checksums(read_tokens(df.sparkSession, folder))
