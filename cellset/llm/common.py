"""Shared helpers: column names, byte texts inside Arrow tasks, stable uniform numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; ``bytes.split()`` splits at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that no column of ``df`` has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; NULL counts as empty."""
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def ascii_lower(text: bytes) -> bytes:
    """Lower-case A-Z and nothing else."""
    return text.lower()


def byte_text(column: str) -> Column:
    """Text as bytes, so that Arrow tasks get it without decoding."""
    return F.col(column).cast("binary")


#: Bytes of one Arrow batch. Tasks hold a batch several times over (in both processes, and as Python objects).
BATCH_BYTES = 8 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df`` itself; its session sends at most ``BATCH_BYTES`` (and one row at least) to a Python task at once."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def slices(iterator: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Small pieces of Arrow batches, for tasks whose output is larger than their input."""
    for batch in iterator:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def uniform(seed: str, *columns: str) -> Column:
    """Number in (0, 1) from an MD5 of seed and columns: equal on every run, cluster and partitioning."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    head = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (head + F.lit(0.5)) / F.lit(float(1 << 52))
