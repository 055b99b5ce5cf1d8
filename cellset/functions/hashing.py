"""Seeded SHA-256 keys: the same text gives the same order on every run and every cluster size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def seeded_hash(*parts: Column | str | int, seed: int = SEED) -> Column:
    """Hex SHA-256 of ``seed|part|part``; text parts are literals, numbers use Spark's own text form."""
    columns = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *columns), 256)


def locator_text(file: Column, row: Column) -> Column:
    return F.concat_ws("|", F.concat(F.lit("file="), file), F.concat(F.lit("row="), row.cast("string")))


def cell_key(version: str, locator: Column) -> Column:
    """Stable cell identity derived from where the row is stored."""
    return F.sha2(F.concat(F.lit(version + "|"), locator), 256)
