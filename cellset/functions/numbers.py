"""Scalar helpers: undefined values, guarded ratios, text forms of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def defined(x: Column) -> Column:
    """NaN becomes NULL, so aggregates skip it instead of being poisoned by it."""
    return F.nanvl(x, F.lit(None).cast("double"))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x.cast("double"), digits)


def compact(x: Column) -> Column:
    """Ten significant digits without trailing zeros, the number form of written reports, rounded as C's ``%.10g`` does.

    A double is rounded by its exact value, and an exact half to the even digit. Java's formats round the shortest text of the
    number, halves up, so they differ where this text has eleven digits and ends in 5.
    """
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(lambda v: f"{v:.10g}").astype(object)

    text.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    value = x.cast("double")
    written = F.pandas_udf(text, "string")(value)
    return F.when(value.isNull() | F.isnan(value), "NaN").when(value == 0, "0").otherwise(written)


def correlation(x: Column, y: Column) -> Column:
    """Aggregate Pearson correlation; NULL when either side is constant or there are no rows."""
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
