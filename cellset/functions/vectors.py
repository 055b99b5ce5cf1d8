"""Expressions on ``array<float>`` columns; all stay inside the JVM and need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-12  # fixed value: smallest norm product of a cosine


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def count_where(v: Column, test) -> Column:
    return F.aggregate(v, F.lit(0), lambda s, x: s + F.when(test(x), 1).otherwise(0))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l1_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def l2_distance(a: Column, b: Column) -> Column:
    return l2_norm(difference(a, b))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(l2_norm(a) * l2_norm(b), F.lit(FLOOR))


def mean_abs_error(a: Column, b: Column) -> Column:
    return l1_distance(a, b) / F.size(a)


def mean_sq_error(a: Column, b: Column) -> Column:
    d = difference(a, b)
    return dot(d, d) / F.size(a)


def shifted(base: Column, step: Column, scale: Column) -> Column:
    """``base + step * scale`` element by element."""
    return F.zip_with(base, step, lambda x, y: x.cast("double") + y.cast("double") * scale)


def nonnegative(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))


def constant(v: Column) -> Column:
    return F.array_min(v) == F.array_max(v)


def centred(v: Column) -> Column:
    """Deviations from the mean; the mean is the element of a one-element array, so it is computed once per row."""
    mean = F.array(total(v) / F.size(v))
    return F.flatten(F.transform(mean, lambda m: F.transform(v, lambda x: x.cast("double") - m)))


def pearson(a: Column, b: Column) -> Column:
    """Correlation across the elements of two vectors; NULL when either is constant."""
    ca, cb = centred(a), centred(b)
    value = F.try_divide(dot(ca, cb), l2_norm(ca) * l2_norm(cb))
    return F.when(~constant(a) & ~constant(b), value)


def all_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def mean_vectors(df: DataFrame, keys: list[str], column: str, dim: int, name: str = "mean", chunk: int = 64,
                 weight: Column | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Element-wise mean of a fixed-width vector column per key.

    Every element is its own partial aggregate, so map tasks send one short row per key and a hot key costs no
    more than a cold one. Wide vectors are cut into chunks of ``chunk`` elements to keep the aggregate narrow.
    ``weight`` restricts (NULL/0 rows are left out) without a second pass. ``extra`` adds further aggregates.
    """
    extra = extra or {}
    pick = (lambda e: e) if weight is None else (lambda e: F.when(weight, e))
    if dim <= chunk:
        means = [F.avg(pick(F.col(column)[i].cast("double"))) for i in range(dim)]
        return df.groupBy(*keys).agg(F.array(*means).alias(name), *[c.alias(k) for k, c in extra.items()])
    width = -(-dim // chunk)
    pieces = (df if weight is None else df.where(weight)).select(*keys, F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda c: F.slice(F.col(column), c * chunk + 1, chunk))).alias("piece", "part"))
    parts = pieces.groupBy(*keys, "piece").agg(F.array(*[
        F.avg(F.try_element_at("part", F.lit(i + 1)).cast("double")) for i in range(chunk)]).alias("part"))
    whole = F.array_sort(F.collect_list(F.struct("piece", "part")))
    joined = F.flatten(F.transform(whole, lambda p: p.getField("part")))
    wide = parts.groupBy(*keys).agg(F.slice(joined, 1, dim).alias(name))
    if not extra and weight is None:
        return wide
    # further aggregates, and groups without any weighted row, come from one narrow pass over the rows
    rest = df.groupBy(*keys).agg(F.count("*").alias("_rows"), *[c.alias(k) for k, c in extra.items()])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}"))
    return rest.alias("r").join(wide.alias("w"), same, "left").select(
        *[F.col(f"r.{k}") for k in keys], F.coalesce(F.col(f"w.{name}"), F.array_repeat(F.lit(None).cast("double"), dim)).alias(name),
        *[F.col(f"r.{k}") for k in extra])
