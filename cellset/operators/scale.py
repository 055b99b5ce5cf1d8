"""Building blocks that stay whole and even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellset.session import materialize


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """Evaluate costly columns once per row.

    Passing them through a generator keeps the optimizer from copying their expressions into every filter and
    projection above; no rows are added and nothing is shuffled.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns))))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a small file scan that sits in few row groups (only for plain scans: counting splits is free).

    A scan that already has at least as many splits as there are cores, which any large input has, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def ascending(keys: list[Column | str]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def placed(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """Global sort kept as a durable table with ``_part`` (range) and ``_row`` (place inside it).

    The order must be total. Range partitioning uses the whole key, so a hot leading key spreads over many
    partitions.
    """
    keys = ascending(order)
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = ranged.withColumn("_mark", F.monotonically_increasing_id())
    return materialize(marked.withColumns({
        "_part": F.shiftright("_mark", 33),
        "_row": F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1)),
    }).drop("_mark"))


def dense_index(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """0-based contiguous index in the given total order, without a single-partition window.

    Only the partition sizes (one row per range) go through the offset window.
    """
    table = placed(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = table.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (table.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before"))


def running_total(df: DataFrame, keys: list[str], order: list[Column | str], value: Column, name: str,
                  inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` inside ``keys`` by a total ``order``; a hot key is spread over ranges.

    The sum is local inside each range; ranges are then shifted by the totals of the ranges before them.
    """
    table = placed(df.withColumn("_value", value), [*keys, *order])
    local = Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    running = table.withColumn("_run", F.sum("_value").over(local))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = table.groupBy("_part", *keys).agg(F.sum("_value").alias("_sum"))
    shifts = totals.select("_part", *keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift"))
    on = running["_part"] == shifts["_part"]
    for key in keys:
        on = on & running[key].eqNullSafe(shifts[key])
    result = running.join(shifts, on).select(
        *[running[c] for c in running.columns], shifts["_shift"])
    total = F.col("_run") + F.col("_shift")
    if not inclusive:
        total = total - F.col("_value")
    return result.withColumn(name, total).drop("_part", "_row", "_value", "_run", "_shift")


def place_in_group(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """0-based place of each row in its group (cumulative count), safe for hot groups."""
    return running_total(df, keys, order, F.lit(1).cast("long"), name, inclusive=False)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int | Column, spread: Column,
                  shards: int = 32) -> DataFrame:
    """First ``n`` rows of each group by a total order.

    A first cut inside ``shards`` slices of each group leaves at most ``n * shards`` rows per group for the
    final cut. ``n`` may be a column that is constant in the group.
    """
    limit = n if isinstance(n, Column) else F.lit(n)
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(shards)))
    first = sliced.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order)))
    kept = first.where(F.col("_place") <= limit).drop("_place", "_slice")
    final = kept.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return final.where(F.col("_place") <= limit).drop("_place")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                    accuracy: int = 10_000) -> DataFrame:
    """Linearly interpolated exact quantiles per group, as ``keys, prob, quantile``.

    A sketch with a guaranteed rank error brackets each quantile; one more pass counts what lies below the
    bracket and ranks only the distinct values inside it, about ``4 / accuracy`` of a group.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))) \
             .select(*keys, F.col(value).cast("double").alias("_v"))
    margin = 2.0 / accuracy
    edges = [min(max(p + s * margin, 0.0), 1.0) for p in probs for s in (-1, 1)]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", edges, accuracy).alias("_e"))
    brackets = sketch.select(*keys, "_n", F.explode(F.array(*[
        F.struct(F.lit(float(p)).alias("prob"), F.col("_e")[2 * i].alias("lo"), F.col("_e")[2 * i + 1].alias("hi"))
        for i, p in enumerate(probs)])).alias("_b")).select(*keys, "_n", "_b.*")
    if keys:
        condition = None
        side = materialize(brackets).alias("b")
        for key in keys:
            test = F.col(f"r.{key}").eqNullSafe(F.col(f"b.{key}"))
            condition = test if condition is None else condition & test
        joined = rows.alias("r").join(side, condition).select(
            *[F.col(f"r.{k}").alias(k) for k in keys], "_v", "_n", "prob", "lo", "hi")
    else:
        packed = brackets.agg(F.collect_list(F.struct("_n", "prob", "lo", "hi")).alias("b")).scalar()
        joined = rows.select("_v", F.inline(packed))
    by = [*keys, "prob"]
    place = F.when(F.col("_v") < F.col("lo"), F.lit(-1)).when(F.col("_v") > F.col("hi"), F.lit(1)).otherwise(0)
    # one row per bracket side plus the distinct values inside the bracket and its two direct neighbours
    outer = joined.withColumn("_place", place)
    point = F.when(F.col("_place") == 0, F.col("_v"))
    counted = outer.groupBy(*by, "_n", "_place", point.alias("_point")).agg(
        F.count("*").alias("_c"), F.max("_v").alias("_max"), F.min("_v").alias("_min"))
    at = F.when(F.col("_place") == -1, F.col("_max")).otherwise(F.col("_min"))
    # ranges, not one window per quantile: a bracket holds a fixed share of the rows, however many these are
    ranked = running_total(counted.withColumn("_at", at), by, ["_at"], F.col("_c"), "_upto")
    target = F.col("prob") * (F.col("_n") - 1)
    low, high = F.floor(target), F.ceil(target)
    first = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_at")))
    picked = ranked.groupBy(*by).agg(first(low).alias("_lo"), first(high).alias("_hi"),
                                     F.max(target - low).alias("_w"))
    return picked.select(*by, (F.col("_lo") + F.col("_w") * (F.col("_hi") - F.col("_lo"))).alias("quantile"))


def with_previous(df: DataFrame, order: list[Column | str], column: str, name: str) -> DataFrame:
    """Value of ``column`` in the row before, by a global total order; NULL for the first row.

    ``lag`` runs inside each range; only the last value of every range crosses to the next one.
    """
    table = placed(df, order)
    local = Window.partitionBy("_part").orderBy("_row")
    ends = table.groupBy("_part").agg(F.max_by(column, "_row").alias("_end"))
    heads = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_head"))
    seen = table.withColumn("_lag", F.lag(column).over(local)).join(F.broadcast(heads), "_part")
    return seen.withColumn(name, F.when(F.col("_row") == 0, F.col("_head")).otherwise(F.col("_lag"))).drop(
        "_part", "_row", "_lag", "_head")


def with_last(df: DataFrame, order: list[Column | str], column: str, name: str) -> DataFrame:
    """Last value of ``column`` that isn't NULL in the rows before, by a global total order; NULL where there is none.

    Runs inside each range of the order; of a range only its last value crosses to the next ones, however many of these have none.
    """
    table = placed(df, order)
    local = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    ends = table.where(F.col(column).isNotNull()).groupBy("_part").agg(F.max_by(column, "_row").alias("_end"))
    parts = table.select("_part").distinct().join(ends, "_part", "left")
    # one row per range
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = parts.select("_part", F.last("_end", ignorenulls=True).over(earlier).alias("_head"))
    seen = table.withColumn("_last", F.last(column, ignorenulls=True).over(local)).join(F.broadcast(heads), "_part")
    return seen.withColumn(name, F.coalesce("_last", "_head")).drop("_part", "_row", "_last", "_head")


def first_in_order(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows by ``order`` (NULL first), found as a boundary and a filter, so whole rows are neither sorted nor written.

    A number's boundary comes from counts in bins that are refined until they hold one value; another key's from the counts of its
    values. Rows that share the boundary are told apart by the next key; rows equal in all keys are interchangeable.
    """
    if n <= 0:
        return df.limit(0)
    key, rest = ascending(order)[0], ascending(order)[1:]
    seen = df.agg(F.count("*").alias("n"), F.count(key).alias("known")).first()
    if n >= seen.n:
        return df
    unknown = seen.n - seen.known
    if n <= unknown:
        return first_of_equals(df.where(key.isNull()), rest, n)
    known = df.where(key.isNotNull())
    kind = df.select(key.alias("k")).schema["k"].dataType
    find = counted_boundary if not isinstance(kind, T.IntegralType) else binned_boundary
    boundary, before = find(known, key, n - unknown)
    value = F.lit(boundary).cast(kind)
    within = df.where(key.isNull() | (key < value))
    return within.unionByName(first_of_equals(known.where(key == value), rest, n - unknown - before))


def first_of_equals(tied: DataFrame, rest: list[Column], n: int) -> DataFrame:
    if rest:
        return first_in_order(tied, rest, n)
    if tied.count() == n:
        return tied
    return dense_index(tied, [F.monotonically_increasing_id()], "_i").where(F.col("_i") < n).drop("_i")


def binned_boundary(df: DataFrame, key: Column, n: int, bins: int = 1024) -> tuple[int, int]:
    """Value of the ``n``-th smallest whole number and how many are smaller; each turn returns ``bins`` counts at most."""
    value = key.cast("decimal(20,0)")
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    before = 0
    while lo < hi:
        width = (hi - lo) // bins + 1
        bin_of = F.floor((value - F.lit(lo).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)"))
        counts = df.where(key.between(lo, hi)).groupBy(bin_of.alias("bin")).agg(
            F.count("*").alias("c"), F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy("bin").collect()
        for r in counts:
            if before + r.c >= n:
                break
            before += r.c
        lo, hi = r.lo, r.hi
    return lo, before


def counted_boundary(df: DataFrame, key: Column, n: int) -> tuple[object, int]:
    """The same for any other key, from the counts of its values."""
    counts = df.groupBy(key.alias("k")).agg(F.count("*").alias("c"))
    upto = running_total(counts, [], ["k"], F.col("c"), "upto")
    found = upto.where(F.col("upto") >= n).agg(F.min_by(F.struct("k", (F.col("upto") - F.col("c")).alias("before")), "upto").alias("r")).first().r
    return found.k, found.before


def set_digest(key: Column) -> Column:
    """Digest of a set of rows, mergeable and independent of row order: XOR of the four quarters of each SHA-256."""
    text = F.sha2(key, 256)
    quarter = lambda i: F.lpad(F.lower(F.hex(F.bit_xor(
        F.conv(F.substring(text, 1 + 15 * i, 15), 16, 10).cast("long")))), 15, "0")
    return F.concat(*[quarter(i) for i in range(4)])
