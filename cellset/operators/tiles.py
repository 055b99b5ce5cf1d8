"""Pairwise work inside groups without emitting pairs.

Members of a group are packed into blocks of about ``BLOCK`` vectors; block meets block in an Arrow task that returns
a few numbers. A hot group simply has more blocks, spread over tasks by (group, block).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellset.operators.scale import dense_index
from cellset.session import materialize

BLOCK = 256
#: A group is cut into this many blocks, so that each vector is sent so often however large the group is ...
GRID = 8
#: ... but no block holds more vectors than this on average.
MAX_BLOCK = 16_384
#: Distances that a task holds at once.
HELD = 1 << 20
#: Pairs of a triangle whose ranks a task finds at once, and pairs that it counts them against at once; 36 and 8 bytes a pair.
HELD_PAIRS = 1 << 23
STRIP_PAIRS = 1 << 24
#: A triangle's vectors are sent to this many tasks at most, however many parts it has.
SENT = 32
#: Distances that are computed at once, so that they stay in a core's cache.
TILE = 1 << 15
#: Bytes of an Arrow batch: a row with two large blocks comes alone.
BATCH_BYTES = 8 << 20
BINS = 1024


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on group keys, of which NULL is one."""
    side = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.lit(True))
    return left.join(side, same, how).drop(*[f"_k_{k}" for k in keys])


def blocks(df: DataFrame, keys: list[str], row_id: str, vector: str, block: int = BLOCK) -> DataFrame:
    """``keys, block, blocks, ids, flat``: members packed by a hash of their id.

    Blocks of about ``block`` members, ``GRID`` of them at most, unless these would hold more than ``MAX_BLOCK``: meeting each other,
    blocks are sent as often as a group has blocks. Vectors keep their type; tasks compute in doubles.
    """
    n = F.count("*")
    sizes = df.groupBy(*keys).agg(F.greatest(F.least(F.ceil(n / block), F.lit(GRID)), F.ceil(n / MAX_BLOCK)).alias("blocks"))
    placed = join_groups(df, sizes, keys).withColumn("block", F.pmod(F.xxhash64(row_id), F.col("blocks")))
    packed = placed.select(*keys, "block", "blocks", F.struct(F.col(row_id).alias("i"), F.col(vector).alias("v")).alias("m"))
    return packed.groupBy(*keys, "block", "blocks").agg(F.collect_list("m").alias("m")).select(
        *keys, "block", "blocks", F.transform("m", lambda m: m.getField("i")).alias("ids"),
        F.flatten(F.transform("m", lambda m: m.getField("v"))).alias("flat"))


def block_pairs(a: DataFrame, b: DataFrame, keys: list[str], triangle: bool = False, on: list[str] | None = None
                ) -> DataFrame:
    """Every block of ``a`` next to every block of ``b`` of the same group, distributed by (group, b-block).

    ``b`` may be grouped by fewer keys (``on``), as a pool shared by many groups of ``a``; it is packed only once.
    """
    on = on or keys
    counts = b.select(*on, F.col("blocks").alias("_nb")).distinct()
    left = join_groups(a, counts, on).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)))
    if triangle:
        left = left.where(F.col("block") <= F.col("_b"))
    left = left.select(*keys, "_b", F.col("block").alias("a_block"), F.col("ids").alias("a_ids"),
                       F.col("flat").alias("a_flat"))
    right = b.select(*on, F.col("block").alias("_b"), F.col("ids").alias("b_ids"), F.col("flat").alias("b_flat"))
    return join_groups(left, right, [*on, "_b"]).withColumnRenamed("_b", "b_block")


def pair_distances(x, y, metric: str):
    """All distances between the rows of two matrices."""
    import numpy as np

    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        return x @ y.T
    squares = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(squares, 0.0))


def strips(a, b, step: int | None = None):
    """``(from, to)`` of the rows of ``a`` that meet all of ``b`` at once."""
    step = step or max(1, HELD // max(len(b), 1))
    for at in range(0, len(a), step):
        yield at, min(at + step, len(a))


def column_reader(batch, k: int):
    """Reads list columns of one row of a batch; numbers of vectors come out as doubles."""
    import numpy as np

    def get(name):
        values = batch.column(name)[k].values.to_numpy(zero_copy_only=False)
        return values.astype(np.float64, copy=False) if name.endswith("flat") else values

    return get


def bin_counts(d, lo: float, hi: float, bins: int):
    """``(bins, counts, smallest, largest)`` of the values of ``d`` inside ``[lo, hi]``, for the bins that hold any."""
    import numpy as np

    inside = d[(d >= lo) & (d <= hi)]
    step = (hi - lo) / bins
    place = np.minimum((inside - lo) / step, bins - 1).astype(np.int64) if step > 0 else np.zeros(len(inside), np.int64)
    used, back = np.unique(place, return_inverse=True)
    least, most = np.full(len(used), np.inf), np.full(len(used), -np.inf)
    np.minimum.at(least, back, inside)
    np.maximum.at(most, back, inside)
    return used, np.bincount(back, minlength=len(used)), least, most


def _reduce_pairs(pairs: DataFrame, keys: list[str], dim: int, metric: str, mode: str, triangle: bool) -> DataFrame:
    """One Arrow pass over block pairs. ``moments``: n, s, ss, lo, hi. ``bins``: for each of the row's intervals (arrays ``target``,
    ``lo``, ``hi``) the bins that hold distances, with their counts and ends."""
    schema = {"moments": "n long, s double, ss double, lo double, hi double",
              "bins": "target int, bin int, c long, lo double, hi double"}[mode]
    fields = pairs.select(*keys).schema
    bounds = [] if mode == "moments" else ["target", "lo", "hi"]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kinds = {"n": pa.int64(), "c": pa.int64(), "target": pa.int32(), "bin": pa.int32()}
        for batch in batches:
            take, out = [], []
            for k in range(batch.num_rows):
                get = column_reader(batch, k)
                a, b = get("a_flat").reshape(-1, dim), get("b_flat").reshape(-1, dim)
                a_ids, b_ids = get("a_ids"), get("b_ids")
                same = batch.column("a_block")[k].as_py() == batch.column("b_block")[k].as_py()
                for lo_row, hi_row in strips(a, b):
                    d = pair_distances(a[lo_row:hi_row], b, metric)
                    d = d[a_ids[lo_row:hi_row, None] < b_ids[None, :]] if triangle and same else d.ravel()
                    if mode == "moments":
                        take.append(k)
                        out.append((d.size, float(d.sum()), float((d * d).sum()), float(d.min()) if d.size else None,
                                    float(d.max()) if d.size else None))
                        continue
                    for target, lo, hi in zip(*(batch.column(c)[k].as_py() for c in bounds), strict=True):
                        for x in zip(*bin_counts(d, lo, hi, BINS), strict=True):
                            take.append(k)
                            out.append((target, *x))
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name).take(rows) for name in keys],
                 *[pa.array([row[i] for row in out], kinds.get(name, pa.float64())) for i, name in enumerate(names)]], [*keys, *names])

    extra = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    full = f"{extra}, {schema}" if extra else schema
    pairs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return pairs.select(*keys, "a_block", "b_block", "a_ids", "a_flat", "b_ids", "b_flat", *bounds).mapInArrow(run, full)


def pair_moments(pairs: DataFrame, keys: list[str], dim: int, metric: str = "euclidean", triangle: bool = False
                 ) -> DataFrame:
    """Count, sum, sum of squares, smallest and largest distance of each group."""
    parts = _reduce_pairs(pairs, keys, dim, metric, "moments", triangle)
    return parts.groupBy(*keys).agg(F.sum("n").alias("pairs"), F.sum("s").alias("total"), F.sum("ss").alias("squares"),
                                    F.min("lo").alias("min"), F.max("hi").alias("max"))


def pair_median(pairs: DataFrame, moments: DataFrame, keys: list[str], dim: int, metric: str, triangle: bool
                ) -> DataFrame:
    """Exact median of all pair distances of each group, as ``keys, median``.

    Each of the two middle ranks has an interval that holds its distance. A pass counts the distances in ``BINS`` bins of it,
    and the bin that the rank falls into, cut to the distances it really holds, is the next interval, until that is one
    value. Only counts leave a task; the number of passes grows with the logarithm of the number of pairs.
    """
    ranks = F.array(F.struct(F.lit(0).alias("target"), F.floor((F.col("pairs") - 1) / 2).alias("rank")),
                    F.struct(F.lit(1).alias("target"), F.floor(F.col("pairs") / 2).alias("rank")))
    state = materialize(moments.where("pairs > 0").select(
        *keys, F.inline(ranks), F.lit(0).cast("long").alias("below"), F.col("min").alias("lo"), F.col("max").alias("hi")))
    done = state.where("lo >= hi")
    while not (left := state.where("lo < hi")).isEmpty():
        # one row per group, with an interval for each open rank
        wanted = left.groupBy(*keys).agg(F.collect_list(F.struct("target", "lo", "hi")).alias("_w")).select(
            *keys, *[F.col(f"_w.{c}").alias(c) for c in ("target", "lo", "hi")])
        counts = _reduce_pairs(join_groups(pairs, wanted, keys), keys, dim, metric, "bins", triangle).groupBy(*keys, "target", "bin").agg(
            F.sum("c").alias("c"), F.min("lo").alias("bin_lo"), F.max("hi").alias("bin_hi"))
        upto = Window.partitionBy(*keys, "target").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # BINS rows a rank
        joined = join_groups(left, counts.withColumn("_upto", F.sum("c").over(upto)), [*keys, "target"])
        hit = F.col("below") + F.col("_upto") > F.col("rank")
        # a distance that a pass computes differently in its last digit can't leave a rank without a bin
        place = F.struct((~hit).alias("missed"), F.when(hit, F.col("bin")).otherwise(-F.col("bin")).alias("at"))
        found = F.struct((F.col("below") + F.col("_upto") - F.col("c")).alias("below"), F.col("bin_lo").alias("lo"), F.col("bin_hi").alias("hi"))
        state = materialize(joined.groupBy(*keys, "target", "rank").agg(F.min_by(found, place).alias("_f")).select(
            *keys, "target", "rank", "_f.below", "_f.lo", "_f.hi"))
        done = done.unionByName(state.where("lo >= hi"))
    return done.groupBy(*keys).agg((F.sum("lo") / 2).alias("median"))


def triangle_strips(vectors, ids, first: int, last: int, size: int):
    """Distances of the pairs ``first`` to ``last`` of a triangle (row by row), ``size`` at a time, in a buffer that is used again.

    ``vectors`` has a column per vector. Squares are added component by component, so equal vectors have equal distances wherever they
    stand. Vectors of one id form no pair.
    """
    import numpy as np

    n = len(ids)
    starts = np.arange(n, dtype=np.int64)
    starts = starts * (2 * n - starts - 1) // 2
    repeated = len(np.unique(ids)) < n
    at, end = int(np.searchsorted(starts, first, "right")) - 1, int(np.searchsorted(starts, last, "left"))
    work = np.empty((2, max(TILE, n)))
    buffer, filled = np.empty(size), 0
    while at < end:
        wide = n - at - 1
        to = min(end, at + max(1, TILE // max(wide, 1)))
        total, square = [w[:(to - at) * wide].reshape(to - at, wide) for w in work]
        total.fill(0)
        for component in vectors:
            np.subtract(component[at:to, None], component[None, at + 1:], out=square)
            np.multiply(square, square, out=square)
            np.add(total, square, out=total)
        np.sqrt(total, out=total)
        for row in range(at, to):
            begin = int(starts[row])
            lo, hi = max(first - begin, 0), min(last - begin, n - row - 1)
            found = total[row - at, row - at + lo:row - at + hi]
            if repeated:
                found = found[ids[row + 1 + lo:row + 1 + hi] != ids[row]]
            while len(found):
                took = min(size - filled, len(found))
                buffer[filled:filled + took] = found[:took]
                found, filled = found[took:], filled + took
                if filled == size:
                    yield buffer
                    filled = 0
        at = to
    if filled:
        yield buffer[:filled]


def add_ranks(ranks, held, strip) -> None:
    """Adds to ``ranks`` how many values of ``strip`` are below each of ``held`` and how many aren't above it; both are sorted."""
    import numpy as np

    for at in range(0, len(held), HELD):
        part = held[at:at + HELD]
        equal = lambda place: (place < len(strip)) & ~(strip.take(place, mode="clip") > part)  # noqa: E731  NaN is equal to NaN
        below = np.searchsorted(strip, part, "left")
        upto = below + equal(below)
        more = (upto > below) & equal(upto)
        if more.any():
            upto[more] = np.searchsorted(strip, part[more], "right")
        ranks[at:at + HELD] += below + upto


def triangle_sums(halves, ids, first: int, last: int, size: int) -> list | None:
    """Of the pairs ``first`` to ``last``: number, ends of both distances, and sums of squares and products of distances and of twice the
    average ranks, all taken from their means over the whole triangle. Each rank is counted against all distances, computed anew by strips."""
    import numpy as np

    x, y = [next(triangle_strips(half, ids, first, last, max(last - first, 1)), None) for half in halves]
    if x is None:
        return None
    order = np.argsort(x)
    x.sort()
    y = y[order]
    order = np.argsort(y)
    y.sort()
    partner = np.empty(len(order), np.int32)  # place in y of the pair of each x
    partner[order] = np.arange(len(order), dtype=np.int32)
    del order
    whole = len(ids) * (len(ids) - 1) // 2

    def counted(half, held):
        """Mean of all distances, and for each of ``held`` how many are below, and not above: twice its average rank, less one."""
        ranks, total, pairs = np.zeros(len(held), np.int64), 0.0, 0
        for strip in triangle_strips(half, ids, 0, whole, min(size, whole)):
            total, pairs = total + float(strip.sum()), pairs + len(strip)
            strip.sort()
            add_ranks(ranks, held, strip)
        return total / pairs, ranks, float(pairs)

    def sums(a, a_mean, b, b_mean):
        out = np.zeros(3)
        for at in range(0, len(a), HELD):
            p, q = a[at:at + HELD] - a_mean, b[partner[at:at + HELD]] - b_mean
            out += (p * p).sum(), (q * q).sum(), (p * q).sum()
        return out.tolist()

    x_mean, x_ranks, pairs = counted(halves[0], x)
    y_mean, y_ranks, _ = counted(halves[1], y)
    return [len(x), *[float(v) for v in (x[0], x[-1], y[0], y[-1])], *sums(x, x_mean, y, y_mean), *sums(x_ranks, pairs, y_ranks, pairs)]


#: Columns of ``triangle_parts`` behind the keys.
SUMS = ["n", "x_min", "x_max", "y_min", "y_max", "xx", "yy", "xy", "rank_xx", "rank_yy", "rank_xy"]


def triangle_parts(packed: DataFrame, keys: list[str], split: int, dim: int) -> DataFrame:
    """``triangle_sums`` of the pair distances of each group, in the first ``split`` and in the other components, as ``keys`` and ``SUMS``.

    A part is ``HELD_PAIRS`` pairs of a group, which its task holds with the group's vectors. No pair leaves a task: a group's distances are
    computed once per part. Beyond ``SENT`` parts a task takes several of them, one after the other, so a group's vectors are sent so often
    at most.
    """
    n = F.sum(F.size("ids"))
    sizes = packed.groupBy(*keys).agg((n * (n - 1) / 2).cast("long").alias("_pairs")).where("_pairs > 0")
    shares = sizes.withColumn("_shares", F.least(F.ceil(F.col("_pairs") / HELD_PAIRS), F.lit(SENT))).withColumn(
        "_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1)))
    numbered = dense_index(shares, [*keys, "_share"], "_unit")
    seen = numbered.agg(F.count("*").alias("units"), F.sum("_pairs").alias("work")).first()
    # small groups share a task; a share of a large one is a task
    tasks = max(1, min(seen.units, max(packed.sparkSession.sparkContext.defaultParallelism, (seen.work or 0) // HELD_PAIRS)))
    dealt = join_groups(numbered, packed, keys).repartitionById(tasks, F.pmod("_unit", F.lit(tasks)).cast("int"))
    fields = packed.select(*keys).schema
    held, strip = HELD_PAIRS, STRIP_PAIRS

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def finished(unit):
            (share, shares), head, members = unit
            ids = np.concatenate([m[0] for m in members])
            v = np.ascontiguousarray(np.concatenate([m[1].reshape(-1, dim) for m in members]).T)
            whole = len(ids) * (len(ids) - 1) // 2
            for first in range(share * held, whole, shares * held):
                if found := triangle_sums([v[:split], v[split:]], ids, first, min(first + held, whole), strip):
                    yield pa.RecordBatch.from_arrays([*head, pa.array(found[:1], pa.int64()), *[pa.array([f], pa.float64()) for f in found[1:]]],
                                                     [*keys, *SUMS])

        number, unit = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                if (at := batch.column("_unit")[k].as_py()) != number:
                    if unit:
                        yield from finished(unit)
                    dealt_out = [batch.column(c)[k].as_py() for c in ("_share", "_shares")]
                    number, unit = at, (dealt_out, [batch.column(c).slice(k, 1) for c in keys], [])
                get = column_reader(batch, k)
                unit[2].append((get("ids"), get("flat")))
        if unit:
            yield from finished(unit)

    extra = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    packed.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # all shares of a group read its blocks in one order, so that they count its pairs alike
    ordered = dealt.sortWithinPartitions("_unit", "block").select(*keys, "_unit", "_share", "_shares", "ids", "flat")
    return ordered.mapInArrow(run, f"{extra}n long, " + ", ".join(f"{c} double" for c in SUMS[1:]))
