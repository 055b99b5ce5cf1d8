"""File splits, shuffles and deterministic set sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellset.functions.hashing import SEED, seeded_hash
from cellset.operators.aggregates import membership_rows, membership_text
from cellset.operators.joins import expand_ranges
from cellset.operators.scale import dense_index, top_per_group
from cellset.operators.setops import set_relation
from cellset.operators.tiles import join_groups
from cellset.session import materialize


def split_files(files: DataFrame, path: str, rows_per_file: int, val_rows: int, workers: int) -> DataFrame:
    """First files in path order go to validation: enough for ``val_rows`` and two per worker, at most half."""
    ordered = dense_index(files.select(path), [path], "ordinal")
    n = files.agg(F.count("*").alias("n")).scalar()
    wanted = max(-(-val_rows // rows_per_file), 2 * workers)
    val = F.least(F.lit(wanted), F.floor(n / 2))
    return ordered.withColumn("_val", val).withColumn(
        "split", F.when(F.col("ordinal") < F.col("_val"), "val").otherwise("train")).drop("_val")


def check_subset(files: DataFrame, manifest: DataFrame, path: str) -> DataFrame:
    """Frozen file choice against the current split: same validation list, selected within the pool, no copies."""
    val = set_relation(files.where("split = 'val'"), manifest.where("split = 'val'"), path).select(
        F.col("equal").alias("val_equal"))
    pool = set_relation(manifest.where("split = 'train'"), files.where("split = 'train'"), path).select(
        F.col("subset").alias("selected_in_pool"), (F.col("first") / F.col("second")).alias("coverage"))
    copies = manifest.agg((F.count(path) == F.count_distinct(path)).alias("no_copies"))
    one = lambda df, c: df.select(c).scalar()
    return val.select("val_equal", one(pool, "selected_in_pool").alias("selected_in_pool"),
                      one(pool, "coverage").alias("coverage"), one(copies, "no_copies").alias("no_copies"))


def shard_of(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return dense_index(df, order, "ordinal").withColumn("shard", F.pmod("ordinal", F.lit(n)))


def keyed_shuffle(df: DataFrame, key: str, epoch: int, seed: int = SEED) -> DataFrame:
    """Full deterministic permutation: position in the order of the seeded hash of the key."""
    hashed = df.withColumn("_hash", F.sha2(F.concat_ws("|", F.lit(str(seed + epoch)), F.col(key).cast("string")), 256))
    return dense_index(hashed, ["_hash", key], "position").drop("_hash")


def draw_priority(seed: int = SEED) -> Column:
    return seeded_hash("set", F.col("epoch"), F.col("pair_id"), F.col("side"), F.col("cell_index"), seed=seed)


def sample_sets(sides: DataFrame, n: int, epochs: list[int], mode: str = "hash", seed: int = SEED,
                namespace: str = "cellset_v1") -> DataFrame:
    """Draw ``n`` cells without replacement for every (pair, side, epoch): ``pair_id, side, epoch, cell_index``.

    ``sides`` has ``pair_id, side, start, stop``. A range smaller than ``n`` fails the job. Mode ``hash`` orders the
    range by a seeded hash (pools must be capped first, as pools are shared); mode ``pcg64`` draws positions with
    numpy's PCG64 from the first eight bytes of the SHA-256 of the payload and costs O(n) whatever the range size.
    """
    size = F.col("stop") - F.col("start")
    enough = F.assert_true(size >= n, F.concat(F.lit("pool smaller than the set: "), "pair_id", F.lit(" "), "side")).isNull()
    rows = sides.where(enough).withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in epochs])))
    if mode == "hash":
        return hash_draw(rows, n, seed)
    if mode != "pcg64":
        raise ValueError(mode)
    payload = F.concat(F.lit(f"{namespace}|seed={seed}|epoch="), F.col("epoch").cast("string"), F.lit("|pair_id="),
                       "pair_id", F.lit("|side="), "side")
    draw = _pcg64_draw(n)
    table = rows.withColumn("_members", draw(F.unhex(F.substring(F.sha2(payload, 256), 1, 16)), F.col("start"),
                                             F.col("stop")))
    return table.select("pair_id", "side", "epoch", F.explode("_members").alias("cell_index"))


def hash_draw(rows: DataFrame, n: int, seed: int = SEED, margin: float = 6.0) -> DataFrame:
    """The ``n`` cells of smallest hash of each range, exactly.

    Hashes are uniform, so those below a share of about ``n / size`` hold the answer; only they are sorted. A range that has fewer
    than ``n`` of them (with a probability below 1e-9) is drawn again with all its cells.
    """
    keys = ["pair_id", "side", "epoch"]
    bits = 48
    size = F.sum(F.col("stop") - F.col("start")).over(Window.partitionBy(*keys))  # one row per range
    share = F.least(F.lit(1.0), F.lit(n + margin * math.sqrt(n) + margin * margin) / size)
    limit = F.lower(F.lpad(F.hex(F.floor(share * F.lit(float(1 << bits)))), bits // 4 + 1, "0"))

    def draw(ranges: DataFrame, cut: bool) -> DataFrame:
        bounded = ranges.withColumn("_limit", limit) if cut else ranges
        cells = expand_ranges(bounded, [*keys, *(["_limit"] if cut else [])]).withColumn("_hash", draw_priority(seed))
        if cut:
            cells = cells.where(F.concat(F.lit("0"), "_hash") < F.col("_limit")).drop("_limit")
        return top_per_group(cells, keys, [F.col("_hash"), F.col("cell_index")], n, F.col("cell_index")).drop("_hash")

    ranges = materialize(rows)
    first = materialize(draw(ranges, True))
    whole = first.groupBy(*keys).agg(F.count("*").alias("_drawn")).where(F.col("_drawn") == n)
    short = join_groups(ranges, whole, keys, "left_anti")
    if short.isEmpty():
        return first
    return join_groups(first, short.select(*keys).distinct(), keys, "left_anti").unionByName(draw(short, False))


def _pcg64_draw(n: int):
    """Arrow function (seed bytes, start, stop) -> n distinct positions in ascending order."""
    def draw(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        for seeds, starts, stops in batches:
            out = []
            for raw, start, stop in zip(seeds, starts, stops):
                generator = np.random.Generator(np.random.PCG64(int.from_bytes(raw, "big")))
                out.append(np.sort(generator.choice(stop - start, size=n, replace=False)).astype(np.int64) + start)
            yield pd.Series(out)

    from typing import Tuple

    import pandas as pd
    draw.__annotations__ = {"batches": Iterator[Tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(draw, "array<bigint>")


def sampling_audit(sets: DataFrame, n: int) -> DataFrame:
    """Size, uniqueness and digest of every drawn set, and whether the draw changed from the epoch before."""
    rows = sets.groupBy("pair_id", "side", "epoch").agg(
        F.count("*").alias("drawn"), F.array_sort(F.collect_list("cell_index")).alias("_m"))
    digests = rows.select(
        "pair_id", "side", "epoch", "drawn", (F.size(F.array_distinct("_m")) == n).alias("unique"),
        F.sha2(F.array_join(F.transform("_m", lambda x: x.cast("string")), ","), 256).alias("digest"))
    before = digests.select("pair_id", "side", (F.col("epoch") + 1).alias("epoch"), F.col("digest").alias("_before"))
    return digests.join(before, ["pair_id", "side", "epoch"], "left").withColumn(
        "redrawn", F.coalesce(F.col("digest") != F.col("_before"), F.lit(True))).drop("_before")


def fairness_audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two consumers saw the same members in every set."""
    digest = F.sha2(membership_text(), 256)
    keys = ["condition_id", "repeat_epoch", "side"]
    left = membership_rows(a).select(*keys, digest.alias("_a"))
    right = membership_rows(b).select(*keys, digest.alias("_b"))
    return left.join(right, keys, "full_outer").agg(
        F.count("*").alias("sets"), F.count_if(F.col("_a").eqNullSafe(F.col("_b"))).alias("same"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("one_sided"))


def fixed_sets(members: DataFrame, cells: DataFrame, n: int) -> DataFrame:
    """Checks of an explicit membership table ``pair_id, side, set_position, cell_index, cell_id``, per set."""
    joined = members.join(cells.select("cell_index", F.col("cell_id").alias("_cell")), "cell_index", "left")
    per = joined.groupBy("pair_id", "side").agg(
        F.count("*").alias("members"), F.count_distinct("cell_index").alias("distinct_members"),
        F.count_distinct("set_position").alias("positions"), F.min("set_position").alias("first_position"),
        F.max("set_position").alias("last_position"),
        F.bool_and(F.col("cell_id").eqNullSafe(F.col("_cell"))).alias("cell_id_agrees"))
    shared = members.groupBy("pair_id", "cell_index").agg(F.count_distinct("side").alias("_s")).where("_s > 1") \
        .groupBy("pair_id").agg(F.count("*").alias("shared_cells"))
    ok = ((F.col("members") == n) & (F.col("distinct_members") == n) & (F.col("positions") == n)
          & (F.col("first_position") == 0) & (F.col("last_position") == n - 1) & F.col("cell_id_agrees")
          & (F.col("shared_cells") == 0))
    return per.join(shared, "pair_id", "left").withColumn(
        "shared_cells", F.coalesce("shared_cells", F.lit(0).cast("long"))).withColumn("valid", ok)
