"""Chat formatting of logged conversations, with DataFrame operations only.

A service that logs after every turn leaves many snapshots of a growing conversation. Every turn gets a 128-bit digest of
its place, role and text; the digest of a prefix is the exclusive-or of its turns' digests, so it rolls along the
conversation in one window. A conversation whose whole digest is a proper prefix digest of any other is removed by an anti
join of distinct digests, so a first turn that a third of all conversations share is one row on either side. What is left is
maximal and rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellset.session import materialize

#: Fixed marks of the rendered form.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def said(seed: int):
    """Hash of role and text; NULL differs from empty."""
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(),
                      F.coalesce("text", F.lit("")))


def turn_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, place, d1, d2``: places from 1 in the order of the turns, and prefix digests. Texts aren't shuffled."""
    hashed = turns.select("conv_id", "turn", said(1).alias("h1"), said(2).alias("h2"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "h1", "h2")
    placed = hashed.withColumn("place", F.row_number().over(order).cast("long"))
    own = placed.withColumns({"g1": F.xxhash64("place", "h1", "h2"), "g2": F.xxhash64("place", "h2", "h1")})
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return own.select("conv_id", "place", F.bit_xor("g1").over(upto).alias("d1"), F.bit_xor("g2").over(upto).alias("d2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies`` of conversations that prefix no longer one; of equal ones the smallest id stays."""
    ends = prefixes.groupBy("conv_id").agg(F.max(F.struct("place", "d1", "d2")).alias("e")).select("conv_id", "e.*")
    wholes = materialize(ends.groupBy("place", "d1", "d2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")))
    last = ends.select("conv_id", F.col("place").alias("n_turns"))
    proper = prefixes.join(last, "conv_id").where("place < n_turns").select("place", "d1", "d2").distinct()
    return wholes.join(proper, ["place", "d1", "d2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_copies")


def formatted_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies, rendered`` of every maximal conversation of ``conv_id, turn, role, text``.

    Turns are ordered by ``turn`` (NULL last), equal ones by a hash of role and text; equal turn rows all count. A missing role is rendered as
    ``user``, a missing text as empty; they differ from given ones when conversations are compared. Rows without
    ``conv_id`` belong to no conversation. Equal conversations are rendered once, under the smallest id, with their
    number in ``n_copies``. Other columns are ignored; an empty table gives an empty result.
    """
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    kept = materialize(maximal(materialize(turn_digests(turns))))
    shown = F.concat(F.lit(TURN_START), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce("text", F.lit("")),
                     F.lit(f"{TURN_END}\n"))
    placed = turns.select("conv_id", F.struct(F.col("turn").isNull().alias("last"), "turn", said(1).alias("h1"), said(2).alias("h2"),
                                              shown.alias("said")).alias("turn"))
    rendered = placed.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(
        F.sort_array(F.collect_list("turn")).alias("turns")).select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("rendered"))
    return kept.join(rendered, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")
