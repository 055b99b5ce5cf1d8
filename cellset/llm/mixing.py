"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Every source gets a share of all words by its weight, at most ``most`` times its own words; what a full source cannot
take is shared out again. A document of a source with ratio ``r = target / words`` is expected ``r`` times: ``floor(r)``
copies are certain, and the rest is drawn with inclusion odds ``p / (1 - p)``, ``p = r - floor(r)``. Documents are ordered by
random odds over inclusion odds; the first ones are taken as long as they fit into the words that are wanted, and one more
document, the one that comes closest to the words still missing, closes the source. The cut and the closing document
are kept as one row per source, so the documents themselves are never shuffled.

With ``refill`` a document that doesn't fit stops nothing: those behind it that do fit are taken in the same order, before the
closing document is chosen. Each step is one more running total over documents no larger than the gap, behind the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellset.llm.common import WORD, fresh, uniform
from cellset.operators.scale import dense_index, running_total
from cellset.session import materialize

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source).

    Sources by code point, NULL last, weigh ``weights`` in turn. With ``t`` words per unit of weight every source gets
    ``min(most * size, t * weight)``; ``t`` is where these sum to all words. Sorted by ``most * size / weight``, the full sources
    come first, and ``t`` is the largest of the levels that each place of this order would give.
    """
    ranked = dense_index(sizes, [F.col("source").isNull(), "source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighed = materialize(ranked.withColumn("_weight", weight.cast("long")).withColumn("_cap", most * F.col("source_size")))
    order = [F.col("_cap") / F.col("_weight"), "_rank"]
    caps = running_total(weighed, [], order, F.col("_cap"), "_caps", inclusive=False)
    both = running_total(caps, [], order, F.col("_weight"), "_weights", inclusive=False)
    words, weight_sum = (weighed.agg(F.sum(c)).scalar() for c in ("source_size", "_weight"))
    level = both.agg(F.max((words - F.col("_caps")) / (weight_sum - F.col("_weights")))).scalar()
    return weighed.select("source", "source_size",
                          F.least(F.col("_cap").cast("double"), level * F.col("_weight")).alias("target"))


def order_key(share: Column, random: Column) -> Column:
    """Pareto order: random odds over inclusion odds; meant for shares strictly between 0 and 1."""
    return (random / (1 - random)) / F.nullif(share / (1 - share), F.lit(0.0))


def refills(left: DataFrame, state: DataFrame) -> DataFrame | None:
    """``source, steps, refilled``: places ``after`` to ``upto`` of documents of at most ``room`` words that are taken behind the cut.

    ``left`` has the documents that didn't fit; ``state`` has ``source, cut, gap``. Ends when nothing that is left fits.
    """
    place, taken = F.struct("key", "id", "tie"), None
    while True:
        left = materialize(left.alias("d").join(state.alias("c"), F.expr("d.source <=> c.source")).where(
            (F.col("size") <= F.col("gap")) & (F.col("cut").isNull() | (place > F.col("cut")))).select(
            "d.source", "d.size", "d.id", "d.tie", "d.key", "cut", "gap"))
        if not left.limit(1).count():
            break
        counted = running_total(left, ["source"], ["key", "id", "tie"], F.col("size"), "_before", inclusive=False)
        step = materialize(counted.where(F.col("_before") + F.col("size") <= F.col("gap")).groupBy("source").agg(
            F.first("cut").alias("after"), F.max(place).alias("upto"), F.first("gap").alias("room"), F.sum("size").alias("words")))
        taken = step if taken is None else taken.unionByName(step)
        left = left.drop("cut", "gap")
        state = step.select("source", F.col("upto").alias("cut"), (F.col("room") - F.col("words")).alias("gap"))
    return None if taken is None else materialize(taken.groupBy("source").agg(
        F.collect_list(F.struct("after", "upto", "room")).alias("steps"), F.sum("words").alias("refilled")))


def in_steps(place: Column, size: Column, steps: Column) -> Column:
    return F.coalesce(F.exists(steps, lambda s: (s["after"].isNull() | (place > s["after"])) & (place <= s["upto"]) & (size <= s["room"])),
                      F.lit(False))


def quotas(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, refill: bool = False) -> DataFrame:
    """One row per source: ``source, source_size, target, whole`` copies, ``share``, the last place ``cut`` that is taken, ``closing`` and,
    with ``refill``, ``steps``.

    ``sized`` has ``source, size, random, id, tie``. The running total is split over ranges, so a hot source is never in one
    task.
    """
    plan = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).withColumn(
        "_ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ).withColumn("whole", F.floor("_ratio")).withColumn("share", F.col("_ratio") - F.col("whole")).withColumn(
        "_rest", F.col("target") - F.col("whole") * F.col("source_size")).drop("_ratio"))
    drawn = sized.alias("d").join(plan.where("share > 0").alias("p"), F.expr("d.source <=> p.source")).where("size > 0").select(
        "d.source", "d.size", "d.id", "d.tie", "_rest", order_key(F.col("share"), F.col("random")).alias("key"))
    counted = running_total(drawn, ["source"], ["key", "id", "tie"], F.col("size"), "_before", inclusive=False)
    place = F.struct("key", "id", "tie")
    fits = F.col("_before") + F.col("size") <= F.col("_rest")
    last = counted.where(fits).groupBy("source").agg(F.max(place).alias("cut"), F.sum("size").alias("_taken"))
    left = counted.where(~fits).alias("d").join(last.alias("c"), F.expr("d.source <=> c.source"), "left").withColumn(
        "_gap", F.col("_rest") - F.coalesce("_taken", F.lit(0)))
    steps = None
    if refill:
        left = materialize(left.select("d.source", "d.size", "d.id", "d.tie", "d.key", "cut", "_gap"))
        state = materialize(left.groupBy("source").agg(F.first("cut").alias("cut"), F.first("_gap").alias("gap")))
        steps = refills(left.drop("cut", "_gap"), state)
        left = left.alias("d")
    if steps is not None:
        left = left.alias("d").join(steps.alias("s"), F.expr("d.source <=> s.source"), "left").where(
            ~in_steps(place, F.col("size"), F.col("steps"))).select(
            "d.source", "size", "id", "tie", "key", (F.col("_gap") - F.coalesce("refilled", F.lit(0))).alias("_gap")).alias("d")
    miss = F.abs(F.col("size") - F.col("_gap"))
    closing = left.where(miss < F.col("_gap")).groupBy(F.col("d.source").alias("source")).agg(
        F.min(F.struct(miss.alias("miss"), "key", "id", "tie")).alias("c")).select(
        "source", F.struct("c.key", "c.id", "c.tie").alias("closing"))
    found = plan.alias("p").join(last.alias("c"), F.expr("p.source <=> c.source"), "left").join(
        closing.alias("e"), F.expr("p.source <=> e.source"), "left").select(
        "p.source", "source_size", "target", "whole", "share", "cut", "closing")
    if steps is None:
        return found
    return found.alias("p").join(steps.alias("s"), F.expr("p.source <=> s.source"), "left").select("p.*", "steps")


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, carry: list[str] | None = None,
          refill: bool = False) -> DataFrame:
    """Rows of ``df`` (or their ``carry`` columns) with ``size``, ``source_size``, ``target`` and ``copies``.

    NULL and empty texts have size 0 and never more than their source's certain copies. NULL sources form one source,
    the last. Rows that repeat an id are told apart by their text; rows equal in both are taken alike. An empty
    table gives an empty result. Input columns named like result columns are replaced. ``random`` depends on seed
    and id only, so reruns agree.
    """
    results = ("size", "source_size", "target", "copies")
    df = df.drop(*[c for c in df.columns if c.lower() in results and c not in (id_col, text_col, source_col)])
    carry = [c for c in (carry or df.columns) if c in df.columns]
    own = {n: f for n, f in zip(("source", "size", "random", "id", "tie"), fresh(df, "_source", "_size", "_random", "_id", "_tie"),
                                strict=True)}
    values = {own["source"]: F.col(source_col), own["size"]: word_count(text_col), own["random"]: uniform(seed, id_col),
              own["id"]: F.col(id_col), own["tie"]: F.xxhash64(text_col)}
    wide = df.select(*carry, *[v.alias(k) for k, v in values.items()])
    if text_col not in carry:
        wide = materialize(wide)
        sized = wide.select(*[F.col(f).alias(n) for n, f in own.items()])
    else:
        sized = materialize(wide.select(*[F.col(f).alias(n) for n, f in own.items()]))
    names = fresh(wide, "_q_source", "_q_size", "_q_target", "_q_whole", "_q_share", "_q_cut", "_q_closing")
    plan = materialize(quotas(sized, weights, most, refill))
    steps = fresh(wide, "_q_steps") if "steps" in plan.columns else []
    plan = plan.toDF(*names, *steps)
    q = dict(zip(("source", "size", "target", "whole", "share", "cut", "closing"), names, strict=True))
    joined = wide.join(plan, wide[own["source"]].eqNullSafe(plan[q["source"]]), "left")
    place = F.struct(order_key(F.col(q["share"]), F.col(own["random"])).alias("key"), F.col(own["id"]).alias("id"),
                     F.col(own["tie"]).alias("tie"))
    drawn = (F.col(q["share"]) > 0) & (F.col(own["size"]) > 0) & (
        F.coalesce(place <= F.col(q["cut"]), F.lit(False)) | F.coalesce(place == F.col(q["closing"]), F.lit(False)))
    for name in steps:
        drawn = drawn | (F.col(q["share"]) > 0) & (F.col(own["size"]) > 0) & in_steps(place, F.col(own["size"]), F.col(name))
    copies = F.col(q["whole"]) + F.when(drawn, 1).otherwise(0)
    return joined.select(*[F.col(f"`{c}`") for c in carry], F.col(own["size"]).alias("size"), F.col(q["size"]).alias("source_size"),
                         F.col(q["target"]).alias("target"), copies.cast("long").alias("copies"))


def mixture(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, refill: bool = False) -> DataFrame:
    """The mix itself: each row of ``df`` as often as it was taken, columns unchanged."""
    place = {c: f"c{i}" for i, c in enumerate(df.columns)}
    rows = df.toDF(*place.values())
    taken = mixed(rows, place[id_col], place[text_col], place[source_col], weights, most, seed, refill=refill).where("copies > 0")
    repeated = taken.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(v).alias(k) for k, v in place.items()])
