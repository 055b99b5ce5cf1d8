"""Writers: index CSV, manifests, plans, vectors, memberships, expression bundles and merged parts."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellset.functions.numbers import compact
from cellset.operators.aggregates import membership_rows, vector_audit
from cellset.operators.joins import unique_side
from cellset.operators.scale import dense_index, place_in_group
from cellset.session import durable_dir, materialize

CONTROL_NAME = "non-targeting"  # fixed value: perturbation label of control rows


def new_folder(spark: SparkSession) -> str:
    """Fresh folder name in the shared folder."""
    return os.path.join(durable_dir(spark), f"out-{uuid.uuid4().hex}")


def sink_index_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed column order; floating numbers with ten significant digits, undefined ones as ``NaN``."""
    kinds = {f.name: f.dataType for f in df.schema}
    out = [compact(F.col(c)).alias(c) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else F.col(c) for c in columns]
    df.select(*out).write.option("header", True).csv(path)


def manifest_text(df: DataFrame) -> DataFrame:
    """One JSON text per row; undefined numbers are null and null fields are kept."""
    safe = [F.nanvl(F.col(f.name), F.lit(None)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value"))


def sink_manifest(df: DataFrame, path: str) -> None:
    manifest_text(df).write.text(path)


#: Types of plan columns (fixed values: the layout that readers of a plan expect).
PLAN_TYPES = {"part_index": "long", "embedding_index": "long", "shard_index": "int", "shard_path": "string", "row_group_index": "smallint",
              "row_index_in_row_group": "int", "row_index_in_shard": "int", "owner_type": "tinyint", "owner_index": "int",
              "source_embedding_index": "long"}


def locator_plan(located: DataFrame, worker: str, carry: list[str]) -> DataFrame:
    """Plan rows of cells that have ``shard, row, row_group, row_in_group`` (see ``footers.with_row_groups``) and a worker.

    ``part_index`` counts a worker's rows in physical order, ``shard_index`` the shards by name. Columns in ``PLAN_TYPES`` get their
    narrow type; a value that doesn't fit, or a missing shard, fails the job.
    """
    shards = dense_index(located.select("shard").distinct(), ["shard"], "shard_index")
    rows = located.join(shards, "shard").select(
        worker, "shard_index", F.col("shard").alias("shard_path"), F.col("row_group").alias("row_group_index"),
        F.col("row_in_group").alias("row_index_in_row_group"), F.col("row").alias("row_index_in_shard"), *carry)
    placed = place_in_group(rows, [worker], ["shard_index", "row_index_in_shard"], "part_index")
    narrow = {c: F.col(c).try_cast(kind) for c, kind in PLAN_TYPES.items() if c in placed.columns}
    fits = [F.assert_true(v.isNotNull(), F.lit(f"plan column {c} is missing or out of range")).isNull() for c, v in narrow.items()]
    checked = placed.where(reduce(lambda a, b: a & b, fits))
    return checked.select(worker, *[narrow[c].alias(c) for c in PLAN_TYPES if c in narrow],
                          *[c for c in carry if c not in PLAN_TYPES])


def sink_plan(df: DataFrame, path: str, worker: str, place: list[str]) -> None:
    """Locator plan in physical order, one folder per worker, zstd."""
    ordered = df.repartitionByRange(worker, *place).sortWithinPartitions(worker, *place)
    ordered.write.option("compression", "zstd").partitionBy(worker).parquet(path)


def sink_vectors(df: DataFrame, path: str, key: str = "cell_index") -> None:
    """Vectors ranged and sorted by key, so key ranges skip row groups; a repeated key fails the job."""
    single = unique_side(df, [key])
    single.repartitionByRange(key).sortWithinPartitions(key).write.parquet(path)


def sink_membership(sets: DataFrame, path: str) -> None:
    """One row per (condition, repeat) with ascending control and treated members."""
    rows = membership_rows(sets)
    side = lambda name: F.first(F.when(F.col("side") == name, F.col("members")), ignorenulls=True).alias(f"{name}_idx")
    rows.groupBy("condition_id", "repeat_epoch").agg(side("control"), side("treated")).write.parquet(path)


def expression_bundle(sets: DataFrame, expressions: DataFrame, panel: DataFrame) -> dict[str, DataFrame]:
    """Labelled tables of drawn sets: ``obs`` (one row per drawn cell), ``var`` (panel genes) and ``x`` (values)."""
    label = F.when(F.col("side") == "control", CONTROL_NAME).otherwise(F.col("condition_id"))
    name = F.format_string("%s_%s_%08d", F.col("condition_id"), F.col("side"), F.col("cell_index"))
    obs = sets.select("condition_id", "side", "cell_index", name.alias("obs_name"), label.alias("perturbation"))
    return {"obs": obs, "var": panel.select("panel_rank", "gene_index", "token_id"),
            "x": obs.join(expressions, "cell_index").select("obs_name", "expr")}


def merge_faults(stacked: DataFrame, plan: DataFrame, keys: list[str], index: str) -> dict[str, int]:
    """How often the parts and the plan fail to meet one to one; only keys are compared, payloads stay where they are."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    met = count(stacked, "_parts").join(count(plan, "_planned"), keys, "full_outer")
    several = plan.groupBy(index).agg(F.count("*").alias("_n")).where("_n > 1")
    row = met.agg(
        F.count_if(F.col("_parts").isNull()).alias("planned rows without a part row"),
        F.count_if(F.col("_planned").isNull()).alias("part rows that are not in the plan"),
        F.count_if(F.col("_parts") > 1).alias("places that parts fill twice"),
        F.count_if(F.col("_planned") > 1).alias("places that the plan names twice")).first()
    return {**row.asDict(), f"values of {index} planned twice": several.count(),
            f"planned rows without {index}": plan.where(F.col(index).isNull()).count()}


def merge_parts(parts: list[DataFrame], plan: DataFrame, column: str, by: list[str], signed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Worker outputs ``worker_id, part_index, vector`` joined to their global index, and statistics per section.

    Fails by name if a planned row is missing, a place is unknown or filled twice, a global index is missing or planned twice, or a section
    holds non-finite values or (with ``signed``) only values of one sign. Vectors are moved once, by the join that places them.
    """
    stacked, keys = reduce(lambda a, b: a.unionByName(b), parts), ["worker_id", "part_index"]
    faults = {name: n for name, n in merge_faults(stacked, plan, keys, "cell_index").items() if n}
    if faults:
        raise ValueError("merge refused: " + ", ".join(f"{n} {name}" for name, n in faults.items()))
    table = materialize(stacked.join(plan, keys).select("cell_index", *by, column))
    stats = materialize(vector_audit(table, column, by))
    section = F.concat_ws("|", *[F.col(c).cast("string") for c in by]) if by else F.lit("all")
    one_sign = F.lit(signed) & ~((F.col("value_min") < 0) & (F.col("value_max") > 0))
    bad = stats.select(section.alias("s"), F.when(~F.col("finite"), "non-finite values").when(one_sign, "values of one sign").alias("why")).where(
        "why is not null")
    if worst := bad.orderBy("s").limit(5).collect():
        raise ValueError("merge refused: " + ", ".join(f"section {r.s} has {r.why}" for r in worst))
    return table, stats
