"""Audit bundles composed from the gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellset.operators import quality as Q
from cellset.operators.setops import union_all


def subset_audit(conditions: DataFrame, pools: DataFrame, totals: dict[str, int], lines: int) -> DataFrame:
    """Counts by split, cell lines, indexes, ranges, leakage and drug coverage of a selected subset."""
    ranges = union_all(
        conditions.select("start", "stop", F.col("treated_cells").alias("cells")),
        pools.select("start", "stop", F.col("cached_cells").cast("long").alias("cells")))
    train = conditions.where("split = 'train'")
    checks = [Q.row_count(conditions.where(F.col("split") == s), n, f"{s}_conditions") for s, n in totals.items()]
    checks += [
        Q.gate(conditions, "cell_lines", F.count_distinct("cell_line_id"), lines),
        Q.unique_key(conditions, "pair_id", "pair_unique"),
        Q.contiguous_index(conditions, "condition_index", "condition_index_contiguous"),
        Q.contiguous_index(pools, "control_pool_index", "pool_index_contiguous"),
        Q.ranges_back_to_back(ranges, ["start", "stop"], "ranges_back_to_back"),
        Q.no_key_in_two(conditions, "edge_id", "split", "edge_in_one_split"),
        Q.keys_known(conditions.where("split <> 'train'"), train, "drug", "drugs_seen_in_train"),
    ]
    return Q.run_checks(checks)
