import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellset.catalog.selection import SPLITS, TOTALS, candidate_conditions, totals
from cellset.operators import sampling as H
from cellset.plans import subset as P
from cellset.session import materialize
from cellset.sources.surrogates import POOL_CAP, SET_SIZE


@pytest.fixture(scope="module")
def candidates(medium):
    rows = materialize(candidate_conditions(medium))
    return materialize(rows.join(rows.where("split = 'train'").select("drug"), "drug", "left_semi"))


def digest(*parts):
    return hashlib.sha256("|".join(["42", *map(str, parts)]).encode()).hexdigest()


def brute_force(frame, split, total):
    """Independent sequential selection of one split."""
    rows = frame[frame["split"] == split].to_dict("records")
    strata = sorted({(r["cell_line_id"], r["dose_um"]) for r in rows}, key=lambda s: digest("stratum", *s))
    left = {s: total // len(strata) + (i < total % len(strata)) for i, s in enumerate(strata)}
    chosen, stratum = set(), lambda r: (r["cell_line_id"], r["dose_um"])
    drugs = sorted({r["drug"] for r in rows}, key=lambda d: (
        sum(r["drug"] == d for r in rows), digest("required-drug", split, d)))
    for drug in drugs:
        options = [r for r in rows if r["drug"] == drug and left[stratum(r)] > 0]
        best = min(options, key=lambda r: (-left[stratum(r)], digest("required-pick", split, drug, r["pair_id"])))
        chosen.add(best["pair_id"])
        left[stratum(best)] -= 1
    for key, need in left.items():
        pool = sorted((r for r in rows if stratum(r) == key and r["pair_id"] not in chosen),
                      key=lambda r: digest("condition", split, r["pair_id"]))
        seen_drug, seen_pool, ranked = {}, {}, []
        for r in pool:
            d = seen_drug[r["drug"]] = seen_drug.get(r["drug"], -1) + 1
            c = seen_pool[r["control_pool_id"]] = seen_pool.get(r["control_pool_id"], -1) + 1
            ranked.append((max(d, c), d, c, digest("condition", split, r["pair_id"]), r["pair_id"]))
        chosen |= {r[-1] for r in sorted(ranked)[:need]}
    return chosen


def test_selection_equals_sequential_choice(medium, candidates):
    got = P.select_conditions(candidates, totals(medium)).toPandas()
    frame = candidates.toPandas()
    for split, total in TOTALS.items():
        assert set(got.loc[got["split"] == split, "pair_id"]) == brute_force(frame, split, total)


def test_quota_beyond_capacity_fails(spark, candidates):
    huge = spark.createDataFrame([("train", 100_000)], "split string, total long")
    with pytest.raises(Exception, match="cannot fill its quota"):
        P.stratum_quotas(candidates, huge).collect()


@pytest.fixture(scope="module")
def subset(medium):
    rows = materialize(candidate_conditions(medium))
    conditions, pools = P.build_subset(rows, medium.pools, totals(medium), SET_SIZE, POOL_CAP, SPLITS)
    return materialize(conditions), pools


def test_cell_plan_covers_every_index_once(medium, subset):
    conditions, pools = subset
    from cellset.operators.scale import place_in_group
    cells = medium.indexed.select(F.col("cell_index").alias("source_index"), "owner_type", "owner_id")
    source = place_in_group(cells, ["owner_type", "owner_id"], ["source_index"], "place")
    plan = P.build_cell_plan(conditions, pools, source, POOL_CAP).toPandas()
    total = int(pools.agg(F.max("stop")).first()[0])
    assert sorted(plan["cell_index"]) == list(range(total))
    assert plan["source_index"].is_unique
    by_pool = plan[plan["owner_type"] == 1].sort_values("cell_index").groupby("owner_index")["source_index"]
    assert all(g.is_monotonic_increasing and len(g) <= POOL_CAP for _, g in by_pool)


def sides(spark, *rows):
    return spark.createDataFrame(list(rows), "pair_id string, side string, start long, stop long")


@pytest.mark.parametrize("mode", ["hash", "pcg64"])
def test_draws_are_repeatable_distinct_and_redrawn(spark, mode):
    ranges = sides(spark, ("a", "treated", 0, 40), ("a", "control", 40, 100))
    one = H.sample_sets(ranges, 16, [0, 1], mode=mode).toPandas()
    two = H.sample_sets(ranges.repartition(2), 16, [1, 0], mode=mode).toPandas()
    key = ["pair_id", "side", "epoch", "cell_index"]
    assert one.sort_values(key).reset_index(drop=True).equals(two.sort_values(key).reset_index(drop=True)[one.columns])
    assert one.groupby(key[:3])["cell_index"].nunique().eq(16).all()
    assert one.loc[one["side"] == "treated", "cell_index"].between(0, 39).all()
    audit = H.sampling_audit(H.sample_sets(ranges, 16, [0, 1], mode=mode), 16).toPandas()
    assert audit["redrawn"].all() and audit["unique"].all()


def test_pcg64_members_are_those_of_numpy(spark):
    got = H.sample_sets(sides(spark, ("p|1", "control", 5, 405)), 32, [3], mode="pcg64", namespace="ns").toPandas()
    payload = "ns|seed=42|epoch=3|pair_id=p|1|side=control"
    seed = int.from_bytes(hashlib.sha256(payload.encode()).digest()[:8], "big")
    want = np.random.Generator(np.random.PCG64(seed)).choice(400, size=32, replace=False) + 5
    assert sorted(got["cell_index"]) == sorted(want)


def test_pool_smaller_than_the_set_fails(spark):
    with pytest.raises(Exception, match="pool smaller"):
        H.sample_sets(sides(spark, ("a", "treated", 0, 3)), 4, [0]).collect()


def test_hash_draw_sorts_a_share_of_a_long_range(spark, monkeypatch):
    ranges = sides(spark, ("p|1", "treated", 7, 40_007), ("p|1", "control", 5, 25))
    sorted_rows, cut = [], H.top_per_group
    monkeypatch.setattr(H, "top_per_group", lambda df, *rest: sorted_rows.append(df.count()) or cut(df, *rest))

    def drawn():
        got = H.sample_sets(ranges, 16, [0]).collect()
        return sorted((r.pair_id, r.side, r.epoch, r.cell_index) for r in got)

    def smallest(side, start, stop):
        return [("p|1", side, 0, i) for i in sorted(sorted(range(start, stop), key=lambda i: digest("set", 0, "p|1", side, i))[:16])]

    want = smallest("control", 5, 25) + smallest("treated", 7, 40_007)
    assert drawn() == want and sorted_rows[0] < 400
    # a share far too small: ranges that come short are drawn with all their cells
    monkeypatch.setattr(H.math, "sqrt", lambda n: -n / 6 - 5.9)
    assert drawn() == want and sorted_rows[-1] >= 40_000
