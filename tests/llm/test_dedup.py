"""Exact, near and substring deduplication against brute force."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from cellset.llm import near_dup as N
from cellset.llm import substrings as S
from cellset.llm.components import components
from cellset.llm.exact_dup import heavy_candidates, marked_copies, without_copies
from cellset.llm.near_dup import marked_near_copies, without_near_copies
from cellset.llm.substrings import brute_force, chained, covered, least_of, repeated_windows, text_sha256, without_repeats


def test_exact_awkward(awkward, nothing):
    rows = marked_copies(awkward).collect()
    assert len(rows) == 12 and sum(r.kept for r in rows) == 8
    by = {}
    for r in rows:
        by.setdefault(r.text_sha256, []).append(r)
    quick = by[hashlib.sha256(b"the quick brown fox jumps over the lazy dog").hexdigest()]
    assert [r.keep_id for r in quick] == [2, 2, 2] and [r.group_size for r in quick] == [3, 3, 3]
    assert sum(r.kept for r in quick) == 1 and {r.doc_id for r in quick if r.kept} == {2}
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert {(r.doc_id, r.kept) for r in empty} == {(3, False), (4, True), (None, False)}
    kept = without_copies(awkward)
    assert kept.columns == awkward.columns and kept.count() == 8
    assert marked_copies(nothing).count() == 0 and without_copies(nothing).count() == 0


@pytest.mark.parametrize("counters", [1, 3, 4096])
def test_exact_equals_grouping(docs, texts, counters):
    """Few counters make few texts heavy, many make all: the result is the same."""
    groups = {}
    for k, t in texts.items():
        groups.setdefault(t.encode().lower(), []).append(k)
    want = {(k, max(g), len(g), k == max(g), hashlib.sha256(t).hexdigest()) for t, g in groups.items() for k in g}
    got = marked_copies(docs, carry=["doc_id"], counters=counters).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert {tuple(r) for r in got.collect()} == want


def test_misra_gries_bounds(spark):
    rows = spark.range(3000).selectExpr("cast(case when id % 3 = 0 then 'hot' else concat('x', id) end as binary) as d")
    found = heavy_candidates(rows.repartition(4), 20)
    assert found.count() <= 20 and b"hot" in {bytes(r.key) for r in found.collect()}


def sets_of(texts):
    out = {}
    for k, t in texts.items():
        w = t.encode().lower().split()
        out[k] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    return out


def classes(texts, percent=85):
    sets = sets_of(texts)
    label = {k: k for k in sets}
    for _ in sets:
        before = dict(label)
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = min(label[a], label[b])
        if label == before:
            break
    return {k: (len(sets[k]), label[k], label[k] == k) for k in sets}


@pytest.mark.parametrize("most", [N.CLUSTER, 0])
def test_near_equals_brute_force(docs, texts, most):
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in marked_near_copies(docs, most=most).collect()}
    assert got == classes(texts)


@pytest.mark.parametrize("most", [N.CLUSTER, 0])
def test_near_group_around_one_origin(spark, most):
    """Copies with few and with many edits around one origin, a second origin, and a chain: no link is lost."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(400)])
    base = rng.choice(words, 200)

    def edited(source, n):
        copy = source.copy()
        copy[rng.choice(len(copy), n, replace=False)] = [f"e{rng.integers(1 << 40)}" for _ in range(n)]
        return copy

    second = edited(base, 12)
    made = [base, *(edited(base, int(n)) for n in rng.integers(1, 14, 60)), second, *(edited(second, int(n)) for n in rng.integers(1, 6, 40))]
    link = base
    for _ in range(8):
        link = edited(link, 2)
        made.append(link)
    order = rng.permutation(len(made))
    texts = {int(i): " ".join(made[i]) for i in order}
    table = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string").repartition(4)
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in marked_near_copies(table, most=most).collect()}
    assert got == classes(texts)


def test_near_large_clusters_are_dealt(spark, monkeypatch):
    """Members of a large cluster reach several tasks; texts of many shingles make a cluster large as well."""
    base = [f"w{i}" for i in range(300)]
    texts = {k: " ".join([*base[:k % 300], f"e{k}", *base[k % 300 + 1:]]) for k in range(1500)}
    table = spark.createDataFrame(list(texts.items()), "cid long, text string").withColumn("text", F.encode("text", "utf-8"))
    pairs = table.where("cid > 0").selectExpr("0L as centre", "cid", "296L as n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = N.settled_clusters(pairs, table, 85, 100).select("b", "linked", F.spark_partition_id().alias("task")).collect()
        monkeypatch.setattr(N, "LOAD", 100_000)
        heavy = N.settled_clusters(pairs, table, 85, N.CLUSTER).where("prefix is not null").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.b for r in rows) == list(range(1, 1500)) and all(r.linked for r in rows)
    assert len({r.task for r in rows}) > 1 and heavy == 1499


def test_near_stage_of_the_pipeline_links_from_080(spark, docs, texts):
    """The stage against brute force at 0.8, on the given texts and on pairs of 0.80 to 0.85."""
    made = {}
    for pair in range(40):
        words = [f"p{pair}w{i}" for i in range(104)]
        made |= {10**12 + 2 * pair: " ".join(words), 10**12 + 2 * pair + 1: " ".join([*words[:50], "x", *words[51:-8]])}
    more = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near(spark, docs.select("doc_id", "text").unionByName(more), "").collect()}
    want = {k for k, (_, _, kept) in classes(texts | made, 80).items() if kept}
    assert got == want and len(want) < sum(kept for _, _, kept in classes(texts | made).values())
    assert 2 * (1 - 0.8 ** N.K) ** N.half_keys(80) < 2e-6 and N.half_keys(85) == N.M


def test_near_awkward(awkward, nothing):
    rows = marked_near_copies(awkward).collect()
    assert len(rows) == 12
    quick = [r for r in rows if r.id in (1, 2)]
    assert {(r.component_id, r.n_shingles) for r in quick} == {(1, 5)} and [r.kept for r in sorted(quick, key=lambda r: r.id)] == [True, False, False]
    assert all(r.kept and r.n_shingles == 0 for r in rows if r.id in (3, 4, 5))
    assert {r.n_shingles for r in rows if r.id in (6, 7)} == {1}
    kept = without_near_copies(awkward)
    assert kept.columns == awkward.columns and kept.count() == 10
    assert marked_near_copies(nothing).count() == 0 and without_near_copies(nothing).count() == 0


def test_near_stage_keeps_every_text_that_has_no_copy(spark):
    """Ids that repeat or are NULL: a row goes only if a copy of its own text's class stays."""
    u, v, w = (" ".join(f"{x}{i}" for i in range(30)) for x in "uvw")
    rows = [(1, w), (5, w), (5, u), (None, w), (None, v), (None, v + " end"), (7, None), (7, ""), (8, u.upper()), (8, u.upper())]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text or "") for r in without_near_copies(table).collect())
    assert [(i, t) for i, t in kept if t] in ([(0, v), (1, w), (5, u)], [(0, v + " end"), (1, w), (5, u)])
    assert [(i, t) for i, t in kept if not t] == [(7, ""), (7, "")]


def test_tables_miss_hardly_anything():
    rng = np.random.default_rng(0)
    assert 2 * (1 - 0.85 ** N.K) ** N.M < 2e-6
    for _ in range(200):
        shared, own = rng.integers(0, 1 << 63, 850, dtype=np.uint64), rng.integers(0, 1 << 63, (2, 75), dtype=np.uint64)
        a, b = (N.signature(np.unique(np.concatenate([shared, x]))) for x in own)
        same = a == b
        assert same[:N.M].any() and same[N.M:].any()


def test_components_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(5, i) for i in range(10, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*chain, *hub, (7, 7), (5, 11)], "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in (5, *range(10, 60))}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bucket,chunk", [(20_000, 250_000), (1, 200), (20_000, 1)])
def test_substrings_equal_brute_force(docs, texts, bucket, chunk):
    want = dict(zip(texts, brute_force([t.encode() for t in texts.values()]), strict=True))
    rows = without_repeats(docs, bucket=bucket, chunk=chunk).select("doc_id", "n_words", "n_removed", text_sha256("kept_text").alias("h"))
    assert {r.doc_id: (r.n_words, r.n_removed, r.h) for r in rows.collect()} == want


def test_substrings_spread_hot_windows(spark, monkeypatch):
    """Copies of one text, also with a word replaced, and a periodic text: no bucket gathers them, and nothing is lost."""
    words = [f"w{i}" for i in range(60)]
    made = [" ".join(words)] * 300 + [" ".join([*words[:k], "x", *words[k + 1:]]) for k in range(60)] + ["wort " * 3000]
    table = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(4)
    seen, real = [], S.sorted_buckets
    monkeypatch.setattr(S, "sorted_buckets", lambda spans, *rest: seen.append(spans) or real(spans, *rest))
    rows = without_repeats(table, bucket=20).select("doc_id", "n_words", "n_removed", text_sha256("kept_text").alias("h")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.h) for r in rows} == dict(enumerate(brute_force([t.encode() for t in made])))
    groups = seen[0].selectExpr("bucket", "if(hot, 1, size(split(decode(packed, 'utf-8'), ' '))) as n", "hot").groupBy("bucket", "hot").agg(
        {"n": "sum"}).collect()
    assert max(r[2] for r in groups if r.hot) <= 60
    assert max((r[2] for r in groups if not r.hot), default=0) <= 20 * S.EACH


def test_substrings_are_linear_in_repeated_rows(spark):
    """Equal rows without an id, beside a text that shares a passage with them and one of its own."""
    words, more = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(50)]
    shared = " ".join([*more, *words[10:50], *more[::-1]])
    table = spark.range(20_000).selectExpr("cast(null as long) as doc_id", f"'{' '.join(words)}' as text").unionByName(
        spark.createDataFrame([(None, shared), (None, " ".join(more[:40])), (3, "a b")], "doc_id long, text string"))
    rows = without_repeats(table).groupBy("doc_id", "n_words", "n_removed", "kept_text").count().collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_text): r["count"] for r in rows} == {
        (None, 60, 60, ""): 20_000, (None, 140, 80, " ".join([*more[40:], *more[::-1]])): 1,
        (None, 40, 40, ""): 1, (3, 2, 0, "a b"): 1}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.lists(st.sampled_from("ab"), max_size=9)), max_size=8))
def test_substrings_with_repeated_ids_equal_brute_force(spark, made):
    rows = [(i, " ".join(w)) for i, w in made]
    got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=4, minimiser=2).select(
        "doc_id", "n_words", "n_removed", text_sha256("kept_text").alias("h")).collect()
    want = [(i, *x) for (i, _), x in zip(rows, brute_force([t.encode() for _, t in rows], 4), strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_substrings_awkward(awkward, nothing):
    rows = without_repeats(awkward).collect()
    assert len(rows) == 12 and {r.n_removed for r in rows if r.doc_id != 7} == {0}
    assert [r.n_removed for r in rows if r.doc_id == 7] == [3000]
    assert without_repeats(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=30), max_size=8), st.integers(2, 6))
def test_repeated_windows_property(rows, window):
    packed = [" ".join(r).encode() for r in rows if len(r) >= window]
    if packed:
        want = [[i for i in range(len(x.split()) - window + 1)
                 if sum(y.split()[j:j + window] == x.split()[i:i + window] for y in packed for j in range(len(y.split()) - window + 1)) > 1]
                for x in packed]
        assert [x.tolist() for x in repeated_windows(packed, window)] == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.integers(1, 35))
def test_sliding_helpers(values, width):
    x = np.array(values, np.uint64)
    n = len(x) - width + 1
    if n > 0:
        assert least_of(x, width).tolist() == [min(values[i:i + width]) for i in range(n)]
        groups = {}
        for i, h in enumerate(chained(x, width).tolist()):
            groups.setdefault(h, set()).add(tuple(values[i:i + width]))
        assert all(len(g) == 1 for g in groups.values()) and len(chained(x, width)) == n


def test_covered_merges_touching_spans():
    assert covered(np.array([0, 1, 5, 40]), 5) == [(0, 10), (40, 45)]
