"""Product codes: Orchard's search against all distances, the whole job against a plain version."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellset.llm import vector_codes
from cellset.llm.vector_codes import codebook, coded, nearest
from compare import compare, duck


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.integers(1, 4), st.integers(0, 30), st.integers(0, 2**32), st.sampled_from([2, 5, 1000]))
def test_search_equals_all_distances(k, width, n, seed, spread):
    """Small spreads give equal entries and many ties."""
    rng = np.random.default_rng(seed)
    entries, points = rng.integers(-spread, spread, (k, width)), rng.integers(-spread, spread, (n, width))
    found, least, taken = nearest(points, codebook(entries))
    every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (found == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all() and taken <= n * k


def test_search_takes_few_distances(monkeypatch):
    monkeypatch.setattr(vector_codes, "STRETCH", 4)
    rng = np.random.default_rng(1)
    entries = rng.integers(-1000, 1000, (256, 2))
    assert nearest(rng.integers(-1000, 1000, (5000, 2)), codebook(entries))[2] < 5000 * 60


def plain(rows, parts=4, entries=256, rounds=4):
    """``[(id, code, error, label_error, digest)]`` in Python integers."""
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = len(kept[0][2]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, _, v in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][2]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for x in cut:
                met.setdefault(near(x[p], books[p])[1], []).append(x[p])
            for j, xs in met.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    best = [[near(x[p], books[p]) for p in range(parts)] for x in cut]
    errors = [sum(d for d, _ in b) for b in best]
    total = {}
    for (_, label, _), e in zip(kept, errors, strict=True):
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{j:02x}" for _, j in b), e, total[label], digest)
                   for (i, label, _), b, e in zip(kept, best, errors, strict=True)), key=repr)


def check(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "2 as code", "3 as vector", "4 as n")
    got = coded(table, **options).select("id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, **{k: v for k, v in options.items()})


def test_codes_awkward(spark):
    rng = np.random.default_rng(2)
    v = lambda: [float(np.float32(x)) for x in rng.normal(size=8)]
    same = v()
    rows = [(i, v(), i % 3) for i in range(40)] + [(None, v(), None), (None, v(), None), (3, v(), 1), (3, same, None), (50, None, 1),
                                                   (51, [*v()[:7], None], 1), (52, [*v()[:7], float("nan")], 2), (53, [float("inf"), *v()[:7]], 2)]
    rows += [(100, same, 7)] * 60
    check(spark, rows, entries=16)
    check(spark, rows[:5])  # fewer rows than entries
    check(spark, [(1, [], 1), (2, [], None)])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert coded(table.limit(0)).count() == 0 and coded(table.where("vec_id in (50, 51)")).count() == 0
    for wrong in ([(1, v(), 1), (2, v()[:4], 1)], [(1, v()[:7], 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(Exception, match="can't be c"):
            coded(spark.createDataFrame(wrong, "vec_id long, embedding array<float>, label int")).count()
    with pytest.raises(ValueError):
        coded(table, entries=300)


def test_query_equals_sql(spark):
    from cellset.llm.queries import ORACLES, QUERIES
    folder = "/root/testdata/sf0.001"
    note, ok, _ = compare(spark, duck(folder), "op12_vector_codes", QUERIES["op12_vector_codes"], ORACLES["op12_vector_codes"], folder)
    assert ok, note
