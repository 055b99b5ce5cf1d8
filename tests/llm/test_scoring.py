"""Quality classifier by held-out accuracy, language model against one in memory, licence scan and chats."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from cellset.llm import katz
from cellset.llm.chat import formatted_chats
from cellset.llm.licenses import Templates, license_lines
from cellset.llm.quality import FEATURES, accepted, fitted, scored, statistics


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_quality_on_held_out_labels(labelled):
    docs, labels = labelled
    rows = scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert np.mean([r.predicted for r in good]) > 0.97 and np.mean([r.predicted for r in bad]) < 0.25
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_quality_never_learns_from_held_out_labels(labelled):
    docs, labels = labelled
    spoilt = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    one, two = ({r.doc_id: round(r.score, 9) for r in scored(docs, x).collect()} for x in (labels, spoilt))
    assert one == two


def test_quality_awkward(spark, awkward, nothing, labelled):
    labels = labelled[1]
    rows = scored(awkward, labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    kept = accepted(awkward, labels)
    assert kept.columns == awkward.columns
    assert scored(nothing, labels).count() == 0
    none = scored(awkward, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    assert all(len(statistics(t)) == len(FEATURES) and np.isfinite(statistics(t)).all() for t in (b"", b" ", b"a", b"\n\n", "é".encode()))


def test_quality_fit_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, len(FEATURES)))
    y = (rng.random(300) < 0.6).astype(int)
    x[y == 1] += 0.7
    table = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(y, x, strict=True)], "label int, features array<double>").repartition(5)
    model = fitted(table, pooled=0.0, identity=0.0)
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(model.means, [z[y == k].mean(0) for k in (0, 1)])
    for k in (0, 1):
        cov = np.cov(z[y == k].T, bias=True)
        assert np.allclose(np.linalg.inv(model.whiten[k].T @ model.whiten[k]), cov)


def local_katz(texts, held, order):
    tokens = {k: t.encode().lower().split() + [katz.END] for k, t in texts.items()}
    padded = {k: [katz.BEGIN] * (order - 1) + t for k, t in tokens.items()}
    grams = {o: Counter() for o in range(1, order + 1)}
    for k, t in padded.items():
        if not held[k]:
            for i in range(order - 1, len(t)):
                for o in grams:
                    grams[o][tuple(t[i - o + 1:i + 1])] += 1
    factors = {o: katz.discounts([Counter(c.values())[r] for r in range(1, katz.GT_MAX + 2)]) for o, c in grams.items()}
    shrunk = lambda o, c: c * factors[o][min(c, katz.GT_MAX + 1)]
    one = lambda n, kept, low: katz.weights(np.array([n]), np.array([kept]), np.array([low]))[:, 0]
    total = float(sum(grams[1].values()))
    norm, unknown = one(total, sum(shrunk(1, c) for c in grams[1].values()), 0.0)
    context = {}

    def p(gram):
        o = len(gram)
        c = grams[o].get(gram, 0)
        if o == 1:
            return shrunk(1, c) * norm if c else unknown
        n, alpha = context.get(gram[:-1], (0.0, 1.0))
        return shrunk(o, c) * n if c else alpha * p(gram[1:])

    for o in range(2, order + 1):
        sums = {}
        for g, c in grams[o].items():
            s = sums.setdefault(g[:-1], [0.0, 0.0, 0.0])
            s[0] += c
            s[1] += shrunk(o, c)
            s[2] += p(g[1:])
        context.update({k: one(*s) for k, s in sums.items()})
    vocabulary = [g[0] for g in grams[1]]
    scores = {k: sum(math.log10(p(tuple(t[i - order + 1:i + 1]))) for i in range(order - 1, len(t))) for k, t in padded.items()}
    mass = [sum(p((*c, w)) for w in [*vocabulary, b"\0never"]) for c in list(context)[:40:8]]
    base = {k: sum(math.log10((grams[1].get((w,), 0) + 1) / (total + len(grams[1]) + 1)) for w in t) for k, t in tokens.items()}
    known = {k: sum((w,) in grams[1] for w in t) for k, t in tokens.items()}
    return scores, mass, base, known, total


@pytest.mark.parametrize("order,chunk,part", [(2, 3_000_000, 1_500_000), (2, 700, 2_000), (3, 5_000, 9_000)])
def test_katz_equals_model_in_memory(docs, texts, order, chunk, part):
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    scores, mass, base, known, total = local_katz(texts, held, order)
    assert np.allclose(mass, 1.0)
    rows = katz.scored(docs, order=order, chunk=chunk, part_tokens=part).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.held_out, r.n_known, r.train_tokens) == (held[r.doc_id], known[r.doc_id], total)
        assert math.isclose(r.score, scores[r.doc_id], rel_tol=1e-9) and math.isclose(r.base_score, base[r.doc_id], rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_katz_awkward(awkward, nothing):
    rows = katz.scored(awkward).collect()
    assert len(rows) == 12 and all(r.score <= 0 and r.n_tokens >= 1 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert katz.scored(nothing).count() == 0
    unseen = katz.scored(awkward.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in unseen)


def test_license_scan(spark, awkward, nothing):
    text = "Intro\nReleased under the mit   license\nLICENSED under the Apache License, Version 2.0!\nnothing of the kind here\nMIT License."
    rows = license_lines(spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.line, r.license, r.dice) for r in rows) == sorted([(1, 1, "MIT", 1.0), (1, 2, "Apache-2.0", 1.0)] * 2)
    assert license_lines(awkward).count() == 0 and license_lines(nothing).count() == 0
    near = Templates((("GPL-2.0", "General Public License, version 2 a b c d e f g"), ("GPL-3.0", "General Public License, version 3 a b c d e f g")), 80)
    assert near.scan(b"general public license version 3 a b c d e f g")[0][1:] == ("GPL-3.0", 1.0)
    two = Templates((("X", "first line of it\nsecond line of it"),), 85)
    assert two.scan(b"before\nFirst line of it\nsecond line of it\nafter") == [(1, "X", 1.0)]


def test_license_bounds_lose_nothing():
    rng = np.random.default_rng(3)
    words = [f"w{i}".encode() for i in range(30)]
    for _ in range(400):
        template = [words[i] for i in rng.integers(0, 30, rng.integers(2, 20))]
        line = [w for w in template if rng.random() > 0.1] + [words[i] for i in rng.integers(0, 30, rng.integers(0, 4))]
        grams = lambda x: {(a, b) for a, b in zip(x, x[1:], strict=False)}
        a, b = grams(template), grams(line)
        want = bool(a & b) and 200 * len(a & b) >= 85 * (len(a) + len(b))
        assert bool(Templates((("X", b" ".join(template).decode()),), 85).scan(b" ".join(line))) == want


def test_chats_keep_maximal_conversations(spark):
    log = [("a", 1, "user", "hi"), ("b", 1, "user", "hi"), ("b", 2, "assistant", "yes"), ("c", 1, "user", "hi"), ("c", 2, "assistant", "yes"),
           ("d", 2, "user", None), ("d", 1, "user", "hi"), ("e", 1, None, "hi"), ("f", 1, "user", "yes"), ("f", 2, "user", "hi"),
           ("g", 1, "user", "hi"), ("g", 2, "user", ""), ("g", 3, "user", "x"), (None, 1, "user", "lost"), ("h", None, "user", "hi"), ("h", 1, "user", "hi")]
    table = spark.createDataFrame([(*r, 1, 2) for r in log], "conv_id string, turn long, role string, text string, place int, d1 int").repartition(5)
    rows = {r.conv_id: r for r in formatted_chats(table).collect()}
    assert {k: (r.n_turns, r.n_copies) for k, r in rows.items()} == {
        "b": (2, 2), "d": (2, 1), "e": (1, 1), "f": (2, 1), "g": (3, 1), "h": (2, 1)}
    assert rows["b"].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert formatted_chats(table.limit(0)).count() == 0


def test_chats_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for conv in range(150):
        for turn in range(int(rng.integers(1, 6))):
            rows.append((conv, turn, ("user", "assistant")[turn % 2], str(rng.integers(0, 2))))
    talks = {}
    for conv, _, role, text in rows:
        talks.setdefault(conv, []).append((role, text))
    whole = {}
    for k, t in talks.items():
        whole.setdefault(tuple(t), []).append(k)
    want = {(min(v), len(t), len(v)) for t, v in whole.items() if not any(len(o) > len(t) and o[:len(t)] == t for o in whole)}
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    assert {(r.conv_id, r.n_turns, r.n_copies) for r in formatted_chats(table).collect()} == want
