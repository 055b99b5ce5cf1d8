"""Importance resampling: n-gram CRCs and the whole query against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cellset.llm import resampling as R
from cellset.llm.queries import op13_resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, orders=3):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i:i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, buckets=10_000, percent=5, enough=20):
    """``{(id, n_features, weight, score, rank)}`` by cutting out and hashing every n-gram."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, text in rows for g in grams(text)[1])
    t = Counter(bucket(g) for text in target for g in grams(text)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    out = []
    for key, text in rows:
        n, features = grams(text)
        weight = sum(gain[bucket(g)] for g in features)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), None, n])
    able = sorted((r for r in out if r[5] >= enough), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6), st.integers(1, 4))
def test_crcs_of_word_runs(texts, orders):
    crc, owner = R.features_of([R.words_of(t.encode()) for t in texts], orders)
    want = [(zlib.crc32(g.encode()), i) for i, t in enumerate(texts) for g in grams(t, orders)[1]]
    assert sorted(zip(crc.tolist(), owner.tolist(), strict=True)) == sorted(want)


def test_shifts_of_any_length():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 255, 256, 257, 1000, 65_537, 300_000):
        a, b = rng.bytes(20), rng.bytes(n)
        got = R.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0] ^ np.uint32(zlib.crc32(b))
        assert got == zlib.crc32(a + b)
    words = [b"a" * k for k in (1, 300, 70_000, 5)]
    crc, _ = R.features_of([words])
    assert crc.tolist() == [zlib.crc32(b" ".join(words[i:i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def test_long_texts_are_cut_without_loss(monkeypatch):
    texts = [b"a b c " * 30, b"", b"x y", b"q w e r t z u i o p " * 20, b"one two"]
    count = lambda: sorted((first + int(o), int(v)) for first, values, owner in R.bucket_rows(texts, 1000, 3)
                           for v, o in zip(values, owner, strict=True))
    whole = count()
    for most in (2, 3, 7, 50, 119):
        monkeypatch.setattr(R, "CHUNK", most)
        assert count() == whole


def test_query_equals_plain_version(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in op13_resample(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == plain(rows, target) and sum(r[4] is not None for r in got) > 5


def test_resampling_awkward(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    target = spark.createDataFrame([("The quick brown fox",), (None,), ("",)], "text string")
    columns = ["id", "n_features", "weight", "score", "rank"]
    for wanted in (target, target.limit(0)):
        got = R.resampled(awkward, wanted, percent=60, enough=5).select(*columns).collect()
        assert sorted(map(tuple, got), key=repr) == plain(rows, [r.text for r in wanted.collect()], percent=60, enough=5)
    assert R.resampled(nothing, target).count() == 0
