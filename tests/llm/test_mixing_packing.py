"""Packing, mixing, fingerprints and the pipeline."""

import bisect
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_dedup import classes
from tokenizers import Tokenizer

import corpus_pipeline
from cellset.llm.mixing import mixed, mixture
from cellset.llm.order_minhash import fingerprints
from cellset.llm.packing import CAPACITY, TOKENIZER, fullest, packed, packed_documents, patterns, word_ids


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")


def well_packed(rows, capacity):
    """Pieces fill each sequence from 0 without gaps."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_equal_whole_text_encoding(docs, texts, tokenizer):
    rows = packed_documents(docs).collect()
    want = set()
    for k, t in texts.items():
        ids = ids_of(tokenizer, t)
        want |= {(k, i, s, len(ids[s:s + CAPACITY]), zlib.crc32(ids[s:s + CAPACITY].tobytes())) for i, s in enumerate(range(0, len(ids), CAPACITY))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    n = well_packed(rows, CAPACITY)
    assert n <= math.ceil(sum(r.length for r in rows) / CAPACITY) + 1


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abzAZ019.,'!?#é́ßİΣς’　\x85\x1c中") + list(" \nstlrevm<|>")),
                                  st.characters(codec="utf-8", exclude_categories=("Cs",))), max_size=40))
def test_word_ids_equal_tokenizer(text):
    made = Tokenizer.from_file(public_tokenizers.path(TOKENIZER)) if not hasattr(test_word_ids_equal_tokenizer, "t") else test_word_ids_equal_tokenizer.t
    test_word_ids_equal_tokenizer.t = made
    ids = np.array(made.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert word_ids(public_tokenizers.path(TOKENIZER)).encode(text.encode()) == ids


@pytest.mark.parametrize("text", ["end <|endoftext|> start", "A<|StartOfText|>b", "<|endoftext|><|endoftext|>", " x  <|endoftext|>\n y"])
def test_special_tokens_are_read_as_the_tokenizer_reads_them(tokenizer, text):
    got = np.frombuffer(word_ids(public_tokenizers.path(TOKENIZER)).encode(text.encode()), "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(0, 40))
def test_fullest_is_optimal(lengths, room):
    best = {0}
    for x in lengths:
        best |= {s + x for s in best if s + x <= room}
    chosen = fullest(room, Counter(lengths))
    assert sum(chosen) == max(best) and not Counter(chosen) - Counter(lengths)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 1000), max_size=20))
def test_patterns_use_the_whole_histogram(histogram):
    used = Counter()
    for repeats, lengths in patterns(histogram, 50):
        assert repeats >= 1 and sum(lengths) <= 50
        for x in lengths:
            used[x] += repeats
    assert used == Counter(histogram)


def best_fit_decreasing(lengths, capacity):
    free = []
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(free, x)
        bisect.insort(free, (free.pop(i) if i < len(free) else capacity) - x)
    return len(free)


def test_packing_with_a_hot_length(spark):
    """A third of all pieces share one length; no more sequences than by best fit over all pieces in one list."""
    rng = np.random.default_rng(0)
    lengths = np.where(np.arange(6000) % 3 == 0, 300, rng.integers(1, 1400, 6000))
    table = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "i long, length long").repartition(16)
    rows = packed(table).collect()
    assert sorted(r.i for r in rows) == list(range(6000))
    assert well_packed(rows, CAPACITY) <= 1.02 * best_fit_decreasing(lengths.tolist(), CAPACITY) + 1


def test_packing_awkward(awkward, nothing, tokenizer):
    rows = packed_documents(awkward).collect()
    well_packed(rows, CAPACITY)
    assert Counter(r.doc_id for r in rows)[None] == 2 and {r.length for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert sum(r.length for r in rows if r.doc_id == 7) == 3001
    assert packed_documents(nothing).count() == 0


def test_mix_meets_targets(spark, docs):
    rows = mixed(docs).collect()
    assert len(rows) == docs.count()
    sources = {}
    for r in rows:
        assert r.size == len((r.text or "").encode().split()) and 0 <= r.copies <= 3
        s = sources.setdefault(r.source, [r.source_size, r.target, 0, 0])
        s[2] += r.copies * r.size
        s[3] += r.size
    assert all(s[0] == s[3] and s[1] <= 3 * s[0] + 1e-6 for s in sources.values())
    assert math.isclose(sum(s[1] for s in sources.values()), sum(s[3] for s in sources.values()))
    assert {(r.doc_id, r.copies) for r in rows} == {(r.doc_id, r.copies) for r in mixed(docs.repartition(7)).collect()}
    taken = mixture(docs)
    assert taken.columns == docs.columns and Counter(r.doc_id for r in taken.collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_mix_with_a_hot_source(spark):
    table = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 40 as int)) as text",
                                         "case when id % 3 = 0 then 'hot' else concat('s', id % 17) end as source")
    by = {}
    for r in mixed(table, carry=["doc_id", "source"]).collect():
        s = by.setdefault(r.source, [0, r.target])
        s[0] += r.copies * r.size
    assert all(abs(taken - target) <= 1 for taken, target in by.values())


def test_mix_refills_behind_a_long_document(spark):
    """With very long documents among short ones, the documents taken are those of a sequential pass that skips what doesn't fit."""
    sizes = {i: 900 if i % 7 == 0 else 1 + i * 37 % 90 for i in range(600)}
    table = spark.createDataFrame([(i, "w " * n, f"s{i % 6}") for i, n in sizes.items()], "doc_id long, text string, source string")
    rows = mixed(table, refill=True, carry=["doc_id", "source"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        ratio = own[0].target / own[0].source_size
        whole, share = math.floor(ratio), ratio - math.floor(ratio)
        draw = lambda i: (int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0 ** 52
        gap, taken, rest = own[0].target - whole * own[0].source_size, set(), []
        for i in sorted((r.doc_id for r in own), key=lambda i: (draw(i) / (1 - draw(i)), i)):
            if sizes[i] <= gap:
                gap -= sizes[i]
                taken.add(i)
            else:
                rest.append(i)
        better = [i for i in rest if abs(sizes[i] - gap) < gap]
        if share > 0 and better:
            taken.add(min(better, key=lambda i: abs(sizes[i] - gap)))
        assert {r.doc_id for r in own if r.copies > whole} == (taken if share > 0 else set())


def test_mix_awkward(awkward, nothing):
    rows = mixed(awkward).collect()
    assert len(rows) == 12 and {r.size for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert mixture(awkward).columns == awkward.columns
    assert mixed(nothing).count() == 0 and mixture(nothing).count() == 0


def test_mix_refill_awkward(awkward, nothing):
    rows = mixed(awkward, refill=True).collect()
    assert len(rows) == 12 and {r.size for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert mixture(awkward, refill=True).columns == awkward.columns and mixture(nothing, refill=True).count() == 0


def test_fingerprints(docs, texts):
    rows = {r.doc_id: r for r in fingerprints(docs).collect()}
    order = sorted(texts, reverse=True)
    for i, k in enumerate(order):
        text, after = texts[k], texts[order[(i + 1) % len(order)]]
        n = len(text) // 3
        edited = text[:len(text) - n] + after[:n]
        assert (rows[k].n_chars, rows[k].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= rows[k].near_next <= 1 and 0 <= rows[k].near_edited <= 1
    by = {}
    for k, r in rows.items():
        assert by.setdefault(texts[k], r.fingerprint) == r.fingerprint
    assert np.mean([r.near_edited > r.near_next for r in rows.values()]) > 0.95


def local_signature(spark, texts):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in fingerprints(table).collect()}


def test_fingerprints_see_order_and_repeats(spark):
    words = [f"w{i}" for i in range(300)]
    swapped = words[150:] + words[:150]
    rows = local_signature(spark, [" ".join(words), " ".join(swapped), " ".join(words), " ".join(words) + " w299" * 3])
    cut = lambda r: {r.fingerprint[i:i + 8] for i in range(0, len(r.fingerprint), 8)}
    assert cut(rows[0]) == cut(rows[2])
    same = len(cut(rows[0]) & cut(rows[1])) / 64
    assert 0.3 < same < 0.8  # the sets of k-mers are nearly equal; pairs over the swap are not
    assert 0.8 < len(cut(rows[0]) & cut(rows[3])) / 64 < 1


def test_fingerprints_awkward(awkward, nothing):
    rows = fingerprints(awkward).collect()
    assert len(rows) == 12
    assert all(r.fingerprint == "" and r.n_chars == 0 for r in rows if r.doc_id in (3, 4))
    assert fingerprints(nothing).count() == 0
    alone = fingerprints(awkward.where("doc_id = 1")).collect()
    assert alone[0].near_next == 1.0


def test_pipeline_equals_its_parts(spark):
    """Each stage against plain Python on the rows that the stage before it kept."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept.append(stage(spark, kept[-1], folder))
        assert kept[-1].columns == docs.columns
    rows = [x.collect() for x in kept]
    assert 0.7 * len(rows[0]) < len(rows[1]) < len(rows[0])
    best = {}
    for r in rows[1]:
        key = (r.text or "").encode().lower()
        best[key] = max(best.get(key, -1), r.doc_id)
    assert {r.doc_id for r in rows[2]} == set(best.values())
    near = classes({r.doc_id: r.text or "" for r in rows[2]}, 80)
    assert {r.doc_id for r in rows[3]} == {k for k, (_, _, stays) in near.items() if stays}
    assert {r.doc_id for r in rows[4]} <= {r.doc_id for r in rows[3]}
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(r.doc_id for r in rows[4])
    well_packed(out, CAPACITY)


def test_pipeline_awkward(spark, awkward, nothing, tmp_path):
    """Every stage takes NULLs, empty and long texts, repeated rows and clashing names; an empty table gives an empty one."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 0), (7, 0, 1), (9, 1, 0), (None, 1, None), (4, None, 0)],
                                   "doc_id long, quality int, toxic int")
    for name, table in (("some", awkward), ("none", nothing)):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        if name == "none":
            assert corpus_pipeline.run(spark, folder).count() == 0
            continue
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, folder)
            assert docs.columns == table.columns and docs.count() > 0
        well_packed(corpus_pipeline.pack(spark, docs, folder).collect(), CAPACITY)
