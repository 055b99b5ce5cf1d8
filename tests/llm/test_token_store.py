"""Token files: ids against the tokenizer, layout of the files, partial reads."""

import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellset.llm import token_store
from cellset.llm.queries import op11_token_files
from cellset.llm.token_store import END_ID, TOKENIZER, TextIds, encoded, read_tokens, stored_documents, text_ids, write_tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def want_of(rows, tokenizer):
    """``(id, start, n, crc)`` of rows in ascending id order, by whole-text encoding."""
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


PARTS = st.sampled_from(["a", "Word", "it's", "don't", "x1", "42", ".", ",'", "l'été", "ß", " ", "  ", "\n", "\t ", " \n", " ", "　", "中文",
                         "<|endoftext|>", "<|", "'", "'s", "é", "\x1c", "\x85", "🙂", "_", "\0"])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(PARTS, max_size=12).map("".join), st.lists(PARTS, max_size=12).map(" ".join), st.text(max_size=40)))
@example("a\n b\n\nc").via("blank line")
@example("end <|endoftext|> start").via("special token")
@example("a\n ").via("white space at the end")
def test_text_ids_equal_tokenizer(tokenizer, text):
    got = np.frombuffer(text_ids(public_tokenizers.path(TOKENIZER)).encode(text), "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_old_words_are_forgotten(tokenizer, monkeypatch):
    monkeypatch.setattr(token_store, "CACHED_WORDS", 50)
    own = TextIds(public_tokenizers.path(TOKENIZER))
    texts = [" ".join(f"word{chr(97 + i % 7)}{chr(97 + i // 7 % 26)}" for i in range(k, k + 30)) for k in range(0, 300, 10)]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(own.later) + len(own.later.old) <= 110


def test_query_equals_whole_text_encoding(spark, docs, tokenizer):
    want = want_of([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], tokenizer)
    got = sorted(tuple(r) for r in op11_token_files(spark, "/root/testdata/sf0.001").collect())
    assert got == want


@pytest.mark.parametrize("encoding,kind", [("delta", "DELTA_BINARY_PACKED"), ("dictionary", "RLE_DICTIONARY")])
def test_files_are_ordered_and_read_in_parts(spark, docs, tmp_path, encoding, kind):
    folder = str(tmp_path / "t")
    write_tokens(encoded(docs.repartition(5)), folder, encoding=encoding, group_bytes=64 << 10, page_bytes=4 << 10, page_rows=10)
    files = [pq.ParquetFile(f) for f in sorted(glob.glob(f"{folder}/tokens/*.parquet"))]
    ids = [i for f in files for i in f.read(["id"])["id"].to_pylist()]
    assert ids == sorted(ids) and len(ids) == docs.count()
    for f in files:
        for g in range(f.metadata.num_row_groups):
            columns = [f.metadata.row_group(g).column(c) for c in range(f.metadata.num_columns)]
            assert all(c.has_offset_index and c.has_column_index for c in columns if not c.path_in_schema.startswith("ids"))
            token = next(c for c in columns if c.path_in_schema.startswith("ids"))
            assert kind in token.encodings and token.has_offset_index
    assert sum(f.metadata.num_row_groups for f in files) > len(files)
    meta = read_tokens(spark, folder).select("id", "start", "n_tokens")
    plan = meta._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema:")[1].split("\n")[0]
    some = read_tokens(spark, folder, low=50, high=60)
    assert "GreaterThanOrEqual(id,50)" in some._jdf.queryExecution().toString()
    whole = {r.id: r for r in read_tokens(spark, folder).collect()}
    assert {r.id: r for r in some.collect()} == {k: v for k, v in whole.items() if 50 <= k <= 60}
    assert all(len(r.ids) == r.n_tokens for r in whole.values())
    with pytest.raises(ValueError):
        write_tokens(encoded(docs), folder, encoding="none")


def test_token_files_awkward(awkward, nothing, tokenizer):
    got = [tuple(r) for r in stored_documents(awkward).collect()]
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    bare = lambda found: sorted(map(repr, ((r[0], *r[2:]) for r in found)))
    assert bare(got) == bare(want_of(rows, tokenizer))
    got.sort(key=lambda r: r[1])
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]
    keys = [r[0] for r in got]
    assert keys[-2:] == [None, None] and keys[:-2] == sorted(keys[:-2])
    assert stored_documents(nothing).count() == 0


def test_repeated_rows_are_dealt(spark):
    """Equal rows under one id, or without one: all ranges share them, and starts stay gapless."""
    table = spark.range(4000).selectExpr("if(id % 2 = 0, cast(null as long), 5L) as doc_id", "'the same text' as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert encoded(table).select("part").distinct().count() > 4
        rows = sorted((r.start, r.n_tokens, r.id) for r in stored_documents(table).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = rows[0][1]
    assert [r[0] for r in rows] == list(range(0, 4000 * n, n)) and [r[2] for r in rows] == [5] * 2000 + [None] * 2000
