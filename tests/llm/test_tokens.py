"""Token files (2) and token counts (9) against the tokenizers library."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellgrid.llm import token_counts as C
from cellgrid.llm import token_files as T
from cellgrid.llm.common import vocabulary_path


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name))


TEXT = st.lists(st.sampled_from([*"aB'sé ÑßtL\n\t.,!-_19½²日🙂<|>", "<|endoftext|>", "\u0301", "\x1c", "\x85", "  ", "İ"]), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_encoder_equals_library(texts):
    tool, ref = T.encoder("word_bpe_49k.json"), library("word_bpe_49k.json")
    assert [np.frombuffer(b, "<u4").tolist() for b in tool.encode(texts)] == [ref.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_counter_equals_library(texts):
    tool, ref = C._counters.setdefault("byte_bpe_50k.json", None) or C.TokenCounter("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    C._counters["byte_bpe_50k.json"] = tool
    assert tool.count(texts) == [len(ref.encode(t, add_special_tokens=False).ids) for t in texts]


def test_every_proved_string_is_one_token():
    tool, ref = C.TokenCounter("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    some = sorted(tool.whole)[::97]
    assert len(tool.whole) > 40_000 and all(len(ref.encode(t, add_special_tokens=False).ids) == 1 for t in some)


@pytest.mark.parametrize("layout", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 1000])
def test_planes_round_trip(layout, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    size, sizes, planes = T.pack_chunk([ids.tobytes()], layout, block_ids=32)
    assert size == n and (T.unpack_chunk(n, sizes, planes, block_ids=32) == ids).all()


def test_files_hold_every_document_in_order(edges, tmp_path):
    T.write_token_files(edges, str(tmp_path / "t"))
    spark, ref = edges.sparkSession, library("word_bpe_49k.json")
    rows = T.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or ""), [*ref.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in edges.collect())
    start, want = 0, []
    for (has, doc_id, _), ids in texts:
        want.append((doc_id if has else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want)) or [g[1:3] for g in got][-1] == want[-1][1:3]
    assert [g[0] for g in got] == [w[0] for w in want] and {(g[0], g[2], g[3]) for g in got} == {(w[0], w[2], w[3]) for w in want}
    ids = {(r.doc_id, len(r.ids)) for r in T.read_ids(spark, str(tmp_path / "t")).collect()}
    assert ids == {(w[0], w[2]) for w in want}


def test_files_of_an_empty_table(nothing, tmp_path):
    T.write_token_files(nothing, str(tmp_path / "t"))
    assert T.read_token_files(nothing.sparkSession, str(tmp_path / "t")).count() == 0


def test_counts(edges, nothing):
    ref = library("byte_bpe_50k.json")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in C.count_tokens(edges).collect())
    want = []
    for r in edges.collect():
        n = len(ref.encode(r.text or "", add_special_tokens=False).ids)
        want.append((str(r.doc_id), len((r.text or "").encode()), n, n > 1024))
    assert got == sorted(want) and C.count_tokens(nothing).count() == 0


def test_rows_of_one_id_are_spread_over_files(spark, tmp_path):
    docs = spark.createDataFrame([(None if k % 4 else k, "the same words " * (1 + k % 3)) for k in range(2000)], "doc_id bigint, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        T.write_token_files(docs, str(tmp_path / "hot"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = T.read_token_files(spark, str(tmp_path / "hot")).orderBy("start").collect()
    assert len(rows) == 2000 and all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids) and len({r.file_no for r in rows if r.doc_id is None}) > 1


def test_a_word_is_learnt_once_whatever_its_case_and_the_signs_after_it():
    tool, ref = T.PieceEncoder("word_bpe_49k.json"), library("word_bpe_49k.json")
    texts = ["Häuser häuser, HÄuser. häuser;\nhäuser:. häuser!?", "häuser", None, ""]
    assert [np.frombuffer(b, "<u4").tolist() for b in tool.encode(texts)] == [ref.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [p for p in tool.memo if p[:1] in "hH" and p] == ["häuser", "hÄuser"]  # ASCII letters are lower-cased beforehand, others when learnt


SIGNS = st.lists(st.sampled_from([*"aBs,.;:!?' \n1-ÄßÿÀ", "'S,", "e.g.", "A.b", ".,", "H̱.", "É,", "İ.", "<|ENDOFTEXT|>.", "<|endoftext|>,", "\t."]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(SIGNS, max_size=4))
def test_signs_after_words_equal_library(texts):
    tool, ref = T.encoder("word_bpe_49k.json"), library("word_bpe_49k.json")
    assert [np.frombuffer(b, "<u4").tolist() for b in tool.encode(texts)] == [ref.encode(t, add_special_tokens=False).ids for t in texts]
