"""Encoding, token files and piece counts against the libraries."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from fixhound.llm import bpe, piece_counts, token_files
from fixhound.llm.pieces import default_path

TEXTS = ["", None, "a", " a ", "a   b", "a\n b", "\n ", "it's we'll 'rex ''s", "x <|endoftext|> y<|endoftext|>", "ab" * 700, "日本語 😀  ñandú", "a\x1c\x1d b", "　 x", "the the", "the the", "word " * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abst'lrve  \n\t.!09é日😀\x1c<|>")) | st.characters(exclude_categories=["Cs", "Cn"]), max_size=40), max_size=4))
def test_encode_equals_library(texts):
    coder, tokenizer = bpe.coder(default_path()), Tokenizer.from_file(default_path())
    ids, bounds = coder.encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert coder.decode(ids, bounds) == [t.encode() for t in texts]


def test_long_and_short_merges_agree():
    coder = bpe.coder(default_path())
    data = np.frombuffer(b" thethinginnandoftion", np.uint8)
    rows, _ = coder.merge_rows(data, np.array([0]), np.array([len(data)]), 32)
    assert rows.tolist() == coder.merge_one(data).tolist()


def test_decode_of_cut_characters(library):
    coder = bpe.coder(default_path())
    ids = library.encode("日本", add_special_tokens=False).ids[:-1]
    expected = library.decode(ids, skip_special_tokens=False).encode()
    assert coder.decode(np.array(ids), np.array([0, len(ids)])) == [expected]


def test_digests(rows, library):
    got = {r.doc_id: r for r in bpe.digests(rows).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(as_bytes(ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_decode_keeps_texts(rows):
    assert sorted((r.doc_id, r.decoded) for r in bpe.encode_decode(rows).collect()) == [(i, t or "") for i, t in enumerate(TEXTS)]


def test_token_files(rows, library, tmp_path, spark):
    folder = str(tmp_path / "shards")
    token_files.write_shards(rows, folder, shard_ids=50, ranges=3)
    got = sorted(token_files.read_documents(spark, folder).collect())
    start = 0
    for i, text in enumerate(TEXTS):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(as_bytes(ids)))
        start += len(ids)


def test_empty_tables(rows):
    none = rows.where("false")
    assert bpe.digests(none).count() == token_files.digests(none).count() == piece_counts.token_counts(none).count() == 0


@pytest.mark.parametrize("top", [1, 5, 50_000, 70_000])
def test_wavelet_matrix(top):
    ids = np.random.default_rng(top).integers(0, top, 3_000)
    made = token_files.WaveletMatrix.from_bytes(token_files.WaveletMatrix.build(ids).to_bytes())
    assert made.decode().tolist() == ids.tolist()
    for i in (0, 511, 512, 1_777, 2_999):
        assert made.access(i) == ids[i]
        places = np.flatnonzero(ids == ids[i])
        assert made.count(int(ids[i])) == len(places)
        assert made.count(int(ids[i]), 100, 2_000) == ((places >= 100) & (places < 2_000)).sum()
        assert [made.locate(int(ids[i]), k) for k in range(min(3, len(places)))] == places[:3].tolist()
    assert made.locate(int(ids[0]), 3_000) == -1 and made.count(1 << 20) == 0


def test_piece_counts_equal_library(rows):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=piece_counts.default_model())
    every = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]
    tokenizer = Tokenizer(models.Unigram(every, unk_id=0, byte_fallback=True))
    got = {r.doc_id: r.n_tokens for r in piece_counts.token_counts(rows).collect()}
    for i, text in enumerate(TEXTS):
        if "<" not in (text or ""):
            assert got[i] == (len(tokenizer.encode("▁" + text.replace(" ", "▁")).ids) if text else 0), text


def test_ties_go_to_the_earlier_begin():
    model = piece_counts.Unigram({"a": -1.0, "b": -1.0, "c": -1.0, "ab": -2.0, "bc": -2.0, "▁": 0.0}, -2.0, False)
    assert model.best("abc") == (-3.0, 2)
    assert model.best("axxb") == (-1.0 - 24.0 - 1.0, 3)
