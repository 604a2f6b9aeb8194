"""Token blocks and SentencePiece pieces against the libraries."""

import random
import string
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickframe.llm import pieces, token_blocks

WORDS, PIECES = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700))
@settings(max_examples=80, deadline=None)
def test_blocks_round_trip(ids):
    ids = np.array(ids, "<u4")
    assert (token_blocks.unpack(token_blocks.pack(ids)) == ids).all()


def test_a_block_keeps_its_outliers_apart():
    ids = np.tile(np.arange(8, dtype="<u4"), 16) + 1000
    small = len(token_blocks.pack(ids))
    ids[5] = 2**31
    assert len(token_blocks.pack(ids)) == small + 5 and token_blocks.unpack(token_blocks.pack(ids))[5] == 2**31


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_word_encoder_equals_the_library(texts):
    own = token_blocks.encoder(WORDS)
    wanted = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == wanted


@given(st.lists(st.text(max_size=60) | st.text("ab ▁\n.é", max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_pieces_equal_the_library(texts):
    own = pieces.model(PIECES)
    wanted = own.processor.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == wanted
    for x, t in zip(wanted, texts, strict=True):
        if "▁" not in t and "\x00" not in t:
            assert own.decode(np.array(x, np.int64)) == t


@given(st.text("ab▁thein", min_size=65, max_size=400))
@settings(max_examples=60, deadline=None)
def test_long_units_equal_the_library(text):
    own = pieces.model(PIECES)
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == own.processor.encode(text)


def test_a_megabyte_without_spaces_takes_seconds():
    own, r = pieces.model(PIECES), random.Random(5)
    for alphabet in (string.ascii_letters + string.digits + "+/", "abcdefghijklmnopqrstuvwxyz", "e", "漢字仮名交"):
        text = "".join(r.choices(alphabet, k=1_000_000))
        began = time.process_time()
        got = own.encode([text])[0]
        assert time.process_time() - began < 120  # seconds where the machine is fast; by rounds over all symbols it would be hours
        part = text[:20_000]
        assert np.frombuffer(own.encode([part])[0], "<u4").tolist() == own.processor.encode(part)
        assert own.decode(np.frombuffer(got, "<u4")) == text


def test_a_join_renews_two_pairs(monkeypatch):
    """Relaxing looks up each neighbouring pair once, and two more for each join; not all pairs again in every round."""
    own, looked, r = pieces.model(PIECES), [], random.Random(11)
    plain = pieces.PieceModel._ranks

    def counted(*args):
        found = plain(*args)
        looked.append(len(found))
        return found

    monkeypatch.setattr(pieces.PieceModel, "_ranks", counted)
    texts = ["".join(r.choices("einstra", k=50)) for _ in range(200)]
    got = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == own.processor.encode(texts)
    assert sum(looked) <= 3 * sum(len(t) + 1 for t in texts)


def test_pieces_take_little_more_time_than_the_library(documents):
    own, texts = pieces.model(PIECES), [d.text or "" for d in documents.select("text").collect()]

    def least(work):
        took = []
        for _ in range(3):
            began = time.process_time()
            work(texts)
            took.append(time.process_time() - began)
        return min(took)

    assert least(own.encode) < 1.5 * least(own.processor.encode)


def test_units_that_begin_alike_equal_the_library():
    """Pieces beside their beginnings and continuations in one suffix array: those that agree in its first number's characters too."""
    own, r = pieces.model(PIECES), random.Random(7)
    some = r.sample([own.processor.id_to_piece(i).replace("▁", " ") for i in own.ids[own.lengths > 4].tolist()], 3000)
    texts = [t for p in some for t in (p, p[:-1], p + "s", p + r.choice(some), p + "é漢\n")]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == own.processor.encode(texts)


@given(st.lists(st.text(max_size=40) | st.text("ab ▁\n.é", max_size=40), max_size=8))
@settings(max_examples=80, deadline=None)
def test_texts_decoded_together_equal_those_decoded_alone(texts):
    own = pieces.model(PIECES)
    ids, ends = own.encode_all([t.encode() for t in texts])
    assert len(ends) == len(texts) and (ends[-1] if texts else 0) == len(ids)
    alone = [own.decode(x).encode() for x in np.split(ids, ends[:-1])] if texts else []
    assert own.decode_all(ids, ends) == alone


def check_table(rows, docs):
    tokenizer = Tokenizer.from_file(WORDS)
    found = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_crc32) for r in rows)
    wanted = []
    for d in docs:
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [2]
        wanted.append((d.doc_id is None, d.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    key = lambda x: (x[0], x[1] or 0, *x[2:])
    assert sorted(found, key=key) == sorted(wanted, key=key)
    at = 0
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.start)):
        assert r.start == at
        at += r.n_tokens


@pytest.mark.parametrize("which", ["messy", "documents"])
def test_block_table(request, which, tmp_path):
    docs = request.getfixturevalue(which)
    path = str(tmp_path / "t")
    rows = token_blocks.encode_corpus(docs, WORDS, 2, path).collect()
    check_table(rows, docs.select("doc_id", "text").collect())
    ids = {r.doc_id: r.ids for r in token_blocks.read_ids(docs.sparkSession, path).collect() if r.doc_id == 4 or which == "documents"}
    for r in rows:
        if r.doc_id in ids:
            assert zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()) == r.ids_crc32


def test_other_tokenizers_get_whole_texts():
    other = token_blocks.WordEncoder(P.path("byte_bpe_50k.json"))
    texts = ["Plain words, and  two spaces", "it's\nnew", "", " x"]
    assert other.whole and not token_blocks.encoder(WORDS).whole
    assert [np.frombuffer(x, "<u4").tolist() for x in other.encode(texts)] == [other.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_one_id_takes_several_shards(spark, tmp_path):
    """Two thirds of all rows have one id or none; they are spread, and stand in the order of ids all the same."""
    rows = [(7 if i % 3 else i, f"text number {i}") for i in range(300)] + [(None, f"none {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = str(tmp_path / "t")
    check_table(token_blocks.encode_corpus(docs, WORDS, 2, path).collect(), [type("R", (), {"doc_id": d, "text": t}) for d, t in rows])
    told = spark.read.parquet(path).select("shard", "doc_ids").collect()
    assert len({r.shard for r in told if 7 in r.doc_ids}) > 1 or len({r.shard for r in told}) < 3
    assert len({r.shard for r in told if None in r.doc_ids}) > 1


def test_pieces_of_tables(messy, documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for docs in (messy, documents):
        found = pieces.encode(docs, PIECES).collect()
        wanted = sorted((str(d.doc_id), sp.encode(d.text or "")) for d in docs.select("doc_id", "text").collect())
        assert sorted((str(r.doc_id), r.ids) for r in found) == wanted
    back = pieces.decode(pieces.encode(documents, PIECES), PIECES).collect()
    assert {(r.doc_id, r.text) for r in back} == {(d.doc_id, d.text or "") for d in documents.collect()}


def test_empty_tables(messy, tmp_path):
    none = messy.limit(0)
    assert token_blocks.encode_corpus(none, WORDS, 2, str(tmp_path / "t")).count() == 0
    assert pieces.encode(none, PIECES).count() == 0


def test_words_of_odd_white_space_equal_the_library():
    """White space that only some splitters know, stops alone, upper case beside other scripts, and added tokens inside words."""
    own = token_blocks.WordEncoder(WORDS)
    texts = [" The\xa0Cat.\x85sat\x1con Ürük!? ", "漢字 The END... «x» it's 3,5. ...", "a<|endoftext|>B. The", "", "  ", "word", "WORD. word, Word;!"]
    for some in (texts, texts[::-1], []):
        wanted = [e.ids for e in own.tokenizer.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(some)] == wanted


def test_plain_words_with_stops_take_one_place_in_the_cache():
    own = token_blocks.WordEncoder(WORDS)
    own.encode(["apple apple, Apple. APPLE! pear; it's 7"])
    assert set(own.cores) == {"apple", "pear"} and set(own.known) == {"it's", "7"}
