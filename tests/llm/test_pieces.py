"""SentencePiece encoding: the prefix table against plain merging and against the library, with the defined cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from crease.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "▁x", "▁", "▁▁ ", "a\x00b", "<s>hi</s> <0x0A>", "\n", "é́ \U0001f600 x", "ａｂｃ ﬁ",
       "a  b   c ", "\t\r\n", " " * 40, "x" + " " * 37 + "y", "aaaaaaaaaaaaaaaaa", "日本語テキスト" * 20, "​﻿", "  \n  \n",
       "�", "x" * 20_000, "word" * 9_000, " " * 5_000 + "x"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(PATH)


def assert_equal_to_library(encoder, library, text):
    ids = encoder.encode(text)
    told = library.encode(text, add_bos=True, add_eos=True)
    assert list(memoryview(ids).cast("I")) == told, text
    assert encoder.decode(ids).decode() == library.decode(told), text


def test_odd_texts(encoder, library):
    for text in ODD:
        assert_equal_to_library(encoder, library, text)


@settings(deadline=None, max_examples=400)
@given(st.text(alphabet=st.sampled_from(list(" ▁aeiounrstlLH\n.,-éüßж日\U0001f600\x00<>_()=0123")), max_size=60))
def test_any_text(text):
    assert_equal_to_library(pieces.piece_encoder(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), text)


def test_texts_of_the_vocabulary_s_own_tokens(encoder, library):
    draw = random.Random(11)
    tokens = list(encoder.model.tokens)
    for _ in range(5_000):
        text = "".join(draw.choice(tokens) for _ in range(draw.randint(1, 8))).replace(pieces.BLANK, " ")
        assert_equal_to_library(encoder, library, text)


def test_table_equals_plain_merging_and_has_one_token_for_each_prefix(encoder):
    model, draw = encoder.model, random.Random(5)
    for _ in range(100):
        word = "".join(draw.choice("▁▁aeinrstol") for _ in range(draw.randint(1, 24)))
        assert list(memoryview(model.word_ids(word)).cast("I")) == model.merge(word)[0]
        last = [None]
        for end in range(1, min(len(word), 6) + 1):
            fitting = [token for name, token in model.tokens.items()
                       if word.endswith(name, 0, end) and len(name) <= end and model.merge(name)[0] == [token]
                       and (len(name) == end or model.compatible(last[end - len(name)], token))]
            last.append(model.merge(word[:end])[0][-1])
            assert fitting == [last[-1]]


def test_pairs_are_compatible_if_merging_leaves_them(encoder):
    model, draw = encoder.model, random.Random(7)
    names = [name for name in model.tokens if len(name) < 5]
    reached = [name for name in names if model.merge(name)[0] == [model.tokens[name]]]
    seen = set()
    for _ in range(20_000):
        left, right = draw.choice(reached), draw.choice(reached)
        if right.startswith(pieces.BLANK) and not left.endswith(pieces.BLANK):
            continue
        pair = [model.tokens[left], model.tokens[right]]
        fits = model.merge(left + right)[0] == pair
        seen.add(fits)
        assert model.compatible(*pair) == fits, (left, right)
    assert seen == {True, False}


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_WORDS", 3)
    monkeypatch.setattr(pieces, "MEMO_PAIRS", 5)
    encoder = pieces.PieceEncoder(PATH)
    for text in ["one two three four five", "five six one two", "seven", "one two"] * 2:
        assert_equal_to_library(encoder, library, text)


def test_defined_cases_and_clashing_columns(spark, library):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x")] + [(10 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, -1, "x") for i, t in rows], "doc_id long, text string, ids long, decoded string")
    found = pieces.encode_documents(docs, PATH).collect()
    assert len(found) == len(rows)
    expected = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        expected.append((-1 if doc_id is None else doc_id, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in found) == sorted(expected)
    for r in found:
        assert r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert pieces.encode_documents(docs.limit(0), PATH).count() == 0


def test_query_equals_library_over_its_whole_table(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    told = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        told[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                          hashlib.sha256(library.decode(ids).encode()).hexdigest())
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256)
             for r in queries.op11_sentencepiece(spark, sf_dir).collect()}
    assert found == told
