import hashlib
import random

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pieces

LIB = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
CODER = pieces.Agenda(pieces.model_path())
ODD = ["", " ", "  ", "a", " a", "a ", "  a  b ", "\n", "a\nb\t c", "▁", "a▁b", "▁▁ x", "漢字 😀 ​", "\x00", "<s> </s> <unk> <0x0A>", "é" * 50, "x" * 3000, " " * 40 + "y", "a  b   c     d", "﻿a", "́e", "\r\n\r\n"]


def test_odd_texts():
    for text in ODD:
        ids = CODER.encode([text])[0]
        assert ids == LIB.encode(text), repr(text)
        assert CODER.decode(ids) == LIB.decode(ids), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n▁abet"))))
def test_any_text(text):
    ids = CODER.encode([text])[0]
    assert ids == LIB.encode(text)
    assert CODER.decode(ids) == LIB.decode(ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(3, 400) | st.integers(3, 31999), max_size=12))
def test_decode_any_bytes(ids):
    if all(CODER.kinds[i] == 1 for i in ids):
        assert CODER.decode(ids) == LIB.decode(ids)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in pieces.query(spark, sf_dir).collect():
        ids = LIB.encode(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "a b", "y"), (2, "", "z")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, r.n_tokens, tuple(r.ids), r.decoded) for r in pieces.encode(df).collect())
    ab = tuple(LIB.encode("a b"))
    assert got == [(0, len(ab), ab, "a b"), (1, 0, (), ""), (1, 0, (), ""), (2, 0, (), "")]
    assert pieces.encode(df.limit(0)).collect() == []


def test_memory_is_bounded():
    coder = pieces.Agenda(pieces.model_path(), memory=10)
    rng = random.Random(1)
    for _ in range(20):
        text = " ".join("".join(rng.choices("abcdé", k=6)) for _ in range(8))
        assert coder.encode([text])[0] == LIB.encode(text)
        assert len(coder.memo) <= 27 and len(coder.older) <= 27
