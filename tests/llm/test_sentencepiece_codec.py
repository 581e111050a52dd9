"""Pieces and decoding against the library."""

import hashlib
import random

import numpy as np
import pytest

from seqloom.llm import sentencepiece_codec as op

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(7)
    out = ["", "  a  b ", "x\n\ny  \t z", "日本語 テスト 🙂", "▁▁a ▁", "a" * 300, " lead", "trail ", "<s> </s> <unk> <0x41>", "é́", "\x00\x01", " " * 5000, "word " * 3000, "ab" * 40_000]
    letters = "abcdefghinorstu ,.é\n"
    return out + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 200))) for _ in range(300)]


def test_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = list(enumerate(texts())) + [(1000, None), (1001, "same"), (1001, "same"), (None, "no id")]
    docs = spark.createDataFrame([(d, t, 3) for d, t in rows], "doc_id long, text string, ids int")
    want = []
    for d, t in rows:
        ids = library.encode(t or "")
        want.append((d, ids, len(ids), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, op.encode_documents(docs, PATH).collect()), key=str) == sorted(want, key=str)


def test_plain_texts_come_back():
    codec = op.Codec(op.read_model(PATH))
    for text, data in zip(texts(), codec.encode(texts()), strict=True):
        assert codec.decode(np.frombuffer(data, dtype="<i4").tolist()) == text.replace(op.MARK, " ")


def test_unigram_is_viterbi():
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -2.2, "▁a": -2.9, "bab": -3.1, "▁ab": -3.3, "ba": -2.1}
    model = op.Model(["<unk>", *pieces], [0.0, *pieces.values()], [op.UNKNOWN] + [op.NORMAL] * len(pieces))
    codec, rng = op.Codec(model), random.Random(1)
    for _ in range(200):
        word = op.MARK + "".join(rng.choice("ab") for _ in range(rng.randrange(0, 9)))

        def best(rest):
            return max(((pieces[rest[:k]] + best(rest[k:])[0], [rest[:k], *best(rest[k:])[1]]) for k in range(1, min(4, len(rest)) + 1) if rest[:k] in pieces), default=(-1e9, [])) if rest else (0.0, [])

        got = [model.pieces[i] for i in np.frombuffer(codec.encode([word.replace(op.MARK, " ")[1:]])[0], dtype="<i4")] if len(word) > 1 else None
        if got is not None:
            assert sum(pieces[p] for p in got) == pytest.approx(best(word)[0])


def test_empty_table(spark):
    assert op.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
