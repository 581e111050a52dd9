"""Token shards against the tokenizers library, and by look-up."""

import binascii
import json

import numpy as np
import pytest

from seqloom.llm import sstable as op
from seqloom.llm.common import scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), binascii.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


ROWS = [
    (5, "Hello, World! it's  a test of é ́x Σίσυφος ΣΑΣ İstanbul"), (-3, None), (7, ""), (7, "same id"), (7, "same id"), (None, "no id"), (1 << 62, "a\x1cb\x1fc \x85 d"),
    (9, "<|endoftext|> a<|startoftext|>b"), (11, "word " * 70_000), (12, "x" * 5000), (13, "\n\t\x0b 日本語 ﬁ 12345 %%%### don't'll"),
]


def test_read_back_equals_the_library(spark):
    docs = spark.createDataFrame([(d, t, "c", 0) for d, t in ROWS], "doc_id long, text string, value string, n_tokens int")
    assert sorted(map(tuple, op.shards_digest(docs, PATH, 2).collect()), key=str) == sorted(brute(ROWS), key=str)


def test_empty_table(spark):
    assert op.shards_digest(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).collect() == []


@pytest.mark.parametrize("blocks", [1, 3, op.SHARD_BLOCKS])
def test_lookup_in_written_shards(spark, blocks, monkeypatch):
    """Shards of few blocks, in which ids repeat over blocks and files; each look-up reads a part of one file."""
    monkeypatch.setattr(op, "BLOCK_BYTES", 2000)  # for this process; the workers' blocks are larger
    rows = [(i * 2, f"text number {i} " * 40) for i in range(3000)] + [(777, "odd " * 90_000)] * 5 + [(None, "no id")]
    path = scratch(spark, "test")
    op.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH, 2, blocks)
    shards = op.Shards(spark, path)
    assert len(shards.files) > (1 if blocks < 4 else 0) and (blocks > 1 or len(shards.files) > 4)
    encode = op.ChunkEncoder(PATH, 4)
    for d, t in (rows[0], rows[1500], rows[2999], rows[-2], rows[-1]):
        assert shards.get(d).tobytes() == encode(t) + np.array([2], dtype="<u4").tobytes()
    assert all(shards.get(d) is None for d in (1, -5, 6000, 779))
    opened = [shards._shard(i) for i in range(len(shards.files))]
    assert sum(s.docs for s in opened) == len(rows) and all(len(s.index) <= blocks for s in opened)
    keys = [k for s in opened for k, _ in s]
    assert keys == sorted(keys)
    got = sorted(map(tuple, op.read_shards(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [op.from_key(k) for k in keys] and [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]


def test_other_tokenizers_are_given_whole_texts(tmp_path):
    """A byte-level tokenizer keeps white space, so chunks can't be encoded alone."""
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encode, library = op.ChunkEncoder(public_tokenizers.path(name), 4), Tokenizer.from_file(public_tokenizers.path(name))
        assert encode.by_chunks == (name == "word_bpe_49k.json")
        for _, text in ROWS:
            assert encode(text or "") == np.array(library.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
    with open(PATH, encoding="utf-8") as f:
        settings = json.load(f)
    assert op.drops_white_space(settings)
    settings["pre_tokenizer"]["pretokenizers"][0]["behavior"] = "Isolated"
    assert not op.drops_white_space(settings)


def test_blocks_and_damage():
    w, pieces = op.ShardWriter(2), []
    for i in range(50):
        pieces += w.add(op.to_key(i - 25), np.full(20_000, i, dtype="<u2").tobytes())
    data = b"".join(p + b"\n" for p in [*pieces, *w.close()])
    shard = op.Shard.of_bytes(data)
    assert len(shard.index) > 3 and [op.from_key(k) for k, _ in shard] == list(range(-25, 25))
    assert (shard.get(3) == 28).all() and shard.get(99) is None
    damaged = bytearray(data)
    damaged[20] ^= 1
    with pytest.raises(ValueError):
        list(op.Shard.of_bytes(bytes(damaged)))
