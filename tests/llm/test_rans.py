"""Token ids: the cached pieces against the library on whole texts, and the coder's round trip."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm import rans
from tallyforge.llm.tokens import whole_texts

VOCABULARIES = {"word_bpe_49k.json": True, "byte_bpe_50k.json": False}
LIBRARY = {k: Tokenizer.from_file(public_tokenizers.path(k)) for k in VOCABULARIES}
PARTS = st.sampled_from(["the", "The", "élan", "STRASSE", "straße", "don't", "'s", "x", "42", ",", ".", "***", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\xa0", " ", "’", "İ", "ΑΣ", "é", "日本", "🙂", "<|endoftext|>", "&amp;"])


@pytest.mark.parametrize("name", VOCABULARIES)
@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_pieces(name, text):
    t = whole_texts(public_tokenizers.path(name), VOCABULARIES[name])
    assert np.frombuffer(t.encode(text.encode()), t.dtype).tolist() == LIBRARY[name].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", VOCABULARIES)
@pytest.mark.parametrize("text", ["\n\n<|endoftext|>", "a\n\n<|endoftext|> b", " <|endoftext|>  <|ENDOFTEXT|>x\n", "<|startoftext|><|endoftext|>\n\n", "a.\nB! <|endoftext"])
def test_added_tokens(name, text):
    test_pieces.hypothesis.inner_test(name, text)


@pytest.mark.parametrize("n", [0, 1, 31, rans.BLOCK, rans.BLOCK + 1, 5 * rans.BLOCK - 7])
def test_round_trip(n):
    r = np.random.default_rng(n)
    ids = (r.zipf(1.3, n) % 49_000).astype(np.uint32)
    total, parts = rans.unpack_shard(rans.pack_shard([None, 5], [n, 0], ids))
    assert total == n and (rans.decode(parts, n) == ids).all()
    if n > 2 * rans.BLOCK:
        assert (rans.decode(parts, n, 2, 4) == ids[2 * rans.BLOCK : 4 * rans.BLOCK]).all()
        entropy = -sum(p * np.log2(p) for p in np.unique(ids, return_counts=True)[1] / n) * n / 8
        assert parts["words"].nbytes < 1.05 * entropy
        broken = dict(parts, words=parts["words"] ^ np.uint32(1))
        with pytest.raises(ValueError):
            rans.decode(broken, n)


def test_one_symbol_and_wide_alphabet():
    for ids in (np.full(40_000, 7, np.uint32), np.arange(70_000, dtype=np.uint32)):
        n, parts = rans.unpack_shard(rans.pack_shard([1], [len(ids)], ids))
        assert (rans.decode(parts, n) == ids).all()


SMALL = {"BLOCK": 64, "SHARD_IDS": 900, "GROUP": 3}


def with_small(task):
    """A task with small blocks, shards and groups; its worker has the usual ones again afterwards."""

    def run(*args):
        usual = {k: getattr(rans, k) for k in SMALL}
        rans.__dict__.update(SMALL)
        try:
            yield from task(*args)
        finally:
            rans.__dict__.update(usual)

    return run


@pytest.mark.parametrize("small", [False, True])
def test_files(spark, small, monkeypatch):
    if small:
        for k, v in SMALL.items():
            monkeypatch.setattr(rans, k, v)
        monkeypatch.setattr(rans, "_read", with_small(rans._read))
        monkeypatch.setattr(rans, "_write", with_small(rans._write))
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["alpha", "Beta,", "gamma.\n", "été"]) for _ in range(r.randint(0, 60))), "p") for i in r.sample(range(1000), 80)]
    rows += [(5000, None, "p"), (5001, "", "p"), (5002, "word " * 20_000, "p"), (5003, "twin", "p"), (5003, "twin", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = sorted(map(tuple, rans.read_ids(rans.write_ids(df, path, True, 1)).collect()))
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda x: x[0]):
        ids = [*LIBRARY["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert rans.read_ids(rans.write_ids(df.limit(0), path, True, 1)).collect() == []
    assert rans.read_ids(rans.write_ids(spark.createDataFrame([(None, "a", "p"), (1, "b", "p")], df.schema), path, True, 1)).count() == 2
