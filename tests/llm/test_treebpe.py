"""Tree BPE against the tiktoken library."""

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import treebpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = st.sampled_from(["the", "The", "élan", "aaaa", "ab" * 20, "don't", "'s", "x", "42", ",", ".", "***", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "’", "é", "日本", "🙂", "<|endoftext|>", "&amp;", "antidisestablishmentarianism"])


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.lists(PARTS, max_size=12).map("".join), st.text(max_size=60)))
def test_library(text):
    text = text.encode("utf-8", "replace").decode()
    t = treebpe.tree_encoder(PATH, P.PATTERN)
    ids = np.frombuffer(t.encode(text), "<u4").tolist()
    assert ids == LIBRARY.encode_ordinary(text) and t.decode(ids) == text.encode()


def test_long_matches():
    t, r = treebpe.tree_encoder(PATH, P.PATTERN), random.Random(9)
    for n in (50, 700, 5000):
        for letters in ("a", "ab", "etaoin", "abcdefghijklmnopqrstuvwxyz"):
            s = "".join(r.choice(letters) for _ in range(n))
            assert np.frombuffer(t.encode(s), "<u4").tolist() == LIBRARY.encode_ordinary(s)


def test_ranks_at_once():
    """Long windows, merged rank by rank, against one merge at a time."""
    t, r = treebpe.tree_encoder(PATH, P.PATTERN), random.Random(10)
    for n in (193, 300, 900):
        for letters in ("=", "a", "ab", "aab", "=-", "ha", "etaoin shrdlu", "aáz"):
            for s in (letters * n, "".join(r.choice(letters) for _ in range(n))):
                raw = s[:n].encode()
                got = t._by_ranks(raw)
                assert got is None or got == t._one_by_one(raw)
                assert t.leaf(raw) == t._one_by_one(raw)


def test_a_megabyte():
    t, r = treebpe.tree_encoder(PATH, P.PATTERN), random.Random(11)
    for s in ("=" * 1_000_000, "a" * 1_000_000, "-=" * 250_000, "".join(r.choice("etaoinshrdlu") for _ in range(300_000))):
        begin = time.process_time()
        got = np.frombuffer(t.encode(s), "<u4").tolist()
        assert time.process_time() - begin < 30
        assert got == LIBRARY.encode_ordinary(s) and t.decode(got) == s.encode()


def test_every_token_is_reached_by_merges():
    t = treebpe.tree_encoder(PATH, P.PATTERN)
    for raw, rank in RANKS.items():
        if len(raw) > 1:
            pairs = [(RANKS.get(raw[:i]), RANKS.get(raw[i:])) for i in range(1, len(raw))]
            assert any(a is not None and b is not None for a, b in pairs), raw
            assert t.join(t.leaf(raw[: len(raw) // 2]), t.leaf(raw[len(raw) // 2 :])) == [rank]


def test_documents(spark):
    rows = [(1, "The theory."), (2, None), (3, ""), (4, "word " * 30_000), (5, "twin"), (5, "twin"), (None, "é\n\n x")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, ids string")
    got = treebpe.encode_decode(df, PATH, P.PATTERN)
    want = []
    for i, t in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] or -1, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert treebpe.encode_decode(df.limit(0), PATH, P.PATTERN).collect() == []
