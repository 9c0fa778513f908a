"""Packing: pieces against the library, sequences whole and gapless, and near the least number."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyforge.llm import packing

NAME = "byte_bpe_50k.json"
PATH = public_tokenizers.path(NAME)


def check(rows, texts, size):
    lib = Tokenizer.from_file(PATH)
    want = []
    for i, t in texts:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % size + 1
        bounds = [0, *range(first, len(ids) + 1, size)]
        want += [(i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip(bounds, bounds[1:]))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences), -(-sum(r.length for r in rows) // size)


def test_pack(spark):
    r = random.Random(6)
    texts = [(i, " ".join(r.choice(["alpha", "Beta,", "gamma.\n", "été"]) for _ in range(min(900, int(r.lognormvariate(3, 1.2)))))) for i in range(800)]
    texts += [(800, None), (801, ""), (802, "word " * 4000), (803, "twin"), (803, "twin"), (None, "no id"), *((900 + i, "a b c d") for i in range(300))]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, sequence_id int")
    n, least = check(packing.pack(df, PATH, False, 0, 256).collect(), texts, 256)
    assert n <= least * 1.02 + 2
    assert packing.pack(df.limit(0), PATH, False, 0, 256).collect() == []
    one = packing.pack(df.filter("doc_id = 800"), PATH, False, 0, 256, with_ids=True).collect()
    assert len(one) == 1 and one[0].ids == b"\0\0\0\0"


def test_plans_place_every_piece_once():
    r = random.Random(8)
    for size in (64, 2048):
        counts = {r.randint(size // 12 + 1, size - 1): r.randint(1, 50) for _ in range(200)}
        order = sorted(counts, reverse=True)
        flat = [k for k in order for _ in range(counts[k])]
        firsts, slots, n = packing.configurations(order, [counts[k] for k in order], size, 40)
        load, seen = [0] * n, 0
        for g, first in enumerate(firsts):
            last = firsts[g + 1] if g + 1 < len(firsts) else len(flat)
            rank = np.arange(last - first)
            e, seq, _ = packing._by_rank(rank, np.full(len(rank), g), slots)
            for k in range(len(rank)):
                load[slots[g][e[k]].first + seq[k]] += flat[first + k]
                seen += 1
        assert seen == len(flat) and max(load) <= size
        room = defaultdict(int)
        for x in load:
            room[size - x] += 1
        smalls = {r.randint(1, size // 12): r.randint(1, 300) for _ in range(20)}
        fills, added = packing.best_fit(smalls, dict(room), size)
        used = defaultdict(int)
        for length, fs in fills.items():
            assert sum(f.per * f.count for f in fs) == smalls[length]
            for f in fs:
                for k in range(f.count):
                    used[f.residual, f.first + k] += f.per * length
        assert all(v <= k[0] and k[1] < room.get(k[0], 0) + (added if k[0] == size else 0) for k, v in used.items())
