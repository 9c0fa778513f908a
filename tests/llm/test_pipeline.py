"""The pipeline's stages against brute force, each on what the one before it kept."""

import corpus_pipeline
import public_tokenizers
from test_dedup import low
from test_packing import check
from test_quality import verdicts
from test_similar import roots
from test_substring import brute

from tallyforge.llm.tokens import whole_texts


def words(t):
    return t.encode().split()


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]

    def ran(stage, docs):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == columns
        return out, sorted(map(tuple, out.collect()))

    kept = verdicts([(r[0], r[1], r[2], r[3]) for r in rows])
    rows = sorted(r for r, k in zip(rows, kept, strict=True) if k)
    docs, got = ran(corpus_pipeline.quality_stage, docs)
    assert got == rows and len(rows) > 100

    last = {low(r[1]): r[0] for r in rows}
    rows = [r for r in rows if last[low(r[1])] == r[0]]
    docs, got = ran(corpus_pipeline.exact_stage, docs)
    assert got == rows

    root = roots([r[1] for r in rows])
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    docs, got = ran(corpus_pipeline.similar_stage, docs)
    assert got == rows

    want = {r[0]: r for r in brute([(r[0], r[1]) for r in rows], 13)}
    docs, got = ran(corpus_pipeline.substring_stage, docs)
    assert [r[0] for r in got] == [r[0] for r in rows]
    for old, new in zip(rows, got, strict=True):
        assert len(words(old[1])) - len(words(new[1])) == want[old[0]][2] and new[2:4] == old[2:4]
        assert new[4] == (len(new[1]) if want[old[0]][2] else old[4]) and (want[old[0]][2] or new[1] == old[1])

    n, least = check(corpus_pipeline.packing_stage(spark, docs, "").collect(), [(r[0], r[1]) for r in got], 2048)
    assert n <= 1.05 * least + 2


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_number string, batch long"


def test_odd_rows(spark):
    """Null and repeated ids, equal rows, empty and very long texts, columns that share names with the operators' own."""
    long = " ".join(f"v{i % 9973}" for i in range(30_000))
    text, other = " ".join(f"w{i}" for i in range(80)), " ".join(f"u{i}" for i in range(90))
    near = " ".join(f"w{i}" for i in range(78))
    few = "too few words"
    tail = ("en", "a", 0, "x", 1)
    rows = [(None, text, *tail), (None, text, *tail), (1, None, None, None, None, None, None), (2, "", *tail), (3, long, *tail), (4, text, *tail), (4, text, *tail), (4, few, *tail), (5, near, *tail), (5, other, *tail), (None, other.upper(), *tail), (None, few, *tail)]
    key = lambda r: tuple((x is not None, x) for x in r)
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").collect() == []

    def ran(stage, docs, want):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)

    kept = [r for r, k in zip(rows, verdicts([r[:4] for r in rows]), strict=True) if k]
    assert {r[0] for r in kept} >= {None, 4, 5} and few not in {r[1] for r in kept}
    ran(corpus_pipeline.quality_stage, docs, kept)
    ran(corpus_pipeline.exact_stage, docs, [rows[i] for i in (3, 4, 5, 7, 8, 9)])
    ran(corpus_pipeline.similar_stage, docs, [rows[i] for i in (2, 4, 5, 7, 9)])
    gone = [r if r[0] != 5 or r[1] != near else (5, "", *r[2:4], 0, *r[5:]) for r in rows]
    gone = [(None, "", *r[2:4], 0, *r[5:]) if r[0] is None and r[1] == text else r for r in gone]
    ran(corpus_pipeline.substring_stage, docs, [(1, "", *r[2:]) if r[0] == 1 else r for r in gone])
    pieces = corpus_pipeline.packing_stage(spark, docs, "").collect()
    ids = [(r[0], whole_texts(public_tokenizers.path("byte_bpe_50k.json"), False).encode((r[1] or "").encode())) for r in rows]
    assert sorted(((p.doc_id, p.length) for p in pieces if p.start == 0 and p.doc_id != 3), key=key) == sorted(((i, len(x) // 2 + 1) for i, x in ids if i != 3), key=key)
    assert sum(p.length for p in pieces if p.doc_id == 3) == len(ids[4][1]) // 2 + 1


def test_splits_change(spark, tmp_path):
    """Each stage keeps what it should when its table is split in another way between the call and the write."""
    at = str(tmp_path / "documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(7).write.option("parquet.block.size", 1 << 15).parquet(at)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = spark.read.parquet(at)
        want = sorted(map(tuple, stage(spark, docs, "").collect()))
        made = stage(spark, docs, "")
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "30k")
            assert sorted(map(tuple, made.collect())) == want and len(want) > 100
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_run(spark, tmp_path):
    """All stages from end to end, over rows of every odd kind."""
    long = " ".join(f"v{i % 9973}" for i in range(6_000))
    texts = [None, "", "few words", long, long.upper(), *(" ".join(f"{c}{(i * k) % 601}" for i in range(120)) for k in (7, 11) for c in "pqr")]
    texts += [f"{texts[5]} {texts[8]}", texts[5], " ".join(texts[6].split()[:118])]
    rows = [(None if i == 7 else i // 2, t, "en" if i % 3 else None, "a", len(t or ""), "x", i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        kept = docs.collect()
    ids = sorted(((r.doc_id, len(whole_texts(public_tokenizers.path("byte_bpe_50k.json"), False).encode((r.text or "").encode())) // 2 + 1) for r in kept), key=lambda x: (x[0] is None, x))
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    want = {}
    for i, n in ids:
        want[i] = want.get(i, 0) + n
    assert total == want and 3 <= len(kept) < len(rows)
