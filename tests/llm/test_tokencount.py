"""Token counts against the library on whole texts."""

import public_tokenizers
from tokenizers import Tokenizer

from tallyforge.llm import queries
from tallyforge.llm.tokencount import count_tokens

TEXTS = [None, "", " ", "One two, THREE. four!five", "<|endoftext|>x <|ENDOFTEXT|> a<|startoftext|>b", "it's don't I'LL 12 3456 a1b2", "é É Été", "İstanbul ΣΣ ß",
         "a b c\u0085d　e\x1cf", "tab\tline\r\nfeed\x0b\x0cend", "###### ---- !!!", "中文 \U0001f600\U0001f600", "word " * 5000, "x" * 3000, "One two, THREE. four!five"]


def want(texts, name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return sorted((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in texts)


def test_counts(spark):
    rows = [*enumerate(TEXTS), (3, TEXTS[3])]
    df = spark.createDataFrame([(i, t, 1, "p", 2) for i, t in rows], "doc_id long, text string, run int, piece string, place int").repartition(3)
    for name, words in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        for run_bytes in (1, 5000, 1 << 24):
            got = count_tokens(df, public_tokenizers.path(name), words, run_bytes=run_bytes)
            assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            assert sorted(map(tuple, got.collect())) == want(rows, name)
    assert count_tokens(df.limit(0), public_tokenizers.path("word_bpe_49k.json"), True).collect() == []
    lost = count_tokens(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), True)
    assert sorted(r.n_tokens for r in lost.filter("doc_id IS NULL").collect()) == [0, 2]


def test_table(spark):
    at = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op11_token_counts"](spark, at).collect())) == want(rows, "word_bpe_49k.json")
