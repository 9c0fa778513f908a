"""The queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.backoff import backoff_scores
from tallyforge.llm.exact import exact_dedup
from tallyforge.llm.hardneg import mine_negatives
from tallyforge.llm.packing import pack
from tallyforge.llm.quality import quality_rules
from tallyforge.llm.rans import read_ids, write_ids
from tallyforge.llm.simhash import near_dedup
from tallyforge.llm.sitetree import extract_text
from tallyforge.llm.substring import substring_dedup
from tallyforge.llm.tokencount import count_tokens
from tallyforge.llm.tput import search
from tallyforge.llm.treebpe import encode_decode
from tallyforge.llm.zipwarc import read_archives, write_archives

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), words=True, end_id=1))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), words=False, end_id=0)


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op7_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op10_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(_table(spark, sf_dir, "pages")))


def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(_table(spark, sf_dir, "documents")).withColumn("log_score", F.round("log_score", 4))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), words=True)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.withColumn("label", relabelled))


def op13_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op12_hard_negatives": op12_hard_negatives,
    "op13_tput_search": op13_tput_search,
    "op11_token_counts": op11_token_counts,
    "op9_stupid_backoff": op9_stupid_backoff,
    "op10_zip_warc": op10_zip_warc,
    "op1_token_files": op1_token_files,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_site_style_tree": op3_site_style_tree,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_tree_bpe": op7_tree_bpe,
    "op8_quality_rules": op8_quality_rules,
    "op4_simhash": op4_simhash,
    "op5_exact_dedup": op5_exact_dedup,
}

ORACLE_SQL = {
    "op5_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER (PARTITION BY k) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
          doc_id = max(doc_id) OVER (PARTITION BY k) AS kept, sha256(k) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}') AS k FROM documents)""",
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
          FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5""",
    "op13_tput_search": f"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
        n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
        c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
        m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM n, c),
        f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term, docs),
        s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20""",
    "op10_zip_warc": """
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
        FROM (SELECT *, payload_bytes >= 100 AND page_id <> first AS again
          FROM (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first
            FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)))""",
    "op9_stupid_backoff": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
        w AS (SELECT doc_id, len(l) AS n_words, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM d),
        g AS (SELECT *, lag(w) OVER s AS v, lag(w, 2) OVER s AS u FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
        c AS (SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS one,
            count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) AS two,
            count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY doc_id, u, v, w) AS three, count(*) OVER () AS every FROM g),
        p AS (SELECT *, lag(one) OVER s AS one_before, lag(two) OVER s AS two_before FROM c WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
        s AS (SELECT doc_id, CASE WHEN u IS NOT NULL AND three > 0 THEN 3 WHEN v IS NOT NULL AND two > 0 THEN 2 ELSE 1 END AS k,
            CASE WHEN u IS NOT NULL AND three > 0 THEN ln(three / two_before)
              WHEN v IS NOT NULL AND two > 0 THEN ln(two / one_before) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
              ELSE ln(greatest(one, 0.5) / greatest(every - n_words, 1)) + least(i - 1, 2) * ln(0.4) END AS x FROM p)
        SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_words, count(*) FILTER (k = 3) AS n_trigram, count(*) FILTER (k = 2) AS n_bigram,
          count(*) FILTER (k = 1) AS n_unigram, round(coalesce(sum(x), 0), 4) AS log_score FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, l""",
}
