"""Queries of the scalar functions and of the table sinks' row semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query
from tallyforge.functions import scalars as X
from tallyforge.operators import diff as D
from tallyforge.operators import posting as P
from tallyforge.operators import queue as Q
from tallyforge.operators import text as T
from tallyforge.sources.tables import table

S_ = "string"


@query("request_digests", "SELECT doc_id, sha256('{\"lang\":\"' || lang || '\",\"n\":' || n_chars || '}') AS digest FROM documents")
def request_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.request_hash(F.col("lang").alias("lang"), F.col("n_chars").alias("n")).alias("digest"))


@query("review_ids", "SELECT doc_id, 'rev-' || substr(sha256('[\"' || lang || '\",\"' || source || '\",\"d' || doc_id || '\"]'), 1, 12) AS review_id, 'r' || doc_id || ':' || substr(sha256(text), 1, 12) AS finding_id FROM documents")
def review_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast(S_)
    return table(spark, sf_dir, "documents").select("doc_id", X.review_id(F.col("lang"), F.col("source"), F.concat(F.lit("d"), i)).alias("review_id"), X.finding_id(F.concat(F.lit("r"), i), F.sha2("text", 256)).alias("finding_id"))


@query("filled_templates", "SELECT doc_id, 'In ' || lang || ': ' || CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END || '.' AS filled FROM documents")
def filled_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = {"lang": F.col("lang"), "source": F.when(F.col("doc_id") % 2 == 0, F.col("source"))}
    return table(spark, sf_dir, "documents").select("doc_id", X.fill_template(F.lit("In {{lang}}: {{source}}{{unknown}}."), slots).alias("filled"))


@query("chunk_texts", "SELECT doc_id, source || ':' || doc_id % 9 || '-' || (doc_id % 9 + 5) || chr(10) || text AS embedded FROM documents")
def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 9
    return table(spark, sf_dir, "documents").select("doc_id", X.chunk_text(F.col("source"), i, i + 5, F.col("text")).alias("embedded"))


@query("repository_names", "SELECT page_id, regexp_extract(lower(url), '^https?://([^/]*)', 1) || '/own/name' || page_id AS repository FROM pages")
def repository_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, i = F.regexp_extract("url", "^https?://([^/]*)", 1), F.col("page_id")
    k = i % 4
    forms = F.when(k == 0, F.concat(F.lit("https://"), host, F.lit("/Own/Name"), i.cast(S_), F.lit(".git"))).when(k == 1, F.concat(F.lit("git@"), host, F.lit(":own/name"), i.cast(S_)))
    forms = forms.when(k == 2, F.concat(F.lit(" ssh://git@"), host, F.lit(":22/own/name"), i.cast(S_), F.lit("/"))).otherwise(F.concat(host, F.lit("/own/name"), i.cast(S_), F.lit(".git/")))
    return table(spark, sf_dir, "pages").select("page_id", X.repository(forms).alias("repository"))


@query("diff_header_paths", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'src/f' || doc_id WHEN 1 THEN 'src/f' || doc_id WHEN 3 THEN 'plain' || doc_id END AS path FROM documents")
def diff_header_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    h = F.when(i % 4 == 0, F.concat(F.lit("--- a/src/f"), i.cast(S_))).when(i % 4 == 1, F.concat(F.lit("+++ b/src/f"), i.cast(S_), F.lit("\t2024-01-01"))).when(i % 4 == 2, F.lit("+++ /dev/null")).otherwise(F.concat(F.lit("+++ plain"), i.cast(S_)))
    return table(spark, sf_dir, "documents").select("doc_id", X.diff_path(h).alias("path"))


@query("language_groups", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'web' WHEN 2 THEN 'go' WHEN 3 THEN 'web' END AS language, CASE doc_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'go' WHEN 3 THEN 'vue' WHEN 5 THEN 'python' END AS grammar FROM documents")
def language_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".py", ".ts", ".go", ".vue", ".md", ".PYI")]), (F.col("doc_id") % 6 + 1).cast("int"))
    path = F.concat(F.lit("a/b"), suffix)
    return table(spark, sf_dir, "documents").select("doc_id", X.suffix_language_group(path).alias("language"), T.language(path).alias("grammar"))


@query("location_labels", "SELECT doc_id, source || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ':' || n_chars % 50 ELSE ':' || n_chars % 50 || '-' || (n_chars % 50 + 3) END AS label FROM documents")
def location_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("doc_id") % 3, F.col("n_chars") % 50
    return table(spark, sf_dir, "documents").select("doc_id", P.location_label(F.col("source"), F.when(k > 0, n), F.when(k == 2, n + 3).when(k == 1, n)).alias("label"))


@query("ignored_inserts", "SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'old' ELSE 'new' END AS v, CASE WHEN user_id % 2 = 0 THEN 0 ELSE min(event_id) END AS event_id FROM events GROUP BY user_id")
def ignored_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.lit("new").alias("v"), "event_id")
    old = e.filter("user_id % 2 = 0").select("user_id", F.lit("old").alias("v"), F.lit(0).cast("long").alias("event_id")).distinct()
    return Q.insert_or_ignore(old, e, ["user_id"], ["event_id"])


@query("replaced_keys", "SELECT user_id, event_id, CASE WHEN user_id % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM events WHERE user_id % 3 > 0 OR event_id % 5 = 0")
def replaced_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.lit("old").alias("v"))
    kept = e.filter("user_id % 3 > 0 or event_id % 5 = 0")
    whole = kept.unionByName(e.filter("user_id % 3 = 0 and event_id % 5 > 0 and event_id < 0"))
    return Q.replace_by_key(whole, kept.filter("user_id % 3 = 0").withColumn("v", F.lit("new")), "user_id")


@query("searched_hits", "WITH h AS (SELECT CAST(p_partkey % 25 AS INT) AS ordinal, p_partkey FROM part), n AS (SELECT ordinal, count(*) AS n FROM h GROUP BY ordinal), b AS (SELECT ordinal, coalesce(sum(n) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) SELECT ordinal, p_partkey FROM h JOIN b USING (ordinal) WHERE before < 30")
def searched_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return T.searched_names(table(spark, sf_dir, "part").select((k % 25).cast("int").alias("ordinal"), k))


@query(
    "risky_candidates",
    "SELECT doc_id, unnest(CASE doc_id % 4 WHEN 0 THEN ['handler' || doc_id] WHEN 1 THEN ['/v1/items' || doc_id] WHEN 2 THEN ['app.core.item' || doc_id, 'app.b.c'] ELSE []::VARCHAR[] END) AS name FROM documents",
)
def risky_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    k = i % 4
    line = F.when(k == 0, F.concat(F.lit("+export async function handler"), i.cast(S_), F.lit("(x) {"))).when(k == 1, F.concat(F.lit("-@get('/v1/items"), i.cast(S_), F.lit("')"))).when(k == 2, F.concat(F.lit(' x("app.core.item'), i.cast(S_), F.lit('", \'app.b.c\')'))).otherwise("+def _own(x):")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(D.candidates(line)).alias("name"))
