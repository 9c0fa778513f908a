"""Text queries over `documents` and `pages`, and budgets over their sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query
from tallyforge.operators import context as C
from tallyforge.operators import diff as D
from tallyforge.operators import evals as E
from tallyforge.operators import text as T
from tallyforge.sources.tables import table

NAMES = ["license", "token =", "password", "thing", "tion"]


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(
    "line_chunks_120",
    r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS l FROM documents), i AS (SELECT doc_id, l, unnest(range(0, (len(l) - 1) // 120 + 1)) AS i FROM l),
    c AS (SELECT doc_id, i, len(l) AS n, array_to_string(l[i * 120 + 1 : i * 120 + 120], chr(10)) AS body FROM i)
    SELECT doc_id, CAST(i * 120 + 1 AS INT) AS start_line, CAST(least(i * 120 + 120, n) AS INT) AS end_line, sha256(doc_id || ':' || t) AS content_hash, greatest(1, length(t) // 4) AS token_estimate
    FROM (SELECT *, CASE WHEN length(body) > 6000 THEN substr(body, 1, 6000) || chr(10) || '… truncated …' ELSE body END AS t FROM c) WHERE length(regexp_replace(body, '^\s+|\s+$', '', 'g')) >= 40""",
)
def line_chunks_120(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.window_chunks(docs(spark, sf_dir), "doc_id", "text").drop("body")


@query("token_estimate", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(
    "literal_search_topk",
    r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS l FROM documents), r AS (SELECT doc_id, unnest(l) AS line, CAST(generate_subscripts(l, 1) AS INT) AS line_no FROM l),
    n AS (SELECT unnest(['license', 'token =', 'password', 'thing', 'tion']) AS name, CAST(unnest([0, 1, 2, 3, 4]) AS INT) AS ordinal),
    h AS (SELECT doc_id, line_no, ordinal, name, CAST(row_number() OVER (PARTITION BY ordinal ORDER BY doc_id, line_no) AS INT) AS rank FROM r JOIN n ON contains(line, name)) SELECT * FROM h WHERE rank <= 6""",
)
def literal_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame(list(enumerate(NAMES)), "ordinal int, name string")
    return T.literal_search(docs(spark, sf_dir), "doc_id", "text", names).drop("line")


#: Every ninth character run of a passage as a name: hundreds of literals of two lengths, with blanks and marks in them.
MANY_NAMES = "n AS (SELECT item_id AS ordinal, substr(text, 3, 5) AS name FROM benchmark UNION ALL SELECT 10000 + item_id, substr(text, 20, 9) FROM benchmark)"


@query(
    "literal_search_many",
    rf"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS l FROM documents), r AS (SELECT doc_id, unnest(l) AS line, CAST(generate_subscripts(l, 1) AS INT) AS line_no FROM l), {MANY_NAMES}
    SELECT ordinal, name, doc_id, line_no, line, CAST(row_number() OVER (PARTITION BY ordinal ORDER BY doc_id, line_no) AS INT) AS rank FROM r JOIN n ON contains(line, name) WHERE NOT contains(name, chr(10)) QUALIFY rank <= 6""",
)
def literal_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC7: as many names as there are passages, twice, in one pass over the texts."""
    b = table(spark, sf_dir, "benchmark")
    names = b.select(F.col("item_id").alias("ordinal"), F.substring("text", 3, 5).alias("name")).unionByName(b.select((F.col("item_id") + 10000).alias("ordinal"), F.substring("text", 20, 9).alias("name")))
    return T.literal_search(docs(spark, sf_dir), "doc_id", "text", names)


@query(
    "cross_references",
    r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS l FROM documents WHERE doc_id % 20 <> 0), r AS (SELECT 'p' || doc_id AS path, unnest(l) AS line, CAST(generate_subscripts(l, 1) AS INT) AS line_no FROM l),
    n AS (SELECT item_id AS ordinal, substr(text, 5, 4) AS name FROM benchmark WHERE NOT contains(substr(text, 5, 4), chr(10)) ORDER BY item_id LIMIT 12), h AS (SELECT ordinal, name, path, line_no, line, CAST(row_number() OVER (PARTITION BY ordinal ORDER BY path, line_no) AS INT) AS rank FROM r JOIN n ON contains(line, name) QUALIFY rank <= 6),
    b AS (SELECT ordinal, coalesce(sum(count(*)) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h GROUP BY ordinal) SELECT h.* FROM h JOIN b USING (ordinal) WHERE before < 30""",
)
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first names of a change in all files but its own."""
    path = F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path")
    names = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ordinal"), F.substring("text", 5, 4).alias("name")).filter(~F.contains("name", F.lit("\n")))
    return T.cross_references(docs(spark, sf_dir).select(path, "text"), names, docs(spark, sf_dir).filter("doc_id % 20 = 0").select(path))


@query(
    "call_sites",
    r"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) AS name FROM documents UNION ALL SELECT page_id + 1000000, unnest(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) FROM pages)
    SELECT doc_id, name, count(*) AS n FROM c WHERE name NOT IN ('if','for','while','switch','return','catch','function') GROUP BY ALL""",
)
def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") + 1000000).alias("doc_id"), F.col("html").alias("text"))
    return T.call_sites(docs(spark, sf_dir).select("doc_id", "text").unionByName(pages), "doc_id", "text")


@query(
    "script_blocks",
    r"""WITH b AS (SELECT page_id, regexp_extract_all(html, '(?is)<script\b([^>]*)>(.*?)</script>', 2) AS b, regexp_extract_all(html, '(?is)<script\b([^>]*)>(.*?)</script>', 1) AS a FROM pages),
    r AS (SELECT page_id, unnest(a) AS a, unnest(b) AS body, CAST(generate_subscripts(b, 1) - 1 AS INT) AS ordinal FROM b)
    SELECT page_id, ordinal, CASE WHEN regexp_matches(a, 'lang=["'']ts["'']') THEN 'typescript' ELSE 'javascript' END AS lang, length(body) AS n_chars, sha256(body) AS body_sha FROM r""",
)
def script_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.script_blocks(table(spark, sf_dir, "pages"), "page_id", "html")


@query(
    "secret_hits",
    r"""WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 9 = 0 THEN ' AKIA' || upper(substr(sha256(text), 1, 16)) WHEN doc_id % 9 = 1 THEN chr(10) || '-----BEGIN RSA PRIVATE KEY-----' WHEN doc_id % 9 = 2 THEN ' password = "' || repeat('ab', 20) || '"' ELSE '' END AS text FROM documents),
    h AS (SELECT doc_id, 'assigned_hex' AS rule, unnest(regexp_extract_all(text, '(?:token|secret|password|api_key) = "([0-9a-f]{40})"', 1)) AS v FROM t UNION ALL SELECT doc_id, 'aws_key_id', unnest(regexp_extract_all(text, '(AKIA[0-9A-Z]{16})', 1)) FROM t UNION ALL SELECT doc_id, 'private_key', unnest(regexp_extract_all(text, '(-----BEGIN [A-Z ]*PRIVATE KEY-----)', 1)) FROM t)
    SELECT doc_id, rule, substr(v, 1, 4) || '***' AS redacted, 'P0' AS severity, 'security' AS category, 'secret_scan' AS detector FROM h WHERE rule <> 'assigned_hex' OR v <> repeat('ab', 20)""",
)
def secret_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with keys of each kind added to some; an assignment of a value that isn't random is no secret."""
    i = F.col("doc_id")
    more = F.when(i % 9 == 0, F.concat(F.lit(" AKIA"), F.upper(F.substring(F.sha2("text", 256), 1, 16)))).when(i % 9 == 1, "\n-----BEGIN RSA PRIVATE KEY-----").when(i % 9 == 2, ' password = "' + "ab" * 20 + '"').otherwise("")
    d = docs(spark, sf_dir).select("doc_id", F.concat("text", more).alias("text"))
    return T.secrets(d, "doc_id", "text").select("doc_id", "rule", "redacted", "severity", "category", "detector")


@query(
    "risk_tags",
    "WITH p AS (SELECT page_id, lower(url || ' ' || html || ' ' || CASE page_id % 7 WHEN 0 THEN 'Login' WHEN 1 THEN 'my_lock refund' WHEN 2 THEN 'oracle' WHEN 3 THEN 'wipe' ELSE 'jwt hmac' END) AS t FROM pages) SELECT page_id, tag, e AS evidence FROM (" + " UNION ALL ".join(f"SELECT page_id, '{k}' AS tag, regexp_extract(t, '{v}') AS e FROM p" for k, v in T.RISK_RULES.items()) + ") WHERE e <> ''",
)
def risk_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id") % 7
    named = F.when(i == 0, "Login").when(i == 1, "my_lock refund").when(i == 2, "oracle").when(i == 3, "wipe").otherwise("jwt hmac")
    return T.risk_tags(table(spark, sf_dir, "pages"), "page_id", F.concat_ws(" ", "url", "html", named))


@query("app_code_classifier", r"SELECT page_id, NOT regexp_matches(path, '^(?:(tests|test|fixtures|testdata|scripts|tools|examples|example|docs|doc|benchmarks)/.*|.*/(tests|test|fixtures|testdata|examples|docs)/.*|.*/[^ ]*_test\..*|.*/test_.*\.py|.*/.*\.(test|spec)\..*|.*/.*_spec\..*|.*/conftest\.py)$') AS app_code FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'tests/' WHEN 1 THEN 'a/docs/' WHEN 2 THEN 'test_' WHEN 3 THEN 'lib/test_x.py' WHEN 4 THEN 'src/' ELSE 'src/x_test.' END || CASE WHEN page_id % 6 = 3 THEN '' ELSE regexp_replace(url, '^https?://[^/]*/', '') END AS path FROM pages)")
def app_code_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, own = F.col("page_id") % 6, F.regexp_replace("url", "^https?://[^/]*/", "")
    path = F.when(i == 0, F.concat(F.lit("tests/"), own)).when(i == 1, F.concat(F.lit("a/docs/"), own)).when(i == 2, F.concat(F.lit("test_"), own)).when(i == 3, "lib/test_x.py").when(i == 4, F.concat(F.lit("src/"), own)).otherwise(F.concat(F.lit("src/x_test."), own))
    return table(spark, sf_dir, "pages").select("page_id", T.is_application(path, list(T.OTHER_GLOBS)).alias("app_code"))


@query(
    "selection_reasons",
    """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'binary file' WHEN doc_id % 10 = 3 THEN 'binary file' WHEN n_chars * 40 > 524288 THEN 'larger than 512 KB' WHEN n_chars * 40 = 0 THEN 'empty file' END AS reason, CASE doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'go' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'python' END AS language FROM documents""",
)
def selection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    path = F.concat(F.lit("a.b/f"), i.cast("string"), F.when(i % 10 == 0, ".PNG").when(i % 10 == 1, ".go").when(i % 10 == 2, "/.py").when(i % 10 == 3, F.element_at(F.array(*[F.lit(x) for x in T.BINARY]), (i % len(T.BINARY) + 1).cast("int"))).otherwise(".Py"))
    return docs(spark, sf_dir).select("doc_id", T.skip_reason(path, F.col("n_chars") * 40).alias("reason"), T.language(path).alias("language"))


@query("budget_break_prefix", "SELECT doc_id, unit, n_chars, used FROM (SELECT *, doc_id // 40 AS unit, CAST(sum(n_chars) OVER (PARTITION BY doc_id // 40 ORDER BY doc_id) AS BIGINT) AS used FROM documents) WHERE used <= 20000")
def budget_break_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.break_at_first_miss(units(spark, sf_dir).select("doc_id", "unit", "n_chars"), "unit", ["doc_id"], "n_chars", 20000)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty documents as the candidates of one unit."""
    return docs(spark, sf_dir).withColumn("unit", F.expr("doc_id div 40"))


@query(
    "budget_skip_fold",
    """WITH RECURSIVE d AS (SELECT doc_id // 40 AS unit, doc_id, n_chars, row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id) AS k FROM documents),
    f AS (SELECT unit, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS doc_id, false AS kept FROM (SELECT DISTINCT unit FROM d) UNION ALL
      SELECT d.unit, d.k, CASE WHEN f.used + n_chars <= 20000 THEN f.used + n_chars ELSE f.used END, d.doc_id, f.used + n_chars <= 20000 FROM f JOIN d ON d.unit = f.unit AND d.k = f.k + 1)
    SELECT unit, max(used) OVER (PARTITION BY unit) AS used, doc_id FROM f WHERE kept""",
)
def budget_skip_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.skip_and_continue(units(spark, sf_dir), "unit", "doc_id", "n_chars", 20000)


@query(
    "instruction_budget",
    """WITH l AS (SELECT doc_id, doc_id // 40 AS unit, length(text) AS n, 20000 - coalesce(sum(length(text)) OVER (PARTITION BY doc_id // 40 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM documents)
    SELECT doc_id, unit, CAST(least(n, room) AS INT) AS n_kept FROM l WHERE n <= room OR room >= 400""",
)
def instruction_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = C.truncating_budget(units(spark, sf_dir).select("doc_id", "unit", "text"), "unit", ["doc_id"], "text", 20000)
    return cut.select("doc_id", "unit", F.length("text").alias("n_kept"))


@query(
    "eval_recall",
    """WITH l AS (SELECT DISTINCT item_id, text FROM benchmark), h AS (SELECT item_id, min(doc_id) AS doc_id FROM l JOIN documents d ON contains(d.text, l.text) GROUP BY item_id) SELECT l.item_id, h.doc_id, h.doc_id IS NOT NULL AS hit FROM l LEFT JOIN h USING (item_id)""",
)
def eval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document that holds each expected passage."""
    return E.passages(table(spark, sf_dir, "benchmark"), docs(spark, sf_dir))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a diff that removes its even lines and adds its odd ones after one line of context."""
    rows = F.split(F.regexp_replace("text", "\n\\z", ""), "\n")
    body = F.transform("l", lambda x, i: F.concat(F.when(i == 0, " ").when(i % 2 == 0, "-").otherwise("+"), x))
    old = F.size(F.filter("l", lambda x, i: (i == 0) | (i % 2 == 0))).cast("string")
    new = F.size(F.filter("l", lambda x, i: (i == 0) | (i % 2 == 1))).cast("string")
    head = F.concat(F.lit("diff --git a/f"), "doc_id", F.lit(".txt b/f"), "doc_id", F.lit(".txt\n--- a/f"), "doc_id", F.lit(".txt\n+++ b/f"), "doc_id", F.lit(".txt\n@@ -10,"), old, F.lit(" +20,"), new, F.lit(" @@\n"))
    return docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), rows.alias("l")).select(F.col("doc_id").alias("diff_id"), F.concat(head, F.array_join(body, "\n")).alias("text"))


@query(
    "diff_parse",
    r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS l FROM documents), r AS (SELECT CAST(doc_id AS VARCHAR) AS diff_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS i FROM l)
    SELECT diff_id, 'f' || diff_id || '.txt' AS path, CAST(i + 1 AS INT) AS pos, CASE WHEN i = 0 THEN ' ' WHEN i % 2 = 0 THEN '-' ELSE '+' END AS kind, CAST(CASE WHEN i % 2 = 0 THEN 10 + i // 2 END AS INT) AS old_line,
      CAST(CASE WHEN i = 0 THEN 20 WHEN i % 2 = 1 THEN 20 + (i + 1) // 2 END AS INT) AS new_line, text FROM r""",
)
def diff_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.parse_diffs(diffs(spark, sf_dir)).select("diff_id", "path", "pos", "kind", "old_line", "new_line", "text")


@query(
    "diff_ranges",
    r"""WITH l AS (SELECT doc_id, len(string_split(regexp_replace(text, '\n\z', ''), chr(10))) AS n FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS diff_id, 'f' || doc_id || '.txt' AS path, CAST(1 AS INT) AS hunk, n // 2 AS added, (n - 1) // 2 AS removed, CAST(CASE WHEN n > 1 THEN 21 END AS INT) AS lo, CAST(CASE WHEN n > 1 THEN 20 + n // 2 END AS INT) AS hi FROM l""",
)
def diff_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.changed_ranges(D.parse_diffs(diffs(spark, sf_dir)))


@query(
    "added_secrets",
    r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS l FROM documents), r AS (SELECT CAST(doc_id AS VARCHAR) AS diff_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS i FROM l)
    SELECT diff_id, 'f' || diff_id || '.txt' AS path, CAST(20 + (i + 1) // 2 AS INT) AS line, 'assigned_hex' AS rule, substr(unnest(regexp_extract_all(text, '(?:token|secret|password|api_key) = "([0-9a-f]{40})"', 1)), 1, 4) || '***' AS redacted, 'P0' AS severity, 'security' AS category, 'secret_scan' AS detector FROM r WHERE i % 2 = 1""",
)
def added_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-SECRET: the added lines of the documents' diffs only."""
    return D.added_secrets(D.parse_diffs(diffs(spark, sf_dir)))
