"""Queries of a review's steps: diffs, plans, contexts, answers, posting and reports, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query
from tallyforge.operators import diff as D
from tallyforge.operators import evals as E
from tallyforge.operators import graph as G
from tallyforge.operators import index as I
from tallyforge.operators import memory as M
from tallyforge.operators import planning as P
from tallyforge.operators import posting as T
from tallyforge.operators import review as R
from tallyforge.operators import snapshots as N
from tallyforge.operators import stats as S
from tallyforge.operators import text as W
from tallyforge.plans.findings import findings, printed
from tallyforge.plans.stats import feedback, vectors
from tallyforge.sources.tables import table

S_ = "string"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def numbered(prefix: str, c) -> F.Column:
    return F.concat(F.lit(prefix), c.cast(S_))


#: Lines of documents, numbered from 0.
LINES = r"l AS (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS l FROM documents), r AS (SELECT CAST(doc_id AS VARCHAR) AS diff_id, len(l) AS total, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS i FROM l)"


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.split(F.regexp_replace("text", "\n\\z", ""), "\n")
    return docs(spark, sf_dir).select(F.col("doc_id").cast(S_).alias("diff_id"), F.posexplode(rows).alias("i", "text"))


@query(
    "line_numbers",
    f"""WITH {LINES} SELECT diff_id, CAST(i + 1 AS INT) AS pos, CASE WHEN i = 0 THEN ' ' WHEN i % 2 = 0 THEN '-' ELSE '+' END AS kind, CAST(CASE WHEN i % 2 = 0 THEN 10 + i // 2 END AS INT) AS old_line, CAST(CASE WHEN i = 0 THEN 20 WHEN i % 2 = 1 THEN 20 + (i + 1) // 2 END AS INT) AS new_line FROM r""",
)
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    kind = F.when(i == 0, " ").when(i % 2 == 0, "-").otherwise("+")
    rows = doc_lines(spark, sf_dir).select("diff_id", F.lit(0).alias("file"), F.lit(1).alias("hunk"), F.lit(10).alias("old_start"), F.lit(20).alias("new_start"), (i + 1).alias("pos"), kind.alias("kind"))
    return D.line_numbers(rows).select("diff_id", "pos", "kind", "old_line", "new_line")


@query(
    "folded_deletions",
    f"""WITH {LINES}, k AS (SELECT *, i % 7 AS j, least(5, total - i // 7 * 7) AS n FROM r) SELECT diff_id, CAST(i AS INT) AS pos, CASE WHEN j < 5 THEN '-' ELSE '+' END AS kind, CASE WHEN j = 1 AND n > 3 THEN '... ' || (n - 2) || ' lines removed' ELSE text END AS text FROM k WHERE j >= 5 OR n <= 3 OR j <= 1 OR j = n - 1""",
)
def folded_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    rows = doc_lines(spark, sf_dir).select("diff_id", F.lit(0).alias("file"), F.lit(1).alias("hunk"), i.alias("pos"), F.when(i % 7 < 5, "-").otherwise("+").alias("kind"), "text")
    return D.fold_deletions(rows).select("diff_id", "pos", "kind", "text")


@query(
    "names_at_risk",
    """WITH a AS (SELECT source AS diff_id, doc_id, unnest(['alpha' || doc_id % 300, '/api/v' || doc_id % 90, 'pkg.mod.f' || doc_id % 70]) AS gone, unnest([0, 1, 2]) AS place, unnest(['alpha' || doc_id % 17, '/api/v' || doc_id % 11, 'pkg.mod.f' || doc_id % 13]) AS kept FROM documents),
    g AS (SELECT diff_id, gone AS name, count(*) AS n, min(doc_id * 10 + place) AS first FROM a WHERE (diff_id, gone) NOT IN (SELECT diff_id, kept FROM a) GROUP BY ALL)
    SELECT diff_id, name, n, CAST(row_number() OVER (PARTITION BY diff_id ORDER BY first) AS INT) AS ordinal FROM g""",
)
def names_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    text = lambda a, b, c: F.concat(numbered("def alpha", i % a), numbered("('/api/v", i % b), numbered("', 'pkg.mod.f", i % c), F.lit("')")).alias("text")
    pair = F.array(F.struct(F.lit("-").alias("kind"), text(300, 90, 70)), F.struct(F.lit("+").alias("kind"), text(17, 11, 13)))
    lines = docs(spark, sf_dir).select(F.col("source").alias("diff_id"), F.lit(0).alias("file"), i.alias("hunk"), F.posexplode(pair).alias("pos", "x")).select("diff_id", "file", "hunk", "pos", "x.*")
    return D.names_at_risk(lines)


@query(
    "sibling_files",
    """WITH a AS (SELECT source AS diff_id, 'src/name' || doc_id % 40 || '.py' AS own, CASE WHEN doc_id % 2 = 0 THEN 'x = rename' || n_chars % 60 || '.run(1)' ELSE 'import deep.b' || n_chars % 60 || '.part' END AS text FROM documents),
    f AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'src/name' || p_partkey || '.py' ELSE 'deep/b' || p_partkey || '/part' || '.x.py' END AS path FROM part),
    p AS (SELECT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, replace(regexp_replace(path, '\\.[^.]*$', ''), '/', '.') AS module FROM f),
    t AS (SELECT DISTINCT diff_id, text FROM a)
    SELECT DISTINCT diff_id, path AS sibling FROM t JOIN p ON contains(text, stem) OR contains(text, module) WHERE (diff_id, path) NOT IN (SELECT diff_id, own FROM a)""",
)
def sibling_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems within longer words and dotted modules count."""
    i, n = F.col("doc_id"), F.col("n_chars") % 60
    text = F.when(i % 2 == 0, F.concat(numbered("x = rename", n), F.lit(".run(1)"))).otherwise(F.concat(numbered("import deep.b", n), F.lit(".part")))
    lines = docs(spark, sf_dir).select(F.col("source").alias("diff_id"), F.concat(numbered("src/name", i % 40), F.lit(".py")).alias("path"), text.alias("text"))
    k = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(F.when(k % 2 == 0, F.concat(numbered("src/name", k), F.lit(".py"))).otherwise(F.concat(numbered("deep/b", k), F.lit("/part.x.py"))).alias("path"))
    return D.siblings(lines, files)


@query(
    "changed_paths",
    "SELECT source AS diff_id, 'p' || doc_id AS path FROM documents UNION SELECT source, 'q' || doc_id % 100 FROM documents WHERE doc_id % 3 = 0",
)
def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return R.changed_paths(docs(spark, sf_dir).select(F.col("source").alias("diff_id"), numbered("p", i).alias("path"), F.when(i % 3 == 0, numbered("q", i % 100)).alias("old_path")))


@query("diff_digest", "SELECT source AS diff_id, 'p' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'A' ELSE 'M' END || ' p' || doc_id || ' (+' || n_chars % 90 || ' -' || doc_id % 7 || ')' AS line FROM documents")
def diff_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return R.digest_lines(docs(spark, sf_dir).select(F.col("source").alias("diff_id"), numbered("p", i).alias("path"), F.when(i % 3 == 0, "A").otherwise("M").alias("status"), (F.col("n_chars") % 90).alias("added"), (i % 7).alias("removed")))


@query("files_to_review", "SELECT DISTINCT source AS diff_id, 'p' || doc_id AS path FROM documents WHERE (doc_id % 4 <> 0 AND doc_id % 3 <> 0) OR (doc_id % 2 = 0 AND n_chars <= 524288 AND n_chars > 0)")
def files_to_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select(F.col("source").alias("diff_id"), numbered("p", F.col("doc_id")).alias("path"), "doc_id", "n_chars")
    posted = d.select("diff_id", "path", (F.col("doc_id") % 4 == 0).alias("binary"), F.when(F.col("doc_id") % 3 != 0, 1).alias("hunk"))
    chosen = d.filter("doc_id % 2 = 0").withColumn("reason", W.skip_reason(F.col("path"), F.col("n_chars")))
    return R.resolve_diff(posted, chosen)


RULES = [(1, "*.html", "site"), (2, "/en/", "site"), (3, "!en/7*.html", "own"), (4, "fr/**/9*", "own"), (5, "es/?1??", "own")]


@query(
    "selected_files",
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[#?].*$', '') AS path, length(html) AS size FROM pages), q AS (SELECT path, max(size) AS size FROM p GROUP BY path),
    k AS (SELECT *, CASE WHEN regexp_matches(path, '^es/[^/]1[^/][^/](/.*)?$') THEN 'own' WHEN regexp_matches(path, '^fr/(.*/)?9[^/]*(/.*)?$') THEN 'own' WHEN regexp_matches(path, '^en/7[^/]*\.html(/.*)?$') THEN NULL WHEN path LIKE 'en/%' THEN 'site' WHEN regexp_matches(path, '\.html(/.*)?$') THEN 'site' END AS r FROM q)
    SELECT path, CASE WHEN r IS NOT NULL THEN 'ignored by rule ''' || r || '''' WHEN size > 524288 THEN 'larger than 512 KB' WHEN size = 0 THEN 'empty file' END AS reason FROM k UNION ALL SELECT 'not/there', 'not present at this revision'""",
)
def selected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/", ""), "[#?].*$", "")
    files = table(spark, sf_dir, "pages").select(path.alias("path"), F.length("html").alias("size")).groupBy("path").agg(F.max("size").alias("size"))
    wanted = files.select("path").unionByName(spark.createDataFrame([("not/there",)], "path string"))
    return W.select_files(files, spark.createDataFrame(RULES, "ordinal int, pattern string, source string"), wanted).select("path", "reason")


@query(
    "planned_units",
    """WITH p AS (SELECT source || '-' || doc_id % 9 AS review_id, 'p' || doc_id AS path, doc_id FROM documents), n AS (SELECT review_id, count(*) AS n FROM p GROUP BY ALL),
    q AS (SELECT review_id, CAST(doc_id % 8 AS INT) AS ordinal, path FROM p JOIN n USING (review_id) WHERE n > 2 AND doc_id % 4 <> 0), u AS (SELECT review_id, 'unit-' || (ordinal + 1) AS unit, path FROM q WHERE ordinal < 6)
    SELECT review_id, 'unit-1' AS unit, path FROM p JOIN n USING (review_id) WHERE n <= 2 UNION ALL SELECT * FROM u UNION ALL SELECT review_id, 'remaining files', path FROM p JOIN n USING (review_id) WHERE n > 2 AND (review_id, path) NOT IN (SELECT review_id, path FROM u)""",
)
def planned_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    p = docs(spark, sf_dir).select(F.concat("source", F.lit("-"), (i % 9).cast(S_)).alias("review_id"), numbered("p", i).alias("path"), i)
    asked = p.filter("doc_id % 4 <> 0").select("review_id", (i % 8).cast("int").alias("ordinal"), "path")
    unknown = p.select("review_id", F.lit(0).alias("ordinal"), F.lit("no such file").alias("path"))
    return P.plan_units(p.select("review_id", "path"), asked.unionByName(unknown))


@query(
    "unit_context",
    """WITH a AS (SELECT source || '-' || doc_id // 40 AS unit, doc_id AS place, ['diff', 'sibling', 'xref', 'call', 'similar'][doc_id % 5 + 1] AS kind, CAST(doc_id % 5 AS INT) AS step, length(text) // 4 AS tokens FROM documents),
    f AS (SELECT *, coalesce(sum(tokens) FILTER (step IN (0, 2)) OVER (PARTITION BY unit), 0) AS fixed FROM a),
    u AS (SELECT *, fixed + coalesce(sum(tokens) OVER (PARTITION BY unit ORDER BY step, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + tokens AS used FROM f WHERE step NOT IN (0, 2))
    SELECT unit, kind, place, 'n' || place AS name, tokens, true AS kept FROM f WHERE step IN (0, 2) UNION ALL SELECT unit, kind, place, 'n' || place, tokens, used <= 4000 AND (step < 4 OR 4000 - used + tokens > 500) FROM u""",
)
def unit_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in ("diff", "sibling", "xref", "call", "similar")])
    parts = docs(spark, sf_dir).select(F.concat("source", F.lit("-"), F.expr("doc_id div 40").cast(S_)).alias("unit"), F.element_at(kinds, (i % 5 + 1).cast("int")).alias("kind"), i.alias("place"), numbered("n", i).alias("name"), "text")
    return R.build_context(parts, R.LEAST_BUDGET)


@query(
    "applicable_rules",
    """WITH f AS (SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a/' WHEN 2 THEN 'a/b' || doc_id % 3 || '/' ELSE 'c/' END || 'RULES.md' AS file FROM documents), p AS (SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN 'a/b' || doc_id % 5 || '/x' WHEN 1 THEN 'y' ELSE 'ab/z' END || doc_id || '.py' AS path FROM documents)
    SELECT path, file FROM p JOIN f ON starts_with(path, substr(file, 1, length(file) - 8))""",
)
def applicable_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    folder = F.when(i % 4 == 0, "").when(i % 4 == 1, "a/").when(i % 4 == 2, F.concat(F.lit("a/b"), (i % 3).cast(S_), F.lit("/"))).otherwise("c/")
    path = F.concat(F.when(i % 3 == 0, F.concat(F.lit("a/b"), (i % 5).cast(S_), F.lit("/x"))).when(i % 3 == 1, "y").otherwise("ab/z"), i.cast(S_), F.lit(".py"))
    d = docs(spark, sf_dir)
    return R.applicable(d.select(F.concat(folder, F.lit("RULES.md")).alias("file")).distinct(), d.select(path.alias("path")).distinct())


@query(
    "instruction_sections",
    """WITH f AS (SELECT doc_id // 30 AS review_id, CASE doc_id % 6 WHEN 0 THEN 'AGENTS.md' WHEN 1 THEN 'docs/style-guide.md' WHEN 2 THEN 'a/b/our_conventions.txt' WHEN 3 THEN 'vendor/claude.md' WHEN 4 THEN 'notes.md' ELSE 'code.py' END AS name, doc_id, text FROM documents),
    s AS (SELECT review_id, doc_id || '/' || name AS path, text, CASE name WHEN 'AGENTS.md' THEN 17 WHEN 'docs/style-guide.md' THEN 14 WHEN 'a/b/our_conventions.txt' THEN 9 ELSE 0 END AS score FROM f),
    k AS (SELECT review_id, path, score, least(length(text), 24000) AS n, 6000 - coalesce(sum(least(length(text), 24000)) OVER (PARTITION BY review_id ORDER BY -score, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM s WHERE score > 0)
    SELECT review_id, path, CAST(least(n, room) AS INT) AS n_kept FROM k WHERE n <= room OR room >= 400""",
)
def instruction_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.when(i % 6 == 0, "AGENTS.md").when(i % 6 == 1, "docs/style-guide.md").when(i % 6 == 2, "a/b/our_conventions.txt").when(i % 6 == 3, "vendor/claude.md").when(i % 6 == 4, "notes.md").otherwise("code.py")
    files = docs(spark, sf_dir).select(F.expr("doc_id div 30").alias("review_id"), F.concat(i.cast(S_), F.lit("/"), name).alias("path"), "text")
    return R.instruction_sections(files, 6000).select("review_id", "path", F.length("text").alias("n_kept"))


@query(
    "unit_risks",
    """WITH n AS (SELECT source AS unit, 'src/' || lang || '/f' || doc_id AS path, CASE doc_id % 5 WHEN 0 THEN 'Billing.run' WHEN 1 THEN 'login_' || doc_id WHEN 2 THEN 'purge' WHEN 3 THEN 'oracle' ELSE 'Mutex' END AS q FROM documents),
    a AS (SELECT unit, 0 AS step, path, path AS name FROM n UNION SELECT unit, 1, path, q FROM n), t AS (SELECT unnest(['auth', 'session', 'crypto', 'payments', 'data_loss', 'concurrency']) AS tag, unnest(['auth|login|signin', 'session|cookie|jwt', 'crypt|cipher|hmac', 'payment|charge|refund|invoice|billing', 'truncate|purge|wipe', 'thread|mutex|semaphore']) AS p)
    SELECT unit, tag, arg_min(name, (step, path, name)) AS evidence FROM a JOIN t ON regexp_matches(name, '(?i)' || p) GROUP BY ALL UNION ALL SELECT source, 'blast_radius', count(*) || ' symbols depend on this change' FROM documents GROUP BY source HAVING count(*) >= 8""",
)
def unit_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    q = F.when(i % 5 == 0, "Billing.run").when(i % 5 == 1, numbered("login_", i)).when(i % 5 == 2, "purge").when(i % 5 == 3, "oracle").otherwise("Mutex")
    d = docs(spark, sf_dir).select(F.col("source").alias("unit"), F.concat(F.lit("src/"), "lang", F.lit("/f"), i.cast(S_)).alias("path"), q.alias("qualified_name"))
    names = R.own_names(d.select("unit", "path"), d.select("path", "qualified_name"))
    return R.unit_risks(names, d.groupBy("unit").agg(F.count(F.lit(1)).alias("reached")))


@query(
    "loose_answers",
    """WITH c AS (SELECT conv_id * 1000 + turn AS k, (conv_id + turn) % 4 AS v FROM conversations) SELECT k, CAST(o AS INT) AS ordinal, CAST(CASE o WHEN 0 THEN k % 7 ELSE 2 END AS INT) AS a FROM c, (SELECT unnest([0, 1]) AS o) WHERE v < 3""",
)
def loose_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), ((F.col("conv_id") + F.col("turn")) % 4).alias("v"))
    good = F.concat(F.lit('[{"a": '), (F.col("k") % 7).cast(S_), F.lit('}, {"a": 2}]'))
    quoted = F.concat(F.lit('"'), F.replace(good, F.lit('"'), F.lit('\\"')), F.lit('"'))
    t = F.when(F.col("v") == 0, good).when(F.col("v") == 1, quoted).when(F.col("v") == 2, F.concat(good, F.lit(" and so on"))).otherwise("no list")
    return P.split_lists(c.select("k", t.alias("t")), "k", "t", "struct<a: int>").select("k", "ordinal", "entry.a")


@query(
    "coerced_answers",
    """WITH a AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'p1' WHEN 1 THEN ' P4 ' WHEN 2 THEN 'urgent' WHEN 3 THEN NULL ELSE 'P0' END AS s, CASE o_orderkey % 6 WHEN 0 THEN '0.25' WHEN 1 THEN '7' WHEN 2 THEN '-1' WHEN 3 THEN 'NaN' WHEN 4 THEN NULL ELSE 'high' END AS c FROM orders)
    SELECT k, CASE s WHEN 'p1' THEN 'P1' WHEN 'P0' THEN 'P0' ELSE 'P3' END AS severity, CASE c WHEN '0.25' THEN 0.25::DOUBLE WHEN '7' THEN 1.0::DOUBLE WHEN 'NaN' THEN 1.0::DOUBLE WHEN '-1' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM a WHERE k % 7 NOT IN (0, 3)""",
)
def coerced_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = F.when(k % 5 == 0, "p1").when(k % 5 == 1, " P4 ").when(k % 5 == 2, "urgent").when(k % 5 == 4, "P0")
    c = F.when(k % 6 == 0, "0.25").when(k % 6 == 1, "7").when(k % 6 == 2, "-1").when(k % 6 == 3, "NaN").when(k % 6 == 5, "high")
    a = table(spark, sf_dir, "orders").select(k.alias("k"), s.alias("s"), c.alias("c"), F.when(k % 7 != 0, "t").otherwise(" ").alias("title"), F.when(k % 7 != 3, "b").alias("body"))
    return P.usable(a).select("k", P.coerced_severity(F.col("s")).alias("severity"), P.coerced_confidence(F.col("c")).alias("confidence"))


@query(
    "answers_by_digest",
    """SELECT d.doc_id, sha256(d.text) AS request_hash, a.answer, a.answer IS NULL AS degraded FROM documents d LEFT JOIN (SELECT sha256(text) AS h, min(doc_id) AS answer FROM documents WHERE doc_id % 3 > 0 GROUP BY text) a ON sha256(d.text) = a.h""",
)
def answers_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    answers = d.filter("doc_id % 3 > 0").groupBy(F.sha2("text", 256).alias("request_hash")).agg(F.min("doc_id").alias("answer"))
    return P.answer_join(d.select("doc_id", F.col("text").alias("request")), answers).drop("request")


@query(
    "tool_results",
    """WITH b AS (SELECT conv_id AS call_id, turn AS ordinal, (conv_id + turn) % 3 AS k, text FROM conversations), u AS (SELECT call_id, arg_max(CASE ordinal % 3 WHEN 2 THEN '{}' ELSE '{"n":' || ordinal || '}' END, ordinal) AS arguments FROM b WHERE k = 0 GROUP BY call_id)
    SELECT call_id, coalesce(string_agg(text, '' ORDER BY ordinal) FILTER (k = 1), '') AS said, coalesce(any_value(arguments), '{}') AS arguments FROM b LEFT JOIN u USING (call_id) GROUP BY call_id""",
)
def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 3
    t = F.col("turn")
    plain = F.concat(F.lit('{"n":'), t.cast(S_), F.lit("}"))
    quoted = F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('\\"')), F.lit('"'))
    given = F.when(t % 3 == 0, plain).when(t % 3 == 1, quoted).otherwise("[1, 2]")
    c = table(spark, sf_dir, "conversations")
    kind = F.when(k == 0, "tool_use").when(k == 1, "text").otherwise("thinking")
    return R.tool_result(c.select(F.col("conv_id").alias("call_id"), t.alias("ordinal"), kind.alias("type"), given.alias("input"), "text"))


@query(
    "thread_findings",
    """WITH f AS (SELECT doc_id, substr(sha256(CAST(doc_id % 50 AS VARCHAR)), 1, 32) AS fp, doc_id % 9 AS n FROM documents), h AS (SELECT n, doc_id AS head, fp FROM f WHERE doc_id % 3 = 0), g AS (SELECT n, fp, min(doc_id) AS finding_id FROM f WHERE doc_id % 2 = 0 GROUP BY ALL)
    SELECT f.n AS number, f.doc_id AS comment_id, g.finding_id FROM f JOIN h ON h.n = f.n AND h.head = CASE WHEN f.doc_id % 3 = 0 THEN f.doc_id ELSE f.doc_id - 9 END JOIN g ON g.n = h.n AND g.fp = h.fp""",
)
def thread_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    fp = F.substring(F.sha2((i % 50).cast(S_), 256), 1, 32)
    body = F.when(i % 3 == 0, F.concat(F.lit("text <!-- bot:"), fp, F.lit(" -->"))).otherwise(F.lit("a reply"))
    d = docs(spark, sf_dir)
    comments = d.select((i % 9).alias("number"), i.alias("comment_id"), F.when(i % 3 != 0, i - 9).alias("in_reply_to"), body.alias("body"))
    found = d.filter("doc_id % 2 = 0").select(fp.alias("fingerprint"), numbered("pr-", i % 9).alias("review_id"), i.alias("finding_id"))
    found = found.groupBy("fingerprint", "review_id").agg(F.min("finding_id").alias("finding_id"))
    return R.thread_finding(comments, found, "bot")


@query("marked_comments", "WITH c AS (SELECT doc_id, substr(sha256(CAST(doc_id % 70 AS VARCHAR)), 1, 32) AS fingerprint, doc_id % 5 = 0 AS done FROM documents WHERE doc_id % 4 > 0) SELECT fingerprint, max(doc_id) AS comment_id, bool_or(done) AS resolved FROM c GROUP BY fingerprint")
def marked_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    mark = F.concat(F.lit("x <!-- bot:"), F.substring(F.sha2((i % 70).cast(S_), 256), 1, 32), F.when(i % 5 == 0, ":resolved").otherwise(""), F.lit(" -->"))
    return T.markers(docs(spark, sf_dir).select(i.alias("comment_id"), F.when(i % 4 > 0, mark).otherwise("none").alias("body")), "bot")


@query(
    "posting_plan",
    """WITH f AS (SELECT DISTINCT 'x' || doc_id % 300 AS fp FROM documents WHERE doc_id % 2 = 0), p AS (SELECT 'x' || doc_id % 350 AS fp, bool_or(doc_id % 11 = 0) AS resolved FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL), w AS (SELECT 'x' || doc_id % 350 AS fp FROM documents WHERE doc_id % 21 = 0)
    SELECT fp AS fingerprint, 'post' AS action FROM f WHERE fp NOT IN (SELECT fp FROM p) UNION ALL SELECT fp, CASE WHEN fp IN (SELECT fp FROM w) THEN 'withdrawn' ELSE 'fixed' END FROM p WHERE NOT resolved AND fp NOT IN (SELECT fp FROM f)""",
)
def posting_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = docs(spark, sf_dir)
    posted = d.filter("doc_id % 3 = 0").groupBy(numbered("x", i % 350).alias("fingerprint")).agg(F.bool_or(i % 11 == 0).alias("resolved"))
    return T.posting_plan(d.filter("doc_id % 2 = 0").select(numbered("x", i % 300).alias("fingerprint")).distinct(), posted, d.filter("doc_id % 21 = 0").select(numbered("x", i % 350).alias("fingerprint")))


@query(
    "comment_anchors",
    """WITH l AS (SELECT DISTINCT p_brand AS path, p_size * 10 AS line FROM part), a AS (SELECT o_orderkey AS finding_id, 0 AS o, 'Brand#' || o_custkey % 70 AS path, o_orderkey % 500 AS w FROM orders UNION ALL SELECT o_orderkey, 1, 'Brand#' || (o_custkey + 9) % 70, o_orderkey % 300 FROM orders),
    b AS (SELECT finding_id, arg_min(struct_pack(p := path, n := line), (o, abs(line - w), line)) AS b FROM a JOIN l USING (path) GROUP BY finding_id) SELECT o_orderkey AS finding_id, b.b.p AS path, b.b.n AS line FROM orders LEFT JOIN b ON o_orderkey = finding_id""",
)
def comment_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    place = lambda file, line: F.struct(numbered("Brand#", file).alias("file"), line.cast("int").alias("line"))
    found = table(spark, sf_dir, "orders").select(k.alias("finding_id"), F.array(place(c % 70, k % 500), place((c + 9) % 70, k % 300)).alias("locations"))
    return T.anchors(found, table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), (F.col("p_size") * 10).alias("new_line")))


@query(
    "review_reports",
    """WITH f AS (SELECT o_orderkey AS k, o_custkey AS review_id, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS level FROM orders), t AS (SELECT *, '- **P' || level || '** t' || k || ' (f' || k % 9 || CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN ':' || k % 50 ELSE ':' || k % 50 || '-' || (k % 50 + 4) END || ')' AS t FROM f)
    SELECT review_id, '# Review' || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY level, k) AS markdown FROM t GROUP BY review_id""",
)
def review_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("finding_id")
    df = findings(spark, sf_dir).select("review_id", k, "level", "severity", numbered("t", k).alias("title"), numbered("f", k % 9).alias("file"), F.when(k % 3 > 0, k % 50).alias("line_start"), F.when(k % 3 == 1, k % 50).when(k % 3 == 2, k % 50 + 4).alias("line_end"))
    return T.report(df)


@query("suggestions_that_fit", "SELECT doc_id, len(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))) = doc_id % 12 + 1 AS fits FROM documents")
def suggestions_that_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.suggestion_fits(F.col("text"), F.lit(5), 5 + F.col("doc_id") % 12).alias("fits"))


@query(
    "similar_chunks",
    """WITH v AS (SELECT vec_id AS key, CAST(label AS VARCHAR) AS category, embedding AS vector FROM embeddings), q AS (SELECT * FROM v WHERE key % 20 = 0), n AS (SELECT q.key, q.category, v.key AS neighbour, v.category AS nc, list_sum(list_transform(list_zip(q.vector, v.vector), lambda x: CAST((x[1] - x[2]) * (x[1] - x[2]) AS DOUBLE))) AS d2 FROM q JOIN v ON q.key <> v.key),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d2, neighbour) AS rank FROM n), h AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank) AS k FROM r WHERE rank <= 15 AND nc <> category AND neighbour % 7 > 0) SELECT key AS unit, neighbour AS chunk_id, CAST(rank AS INT) AS rank FROM h WHERE k <= 10""",
)
def similar_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    near = M.knn(v.filter("key % 20 = 0"), v, 15).select(F.col("key").alias("unit"), F.col("neighbour").alias("chunk_id"), "rank")
    chunks = v.filter("key % 7 > 0").select(F.col("key").alias("chunk_id"), F.col("category").alias("path"))
    own = v.select(F.col("key").alias("unit"), F.col("category").alias("path"))
    return I.similar_code(own.select("unit"), near, chunks, own).select("unit", "chunk_id", "rank")


@query("forgotten_files", "SELECT doc_id, 'p' || doc_id % 40 AS path FROM documents WHERE doc_id % 40 >= 10")
def forgotten_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = docs(spark, sf_dir).select(i, numbered("p", i % 40).alias("path"))
    return I.forget({"chunks": rows}, rows.filter("doc_id % 40 < 10").select("path").distinct())["chunks"]


@query(
    "entry_bodies",
    """WITH e AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id AS symbol_id, substr(CASE WHEN doc_id % 3 = 0 THEN 'chunk ' || doc_id ELSE array_to_string(l[doc_id % 4 + 1 : doc_id % 4 + 6], chr(10)) END, 1, 1800) AS body FROM e""",
)
def entry_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = docs(spark, sf_dir)
    entries = d.select(i.alias("symbol_id"), numbered("p", i).alias("path"), (i % 4 + 1).cast("int").alias("start_line"), (i % 4 + 6).cast("int").alias("end_line"))
    chunks = d.filter("doc_id % 3 = 0").select(i.alias("symbol_id"), numbered("chunk ", i).alias("body"))
    return G.bodies(entries, chunks, d.select(numbered("p", i).alias("path"), "text")).select("symbol_id", "body")


@query(
    "suppression_records",
    """WITH f AS (SELECT doc_id AS s, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS by_whom FROM documents) SELECT doc_id AS finding_id, CASE WHEN doc_id % 2 = 0 THEN 'suppressed' ELSE 'downranked' END AS status, doc_id - doc_id % 5 AS suppressor, round((doc_id % 1000) / 1024.0::DOUBLE, 4) AS similarity, by_whom, 'r' || (doc_id - doc_id % 5) AS reason
    FROM documents LEFT JOIN f ON s = doc_id - doc_id % 5""",
)
def suppression_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = docs(spark, sf_dir)
    found = d.select(i.alias("finding_id"), F.when(i % 2 == 0, "suppressed").otherwise("downranked").alias("status"))
    matched = d.select(i.alias("finding_id"), (i - i % 5).alias("suppressor"), ((i % 1000) / F.lit(1024.0)).alias("similarity"))
    out = M.provenance(found, matched, d.select(i.alias("finding_id"), F.when(i % 7 != 0, F.col("lang")).alias("author"), numbered("r", i).alias("reason")))
    return out.withColumn("reason", F.coalesce("reason", numbered("r", F.col("suppressor"))))


@query("remembered_vectors", "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 4 IN (0, 1))")
def remembered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("finding_id"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("finding_id"))
    return M.remembered(d.filter("finding_id % 4 = 0"), d.filter("finding_id % 4 = 1"), v).select(F.col("finding_id").alias("vec_id"))


RULE_ROWS = "r AS (SELECT 'R' || s_suppkey AS rule_id, s_nationkey AS hits, s_acctbal > 0 AS active, s_name AS body FROM supplier)"


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(numbered("R", F.col("s_suppkey")).alias("rule_id"), F.col("s_nationkey").alias("hits"), (F.col("s_acctbal") > 0).alias("active"), F.col("s_name").alias("body"))


@query("rules_signature", f"WITH {RULE_ROWS} SELECT substr(sha256(string_agg(rule_id || ':' || body, '|' ORDER BY hits DESC, rule_id)), 1, 16) AS signature FROM r WHERE active")
def rules_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rules_signature(rules(spark, sf_dir))


@query("conventions_block", f"WITH {RULE_ROWS} SELECT substr(sha256(string_agg(rule_id || ':' || body, '|' ORDER BY hits DESC, rule_id)), 1, 16) AS signature, 'TEAM CONVENTIONS:' || chr(10) || string_agg(rule_id || ': ' || body, chr(10) ORDER BY hits DESC, rule_id) AS block, false AS reused FROM r WHERE active")
def conventions_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.conventions(rules(spark, sf_dir), spark.createDataFrame([("0" * 16, "old words")], "signature string, block string"))


@query("flat_config", "SELECT n_name || '.' || CASE WHEN n_nationkey % 3 = 0 THEN 'api_key' ELSE 'limit' END AS key, CASE WHEN n_nationkey % 3 > 0 THEN CAST(n_regionkey AS VARCHAR) WHEN n_nationkey % 2 = 0 THEN 'set' ELSE 'unset' END AS value, 'file' AS source FROM nation")
def flat_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    value = F.when(k % 3 > 0, F.col("n_regionkey").cast(S_)).when(k % 2 == 0, "s3cr3t").otherwise("")
    return R.flat_config(table(spark, sf_dir, "nation").select(F.col("n_name").alias("section"), F.when(k % 3 == 0, "api_key").otherwise("limit").alias("key"), value.alias("value"), F.lit("file").alias("source")))


@query("second_questions", "SELECT doc_id AS finding_id, 'severity: P' || doc_id % 6 || chr(10) || 'category: ' || lang || chr(10) || 'locations: ' || source || ':' || n_chars % 50 || ', ' || source || ':' || (50 + doc_id % 997) || chr(10) || 'title: t' || doc_id AS question FROM documents")
def second_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = printed(spark, sf_dir).withColumns({"severity": F.concat(F.lit("P"), F.col("level").cast(S_)), "title": numbered("t", F.col("finding_id"))})
    return R.question(df)


@query("finding_json", "SELECT doc_id AS finding_id, '{\"file\":\"' || source || '\",\"level\":' || doc_id % 6 || ',\"patch\":' || CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE '\"p\"' END || '}' AS json FROM documents")
def finding_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.as_json(printed(spark, sf_dir).withColumn("patch", F.when(F.col("finding_id") % 2 == 1, "p")), ["file", "level", "patch"])


@query(
    "answer_locations",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'x' || doc_id || ':1' WHEN 1 THEN source || ':7' ELSE 'x' || doc_id || ':1,y:' || n_chars END AS places FROM documents""",
)
def answer_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    place = lambda file, line: F.struct(file.cast(S_).alias("file"), line.cast("long").alias("line_start"), line.cast("long").alias("line_end"))
    none, one = place(F.lit(""), F.lit(3)), place(numbered("x", i), F.lit(1))
    raw = F.when(i % 3 == 0, F.array(none, one)).when(i % 3 == 2, F.array(one, none, place(F.lit("y"), F.col("n_chars"))))
    got = R.read_locations(raw, F.col("source"), F.lit(7).cast("long"), F.lit(7).cast("long"))
    return docs(spark, sf_dir).select(i, F.array_join(F.transform(got, lambda x: F.concat(x["file"], F.lit(":"), x["line_start"].cast(S_))), ",").alias("places"))


CASES = """d AS (SELECT 'case' || doc_id // 50 AS case_id, lang AS file, doc_id, sha256(text) AS t FROM documents), e AS (SELECT case_id, file, doc_id, CASE WHEN doc_id % 8 = 0 THEN 'zz' ELSE t END AS t, doc_id % 12 = 4 AS anywhere FROM d WHERE doc_id % 4 = 0),
    f AS (SELECT *, 'P' || doc_id % 2 AS severity FROM d),
    m AS (SELECT e.case_id, CASE WHEN e.doc_id % 3 < 2 THEN 'P' || e.doc_id % 3 END AS expected, f.severity FROM (SELECT *, row_number() OVER (PARTITION BY case_id, file, t ORDER BY doc_id) AS r FROM e) e JOIN (SELECT *, row_number() OVER (PARTITION BY case_id, file, t ORDER BY doc_id) AS r FROM f) f USING (case_id, file, t, r)),
    k AS (SELECT case_id, CAST(coalesce(hit, 0) AS BIGINT) AS hit, CAST(coalesce(expected, 0) - coalesce(hit, 0) AS BIGINT) AS missed, CAST(greatest(0, n - coalesce(expected, 0)) AS BIGINT) AS extra, CAST(forbidden_hits AS BIGINT) AS forbidden_hits, CAST(coalesce(severity_errors, 0) AS BIGINT) AS severity_errors,
        coalesce(expected, 0) = coalesce(hit, 0) AND forbidden_hits = 0 AND coalesce(severity_errors, 0) = 0 AS passed
      FROM (SELECT case_id, count(*) AS n, count(*) FILTER (regexp_matches(t, '^[0-4]') AND doc_id % 9 = 7) AS forbidden_hits FROM d GROUP BY case_id) LEFT JOIN (SELECT case_id, count(*) AS expected FROM e GROUP BY case_id) USING (case_id)
        LEFT JOIN (SELECT case_id, count(*) AS hit, count(*) FILTER (expected IS NOT NULL AND expected <> severity) AS severity_errors FROM m GROUP BY case_id) USING (case_id))"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents make a case: findings titled by the digest of their whole text; every fourth is expected, half of these under
    a pattern that nothing fits, two thirds with a severity; digests of one beginning with one body are forbidden in any file."""
    i = F.col("doc_id")
    d = docs(spark, sf_dir).select(numbered("case", F.expr("doc_id div 50")).alias("case_id"), F.col("lang").alias("file"), i, F.sha2("text", 256).alias("t"))
    found = d.select("case_id", "file", i.alias("finding_no"), F.col("t").alias("title"), numbered("body ", i % 9).alias("body"), F.lit("bug").alias("category"), numbered("P", i % 2).alias("severity"))
    pattern = F.concat(F.lit("^"), F.when(i % 8 == 0, "zz").otherwise(F.upper(F.substring("t", 1, 20))))
    none = F.lit(None).cast(S_)
    expect = d.filter("doc_id % 4 = 0").select("case_id", "file", i.alias("no"), pattern.alias("pattern"), none.alias("category"), F.when(i % 3 < 2, numbered("P", i % 3)).alias("severity"))
    forbid = d.select("case_id").distinct().select("case_id", none.alias("file"), F.lit(0).cast("long").alias("no"), F.lit("^[0-4].*\nBODY 7$").alias("pattern"), F.lit("bug").alias("category"), none.alias("severity"))
    return E.eval_scores(d, expect, forbid, found)


@query("eval_cases", f"WITH {CASES} SELECT * FROM k")
def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir)


@query("eval_report", f"WITH {CASES} SELECT CAST(1000 * sum(hit) // (sum(hit) + sum(missed)) AS BIGINT) AS recall, CAST(1000 * sum(extra) // count(*) AS BIGINT) AS noise, CASE WHEN bool_or(missed > 6) THEN 'misses many,slow' ELSE 'slow' END AS degraded FROM k")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = F.array_compact(F.array(F.when(F.col("missed") > 6, F.lit("misses many")), F.lit("slow")))
    return R.eval_report(cases(spark, sf_dir).withColumn("notes", notes)).withColumn("degraded", F.array_join("degraded", ","))


@query("prompt_digest", "SELECT sha256(string_agg(sha256(p_type), '' ORDER BY p_type)) AS digest FROM (SELECT DISTINCT p_type FROM part)")
def prompt_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.prompt_digest(table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.col("p_type").alias("body")).distinct())


@query("call_costs", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN contains(m, 'big') THEN (l_partkey * 300 + l_suppkey * 1500) // 1000000 WHEN contains(m, 'small') THEN (l_partkey * 25 + l_suppkey * 125) // 1000000 ELSE 0 END AS BIGINT) AS cents FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'x/big-1' WHEN 1 THEN 'small' ELSE 'other' END AS m FROM lineitem)")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    model = F.when(n == 0, "x/big-1").when(n == 1, "small").otherwise("other")
    cost = P.cost_cents(model, F.col("l_partkey"), F.col("l_suppkey"), [("big", 300, 1500), ("small", 25, 125)])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cost.alias("cents"))


@query("rising_labels", "SELECT category, action, count(*) AS n FROM (SELECT source AS category, CASE WHEN quality = 1 THEN 'accept' WHEN doc_id % 4 = 0 THEN 'dismiss' WHEN doc_id % 4 = 1 THEN 'style_rule' ELSE 'false_positive' END AS action FROM labels JOIN documents USING (doc_id)) GROUP BY ALL")
def rising_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: feedback by category and action."""
    return feedback(spark, sf_dir).groupBy("category", "action").agg(F.count(F.lit(1)).alias("n"))


@query("findings_in_order", "SELECT o_orderkey AS finding_id, o_custkey AS review_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY substr(o_orderpriority, 1, 1), o_orderkey) AS INT) AS place FROM orders")
def findings_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.in_order(findings(spark, sf_dir)).select("finding_id", "review_id", "place")


def part_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("symbol_id"), F.col("p_brand").alias("path"), (k % 500).cast("int").alias("start_line"), (k % 500 + F.col("p_size")).cast("int").alias("end_line"))


@query("file_outline", "SELECT p_partkey AS symbol_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 500, p_partkey % 500 + p_size DESC, p_partkey) AS INT) AS place FROM part")
def file_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.outline(part_spans(spark, sf_dir)).select("symbol_id", "place")


@query("innermost_first", "SELECT p_partkey AS symbol_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey % 500, p_partkey) AS INT) AS place FROM part WHERE p_partkey % 500 <= 200 AND p_partkey % 500 + p_size >= 100")
def innermost_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = part_spans(spark, sf_dir)
    spans = s.select("path").distinct().withColumns({"lo": F.lit(100), "hi": F.lit(200)})
    return R.innermost_first(G.overlaps(s, spans)).select("symbol_id", "place")


@query("attention_points", "SELECT conv_id AS review_id, turn AS ordinal, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 2")
def attention_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("review_id"), F.col("turn").alias("ordinal"), "text")
    return R.attention(c).drop("place")


@query("kept_streams", "SELECT user_id AS stream_id, min(ts) AS started FROM events GROUP BY user_id ORDER BY started DESC, stream_id DESC LIMIT 64")
def kept_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.kept_streams(table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("stream_id")).agg(F.min("ts").alias("started")))


@query("review_spend", "SELECT o_orderkey AS review_id, coalesce(CAST(sum(l_partkey) AS BIGINT), 0) AS cost_cents, coalesce(CAST(sum(l_suppkey) AS BIGINT), 0) AS tokens_in, CAST(count(l_orderkey) AS BIGINT) AS tokens_out, coalesce(CAST(sum(l_linenumber) AS BIGINT), 0) AS tokens_cached FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def review_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("review_id"), F.col("l_partkey").alias("cost_cents"), F.col("l_suppkey").alias("tokens_in"), F.lit(1).alias("tokens_out"), F.col("l_linenumber").alias("tokens_cached"))
    return R.with_spend(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id")), c)


@query("embedding_usage", "SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN doc_id % 3 * n_chars WHEN doc_id % 3 = 2 THEN 2 * n_chars WHEN doc_id % 2 = 0 THEN n_chars ELSE 0 END AS tokens_in FROM documents")
def embedding_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return R.embedding_usage(docs(spark, sf_dir).select(i, (i % 3 * F.col("n_chars")).alias("prompt_tokens"), F.when(i % 2 == 0, F.col("n_chars")).alias("total_tokens"))).select("doc_id", "tokens_in")


@query("redacted_calls", "SELECT doc_id, substr('Authorization: Bearer *** ' || text, 1, 200) AS request, 'api_key: \"***\"' AS response FROM documents")
def redacted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2("text", 256)
    c = docs(spark, sf_dir).select("doc_id", F.concat(F.lit("Authorization: Bearer "), sha, F.lit(" "), "text").alias("request"), F.concat(F.lit('api_key: "'), sha, F.lit('"')).alias("response"))
    return R.redacted(c, 200, 400)


@query("state_by_prefix", "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS value FROM orders WHERE o_custkey % 2 = 0")
def state_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return R.state_of(o.select(F.concat(F.when(F.col("o_custkey") % 2 == 0, "pr:").otherwise("etag:"), F.col("o_orderkey").cast(S_)).alias("key"), F.col("o_orderstatus").alias("value")), "pr:")


@query("reaction_feedback", "SELECT 'x' || user_id % 40 AS fingerprint, CASE WHEN event_id % 3 = 0 THEN 'accept' ELSE 'false_positive' END AS action, CAST((event_id % 4 + 1) * 3 AS BIGINT) AS weight10, 'reaction' AS reason FROM events WHERE event_id % 3 < 2 AND user_id % 5 > 0")
def reaction_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    deltas = e.select(F.col("user_id").alias("comment_id"), F.when(i % 3 == 0, "+1").when(i % 3 == 1, "-1").otherwise("heart").alias("kind"), (i % 4 + 1).alias("delta"))
    placed = e.filter("user_id % 5 > 0").select(F.col("user_id").alias("comment_id"), numbered("x", F.col("user_id") % 40).alias("fingerprint")).distinct()
    return R.reaction_feedback(deltas, placed)


@query("rule_table", f"WITH {RULE_ROWS} SELECT rule_id, rule_id || ' | ' || body || ' | ' || CASE WHEN hits % 2 = 0 THEN 'me' ELSE '-' END || ' | ' || hits AS line FROM r WHERE active AND hits % 3 > 0")
def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rules(spark, sf_dir).withColumn("author", F.when(F.col("hits") % 2 == 0, "me"))
    return R.rule_table(R.retired(r, r.filter("hits % 3 = 0").select("rule_id")))


@query("exit_code", "SELECT CAST(max(CASE WHEN substr(o_orderpriority, 1, 1) <= '2' THEN 1 ELSE 0 END) AS INT) AS code FROM orders")
def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.exit_code(findings(spark, sf_dir))


@query("hash_embeddings", "SELECT doc_id, 16 AS width, CASE WHEN regexp_matches(lower(text), '[a-z0-9_]') THEN 1 ELSE 0 END AS words FROM documents")
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of each vector, and whether its text has words; the values follow the engine's own hash."""
    v = docs(spark, sf_dir).select("doc_id", "text", R.hash_embedding(F.col("text")).alias("v"))
    return v.select("doc_id", F.size("v").alias("width"), F.lower("text").rlike("[a-z0-9_]").cast("int").alias("words"))


@query("normalised_vectors", "SELECT vec_id, CAST(1 AS DOUBLE) AS norm FROM embeddings")
def normalised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", R.normalised(F.transform("embedding", lambda x: x * 3)).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


@query("comment_intents", "SELECT conv_id, turn, CASE WHEN min(turn) OVER (PARTITION BY text) % 3 = 0 THEN 'rule' WHEN min(turn) OVER (PARTITION BY text) % 3 = 1 THEN 'explain' ELSE 'other' END AS intent FROM conversations")
def comment_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumnRenamed("text", "body")
    first = c.groupBy(F.sha2("body", 256).alias("request_hash")).agg((F.min("turn") % 3).alias("k"))
    answers = first.select("request_hash", F.when(F.col("k") == 0, "rule").when(F.col("k") == 1, "explain").otherwise("dance").alias("intent"))
    return R.intents(c, answers).select("conv_id", "turn", "intent")


@query("overridden_prompts", "SELECT p_partkey AS name, CASE p_partkey % 3 WHEN 0 THEN 'all new' WHEN 1 THEN 'use {{diff}}' || chr(10) || chr(10) || 'and more' ELSE 'use {{diff}}' END AS body, p_partkey % 3 > 0 AS valid FROM part")
def overridden_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"))
    k = F.col("name") % 3
    shipped = p.select("name", F.lit("use {{diff}}").alias("body"), F.array(F.lit("diff")).alias("slots"))
    return R.prompts(shipped, p.filter(k < 2).select("name", F.when(k == 0, "replace").otherwise("append").alias("mode"), F.when(k == 0, "all new").otherwise("and more").alias("body")))


@query("context_labels", "SELECT doc_id, 'diff' || CASE WHEN doc_id % 2 = 0 THEN '+call graph' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '+retrieved code' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN '+truncated' ELSE '' END AS label FROM documents")
def context_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return R.context_label(docs(spark, sf_dir).select(i, (i % 2 == 0).alias("has_calls"), (i % 3 == 0).alias("has_similar"), (i % 5 == 0).alias("was_cut"))).select("doc_id", "label")


#: Two snapshots of the documents: some are only in one, some have a line more, some change their name, with and without a line more;
#: those that are gone, new or moved have lines of their own, so that no copy of another document can be taken for them.
SNAPSHOTS = """t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0 THEN array_to_string(list_transform(range(0, n_chars % 20 + 6), lambda i: 'line ' || i || ' of ' || doc_id), chr(10)) ELSE text || chr(10) || 'document ' || doc_id END AS text FROM documents),
    b AS (SELECT doc_id, 'p' || doc_id AS path, text FROM t WHERE doc_id % 5 > 0),
    h AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND n > 1000 THEN 'new/p' ELSE 'p' END || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN t.text || chr(10) || 'one more' ELSE t.text END AS text FROM t JOIN (SELECT doc_id, length(text) AS n FROM documents) USING (doc_id) WHERE doc_id % 4 > 0),"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("doc_id")
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_chars") % 20 + 5), lambda k: F.concat(F.lit("line "), k.cast(S_), F.lit(" of "), i.cast(S_))), "\n")
    text = F.when((i % 4 == 0) | (i % 5 == 0) | (i % 7 == 0), own).otherwise(F.concat("text", F.lit("\ndocument "), i.cast(S_)))
    d = docs(spark, sf_dir).select(i, F.length("text").alias("n"), text.alias("text"))
    path = F.when((i % 7 == 0) & (F.col("n") > 1000), numbered("new/p", i)).otherwise(numbered("p", i))
    head = d.filter("doc_id % 4 > 0").select(path.alias("path"), F.when(i % 3 == 0, F.concat("text", F.lit("\none more"))).otherwise(F.col("text")).alias("text"))
    return d.filter("doc_id % 5 > 0").select(numbered("p", i).alias("path"), "text"), head


@query(
    "snapshot_diff",
    f"""WITH {SNAPSHOTS} j AS (SELECT b.path AS old, h.path AS new, b.text AS x, h.text AS y, len(string_split(coalesce(b.text, h.text), chr(10))) AS n, coalesce(b.doc_id, h.doc_id) % 3 = 0 AS more FROM b FULL JOIN h USING (doc_id))
    SELECT coalesce(new, old) AS path, CASE WHEN old <> new THEN old END AS old_path, CASE WHEN old IS NULL THEN 'A' WHEN new IS NULL THEN 'D' WHEN old <> new THEN 'R' ELSE 'M' END AS status,
      CAST(CASE WHEN old IS NULL THEN len(string_split(y, chr(10))) WHEN new IS NULL THEN 0 WHEN more THEN 2 ELSE 0 END AS BIGINT) AS added, CAST(CASE WHEN old IS NULL THEN 0 WHEN new IS NULL THEN n WHEN more THEN 1 ELSE 0 END AS BIGINT) AS removed
    FROM j WHERE x IS DISTINCT FROM y OR old <> new""",
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A last line without an end changes when another follows, as diffs have it."""
    return N.snapshot_diff(*snapshots(spark, sf_dir)).drop("text")


@query(
    "snapshot_hunks",
    f"""WITH {SNAPSHOTS} j AS (SELECT b.path AS old, h.path AS new, string_split(b.text, chr(10)) AS x, string_split(h.text, chr(10)) AS y, coalesce(b.doc_id, h.doc_id) % 3 = 0 AS more FROM b FULL JOIN h USING (doc_id)),
    k AS (SELECT coalesce(new, old) AS path, old, new, CASE WHEN old IS NULL THEN [] WHEN new IS NULL THEN x ELSE x[len(x):] END AS gone, CASE WHEN new IS NULL THEN [] WHEN old IS NULL THEN y ELSE y[len(x):] END AS come, CASE WHEN old IS NULL OR new IS NULL THEN [] ELSE x[greatest(1, len(x) - 3):len(x) - 1] END AS same FROM j WHERE old IS NULL OR new IS NULL OR more)
    SELECT path, '-' AS kind, unnest(gone) AS text, CAST(CASE WHEN new IS NULL THEN 0 ELSE 1 END AS INT) AS both FROM k UNION ALL SELECT path, '+', unnest(come), CAST(CASE WHEN old IS NULL THEN 0 ELSE 1 END AS INT) FROM k UNION ALL SELECT path, ' ', unnest(same), CAST(1 AS INT) FROM k""",
)
def snapshot_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed lines of the snapshots' diffs: those of whole files, and those of hunks with their context."""
    lines = D.parse_diffs(N.snapshot_diff(*snapshots(spark, sf_dir)).select(F.col("path").alias("diff_id"), "text")).filter("kind IS NOT NULL")
    return lines.select("path", "kind", "text", F.when(F.col("status").isin("A", "D"), 0).otherwise(1).alias("both"))


@query(
    "merge_bases",
    """WITH RECURSIVE c AS (SELECT o_orderkey AS c, CASE WHEN o_orderkey > 8 THEN o_orderkey // 3 END AS p FROM orders UNION SELECT o_orderkey, o_orderkey // 2 - 1 FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey > 8),
    q AS (SELECT o_custkey AS pair_id, min(o_orderkey) AS base, max(o_orderkey) AS head FROM orders WHERE o_custkey % 20 = 0 GROUP BY o_custkey),
    a AS (SELECT * FROM (SELECT pair_id, 0 AS side, base AS node FROM q UNION SELECT pair_id, 1, head FROM q) UNION SELECT pair_id, side, p FROM a JOIN c ON node = c.c WHERE p IS NOT NULL),
    s AS (SELECT pair_id, node FROM a GROUP BY ALL HAVING count(*) = 2), m AS (SELECT pair_id, max(node) AS merge_base FROM s WHERE (pair_id, node) NOT IN (SELECT pair_id, p FROM s JOIN c ON node = c.c WHERE p IS NOT NULL) GROUP BY pair_id)
    SELECT pair_id, base, head, merge_base FROM q LEFT JOIN m USING (pair_id)""",
)
def merge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits with one or two parents, each twentieth customer's first and last as a pair."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    one = o.select(k.alias("commit"), F.when(k > 8, F.expr("o_orderkey div 3")).alias("parent"))
    two = o.filter((k % 4 == 0) & (k > 8)).select(k.alias("commit"), F.expr("o_orderkey div 2 - 1").alias("parent"))
    pairs = o.filter("o_custkey % 20 = 0").groupBy(F.col("o_custkey").alias("pair_id")).agg(F.min(k).alias("base"), F.max(k).alias("head"))
    return N.merge_bases(one.unionByName(two).withColumn("at", F.col("commit")), pairs)


@query(
    "comment_bodies",
    r"""WITH f AS (SELECT o_orderkey AS k, 'P' || (CAST(substr(o_orderpriority, 1, 1) AS INT) - 1) AS s, o_orderkey % 50 AS a, o_orderkey % 4 AS w, o_orderkey % 1000 AS c, o_orderkey % 2 = 0 AS i, rtrim(repeat('word' || o_custkey || ' ', CAST(o_orderkey % 40 + 1 AS INT))) AS body, CASE WHEN o_orderkey % 3 > 0 THEN repeat('  x' || chr(10), CAST(o_orderkey % 3 AS INT)) END AS p FROM orders),
    l AS (SELECT *, list_reduce(string_split(body, ' '), lambda x, y: CASE WHEN length(regexp_extract(x, '[^
]*$')) + 1 + length(y) <= 88 THEN x || ' ' || y ELSE x || chr(10) || y END) AS lines, rtrim(p, chr(10)) AS q, 'src/' || k % 9 || '.py' AS file,
      CASE WHEN a = 0 THEN '' WHEN w = 0 THEN ':' || a ELSE ':' || a || '-' || (a + w) END AS spot, c // 10 + CASE WHEN c % 10 > 5 OR (c % 10 = 5 AND c // 10 % 2 = 1) THEN 1 ELSE 0 END AS percent FROM f)
    SELECT k AS finding_id, CASE WHEN i THEN '' ELSE '`' || file || CASE WHEN a = 0 THEN '' ELSE ':' || a END || '`' || chr(10) END || '**' || s || ' — t' || k || '**' || chr(10) || chr(10) || body
      || CASE WHEN p IS NULL THEN '' ELSE chr(10) || chr(10) || '```' || CASE WHEN i AND a > 0 AND k % 3 = w + 1 THEN 'suggestion' ELSE '' END || chr(10) || q || chr(10) || '```' END
      || CASE WHEN i THEN chr(10) || chr(10) || '<details>' || chr(10) || '<summary>For a coding agent</summary>' || chr(10) || chr(10) || '```' || chr(10) || 'Fix this in the repository. Change nothing else.' || chr(10) || chr(10) || file || spot || chr(10) || '[' || s || ' bug] t' || k || chr(10) || lines
        || CASE WHEN p IS NULL THEN '' ELSE chr(10) || 'suggested replacement:' || chr(10) || q END || chr(10) || '```' || chr(10) || chr(10) || '</details>' ELSE '' END
      || chr(10) || chr(10) || '<sub>bug · confidence ' || percent || '%' || CASE WHEN i THEN ' · reply if this is wrong' ELSE '' END || '</sub>' || chr(10) || '<!-- bot:' || md5('t' || k) || ' -->' AS markdown FROM l""",
)
def comment_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a finding, every second in a thread of its own."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    place = F.struct(F.concat(F.lit("src/"), (k % 9).cast(S_), F.lit(".py")).alias("file"), (k % 50).alias("line_start"), F.when(k % 50 == 0, 0).otherwise(k % 50 + k % 4).alias("line_end"))
    patch = F.when(k % 3 > 0, F.repeat(F.lit("  x\n"), (k % 3).cast("int")))
    level = F.concat(F.lit("P"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast(S_))
    body = F.rtrim(F.repeat(F.concat(F.lit("word"), c.cast(S_), F.lit(" ")), (k % 40 + 1).cast("int")))
    found = table(spark, sf_dir, "orders").select(
        k.alias("finding_id"), F.md5(numbered("t", k).cast("binary")).alias("fingerprint"), level.alias("severity"), F.lit("bug").alias("category"), numbered("t", k).alias("title"), body.alias("body"), patch.alias("patch"),
        (k % 1000).alias("conf"), F.array(place).alias("locations"), (k % 2 == 0).alias("inline"),
    )
    return T.comment_bodies(found, "bot")


@query(
    "comment_ranges",
    """WITH l AS (SELECT DISTINCT p_brand AS path, p_size AS line FROM part), f AS (SELECT o_orderkey AS k, 'Brand#' || o_custkey % 70 AS path, o_orderkey % 60 AS a, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 60 + o_orderkey % 5 END AS b FROM orders),
    n AS (SELECT k, any_value(path) AS path, any_value(a) AS a, any_value(coalesce(b, a)) AS e, arg_min(line, (abs(line - coalesce(b, a)), line)) AS line FROM f JOIN l USING (path) GROUP BY k)
    SELECT f.k AS finding_id, n.path, n.line, CASE WHEN n.e = n.line AND n.a > 0 AND n.a < n.line AND (n.path, n.a) IN (SELECT (path, line) FROM l) THEN n.a END AS start_line FROM f LEFT JOIN n ON f.k = n.k""",
)
def comment_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments over several lines."""
    k = F.col("o_orderkey")
    place = F.struct(numbered("Brand#", F.col("o_custkey") % 70).alias("file"), (k % 60).alias("line_start"), F.when(k % 5 > 0, k % 60 + k % 5).alias("line_end"))
    found = table(spark, sf_dir, "orders").select(k.alias("finding_id"), F.array(place).alias("locations"))
    return T.comment_ranges(found, table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_size").alias("new_line")))


@query(
    "settled_lines",
    """SELECT 'x' || o_orderkey AS fingerprint, '- ' || CASE WHEN o_orderkey % 4 = 0 THEN 'a finding' WHEN o_orderkey % 4 = 1 THEN 't' || o_custkey ELSE '[t' || o_custkey || '](https://h/' || o_orderkey || ')' END || ' — ' || CASE WHEN o_orderkey % 3 = 1 THEN 'withdrawn' ELSE 'fixed in `' || substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 7) || '`' END AS line FROM orders WHERE o_orderkey % 3 > 0""",
)
def settled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of what closed."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders").select(k, c, numbered("x", k).alias("fingerprint"))
    plan = o.select("fingerprint", F.when(k % 3 == 0, "post").when(k % 3 == 1, "withdrawn").otherwise("fixed").alias("action"), F.sha2(c.cast(S_), 256).alias("sha"))
    body = F.when(k % 4 > 0, F.concat(F.lit("**P2 — t"), c.cast(S_), F.lit("**\n\n**more**")))
    return T.settled_lines(plan, o.select("fingerprint", body.alias("body"), F.when(k % 4 > 1, numbered("https://h/", k)).alias("url")), F.col("sha"))


@query(
    "review_events",
    """WITH r AS (SELECT o_orderkey AS review_id, ['approve', 'comment', 'request_changes'][o_orderkey % 3 + 1] AS v, ['approve', 'request_changes', NULL][o_custkey % 3 + 1] AS l, o_orderkey % 5 // 2 AS n FROM orders), b AS (SELECT *, v = 'request_changes' AND l IS DISTINCT FROM v AS blocking FROM r)
    SELECT review_id, blocking, n > 0 OR blocking AS posted, CASE WHEN n > 0 OR blocking THEN CASE WHEN v = 'request_changes' THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END END AS event FROM b""",
)
def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reviews are posted, and as what."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    verdict = F.when(k % 3 == 0, "approve").when(k % 3 == 1, "comment").otherwise("request_changes")
    last = F.when(c % 3 == 0, "approve").when(c % 3 == 1, "request_changes")
    return T.review_events(table(spark, sf_dir, "orders").select(k.alias("review_id"), verdict.alias("verdict"), last.alias("last_verdict"), F.expr("o_orderkey % 5 div 2").alias("comments")))
