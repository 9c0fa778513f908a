"""Queries over sources made from the tables: repositories of packs, source files of four languages, a vector index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query
from tallyforge.operators import memory as M
from tallyforge.operators import neighbours as V
from tallyforge.operators import symbols as S
from tallyforge.plans.stats import vectors
from tallyforge.sources import git as X
from tallyforge.sources.store import shared_dir
from tallyforge.sources.tables import table

S_ = "string"


def _entry(mode: str, name: Column, sha: Column) -> Column:
    return F.concat(F.encode(F.concat(F.lit(f"{mode} "), name), "utf-8"), F.unhex(F.lit("00")), F.unhex(sha))


def _named(kind: str, content: Column) -> Column:
    return F.sha1(F.concat(F.encode(F.concat(F.lit(f"{kind} "), F.octet_length(content).cast(S_)), "utf-8"), F.unhex(F.lit("00")), content))


def repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects (kind, content) of a repository of the documents: a folder for each remainder of 50, one commit."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select((i % 50).alias("folder"), F.concat(F.lit("f"), i.cast(S_), F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    files = d.withColumn("sha", _named("blob", F.col("content")))
    joined = lambda rows: F.aggregate(F.array_sort(F.collect_list(F.struct("name", "entry"))), F.lit(b""), lambda a, x: F.concat(a, x["entry"]))
    folders = files.withColumn("entry", _entry("100644", F.col("name"), F.col("sha"))).groupBy("folder").agg(joined(0).alias("content"))
    named = folders.select(F.concat(F.lit("d"), F.col("folder").cast(S_)).alias("name"), _named("tree", F.col("content")).alias("sha"))
    ordered = named.withColumns({"entry": _entry("40000", F.col("name"), F.col("sha")), "name": F.concat("name", F.lit("/"))})
    root = ordered.agg(joined(0).alias("content"))  # at most fifty entries
    commit = root.select(F.concat(F.lit("tree "), _named("tree", F.col("content")), F.lit("\nauthor a <a> 1 +0000\ncommitter a <a> 1 +0000\n\nall\n")).cast("binary").alias("content"))
    out = files.select(F.lit("blob").alias("kind"), "content")
    for kind, rows in (("tree", folders), ("tree", root), ("commit", commit)):
        out = out.unionByName(rows.select(F.lit(kind).alias("kind"), "content"))
    return out


@query(
    "git_files",
    "SELECT 'd' || doc_id % 50 || '/f' || doc_id || '.txt' AS path, '100644' AS mode, sha1('blob ' || strlen(text) || chr(0) || text) AS sha, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS content FROM documents",
)
def git_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1, SC2: packs of the documents, written by tasks and read in parts; the commit's tree is walked, blobs join by name."""
    at = shared_dir(spark, "repository")
    X.write_packs(repository(spark, sf_dir), at)
    found = X.objects(spark, at, part=500)
    listed = X.list_trees(found, X.commits(found).select("commit"))
    blobs = found.filter("kind = 'blob'").groupBy("sha").agg(F.any_value(F.sha2("content", 256)).alias("content"))
    return listed.join(blobs, "sha").select("path", "mode", "sha", "size", "content")


#: A source file for each part, of four languages, with brackets in strings and templates.
SOURCES = r"""p AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'src/m' || p_partkey || '.ts' WHEN 1 THEN 'pkg/m' || p_partkey || '.py' WHEN 2 THEN 'm' || p_partkey || '.go' ELSE 'ui/M' || p_partkey || '.vue' END AS path,
      replace(CASE p_partkey % 4 WHEN 0 THEN 'import { a } from "./m9"' || chr(10) || 'class C# {' || chr(10) || '  run(x: string) { const t = "}}"; return this.go#(t) }' || chr(10) || '}' || chr(10) || 'export const f# = async (y) => {' || chr(10) || '  return new C#(y)' || chr(10) || '}' || chr(10)
      WHEN 1 THEN 'from pkg.m# import x' || chr(10) || 'class D#:' || chr(10) || '    def size(self, n):' || chr(10) || '        return g#(n)' || chr(10)
      WHEN 2 THEN 'package p' || chr(10) || 'import "x/m#"' || chr(10) || 'func (t *T#) Run() interface{} {' || chr(10) || chr(9) || 's := `}`' || chr(10) || chr(9) || 'return h#(s)' || chr(10) || '}' || chr(10)
      ELSE '<template>{{ no() }}</template>' || chr(10) || '<script lang="ts">' || chr(10) || 'function v#() { w#(`${"}"}`) }' || chr(10) || '</script>' || chr(10) END, '#', CAST(p_partkey AS VARCHAR)) AS text FROM part),
    f AS (SELECT k, path, text, unnest(CASE k % 4
        WHEN 0 THEN [{'fact': 'import', 'name': './m9', 'q': NULL, 'kind': 'import', 'a': 1, 'b': 1, 'at': '"./m9', 'sig': NULL}, {'fact': 'symbol', 'name': 'C' || k, 'q': 'C' || k, 'kind': 'class', 'a': 2, 'b': 4, 'at': 'class', 'sig': 'class C' || k}, {'fact': 'symbol', 'name': 'run', 'q': 'C' || k || '.run', 'kind': 'method', 'a': 3, 'b': 3, 'at': 'run', 'sig': 'run(x: string)'},
          {'fact': 'call', 'name': 'go' || k, 'q': NULL, 'kind': 'call', 'a': 3, 'b': 3, 'at': 'go' || k, 'sig': NULL}, {'fact': 'symbol', 'name': 'f' || k, 'q': 'f' || k, 'kind': 'function', 'a': 5, 'b': 7, 'at': 'f' || k || ' =', 'sig': 'f' || k || ' = async (y) => { return new C' || k || '(y) }'}, {'fact': 'call', 'name': 'C' || k, 'q': NULL, 'kind': 'call', 'a': 6, 'b': 6, 'at': 'C' || k || '(y', 'sig': NULL}]
        WHEN 1 THEN [{'fact': 'import', 'name': 'pkg.m' || k, 'q': NULL, 'kind': 'import', 'a': 1, 'b': 1, 'at': 'from', 'sig': NULL}, {'fact': 'symbol', 'name': 'D' || k, 'q': 'D' || k, 'kind': 'class', 'a': 2, 'b': 4, 'at': 'class', 'sig': 'class D' || k || ':'}, {'fact': 'symbol', 'name': 'size', 'q': 'D' || k || '.size', 'kind': 'function', 'a': 3, 'b': 4, 'at': 'def', 'sig': 'def size(self, n):'}, {'fact': 'call', 'name': 'g' || k, 'q': NULL, 'kind': 'call', 'a': 4, 'b': 4, 'at': 'g' || k, 'sig': NULL}]
        WHEN 2 THEN [{'fact': 'import', 'name': 'x/m' || k, 'q': NULL, 'kind': 'import', 'a': 2, 'b': 2, 'at': '"x/', 'sig': NULL}, {'fact': 'symbol', 'name': 'Run', 'q': 'Run', 'kind': 'method', 'a': 3, 'b': 6, 'at': 'func', 'sig': 'func (t *T' || k || ') Run() interface{}'}, {'fact': 'call', 'name': 'h' || k, 'q': NULL, 'kind': 'call', 'a': 5, 'b': 5, 'at': 'h' || k, 'sig': NULL}]
        ELSE [{'fact': 'symbol', 'name': 'v' || k, 'q': 'v' || k, 'kind': 'function', 'a': 3, 'b': 3, 'at': 'function', 'sig': 'function v' || k || '()'}, {'fact': 'call', 'name': 'w' || k, 'q': NULL, 'kind': 'call', 'a': 3, 'b': 3, 'at': 'w' || k, 'sig': NULL}] END) AS x FROM p)"""


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    texts = [
        'import { a } from "./m9"\nclass C# {\n  run(x: string) { const t = "}}"; return this.go#(t) }\n}\nexport const f# = async (y) => {\n  return new C#(y)\n}\n',
        "from pkg.m# import x\nclass D#:\n    def size(self, n):\n        return g#(n)\n",
        'package p\nimport "x/m#"\nfunc (t *T#) Run() interface{} {\n\ts := `}`\n\treturn h#(s)\n}\n',
        '<template>{{ no() }}</template>\n<script lang="ts">\nfunction v#() { w#(`${"}"}`) }\n</script>\n',
    ]
    kind = (k % 4 + 1).cast("int")
    paths = [F.concat(F.lit(a), k.cast(S_), F.lit(b)) for a, b in (("src/m", ".ts"), ("pkg/m", ".py"), ("m", ".go"), ("ui/M", ".vue"))]
    text = F.replace(F.element_at(F.array(*map(F.lit, texts)), kind), F.lit("#"), k.cast(S_))
    return table(spark, sf_dir, "part").select(F.element_at(F.array(*paths), kind).alias("path"), text.alias("text"))


@query(
    "symbol_facts",
    f"WITH {SOURCES} SELECT path, x.fact AS fact, x.name AS name, x.q AS qualified_name, x.kind AS kind, CAST(x.a AS INT) AS start_line, CAST(x.b AS INT) AS end_line, CAST(strpos(text, x['at']) - 1 AS INT) AS start_byte, x.sig AS signature FROM f",
)
def symbol_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols, imports and calls of scripts, Python, Go and vue blocks."""
    return S.extract(source_files(spark, sf_dir)).drop("end_byte", "lang")


@query(
    "symbol_parents",
    f"WITH {SOURCES}, s AS (SELECT path, x.q AS q, path || '::' || x.q || '@' || (strpos(text, x['at']) - 1) AS symbol_id FROM f WHERE x.fact = 'symbol') SELECT s.symbol_id, p.symbol_id AS parent_id FROM s LEFT JOIN s p ON s.path = p.path AND contains(s.q, '.') AND p.q = regexp_extract(s.q, '^(.*)\\.', 1)",
)
def symbol_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's parent by its key."""
    return S.symbol_rows(S.extract(source_files(spark, sf_dir))).select("symbol_id", "parent_id")


@query(
    "source_chunks",
    rf"""WITH {SOURCES}, q AS (SELECT path || '.md' AS path, repeat(text, 60) AS text FROM p WHERE k % 50 = 0), s AS (SELECT path, text, x.q AS q, x.a AS a, x.b AS b, strpos(text, x['at']) - 1 AS place FROM f WHERE x.fact = 'symbol' AND NOT contains(x.q, '.')),
    c AS (SELECT path, path || '::' || q || '@' || place AS symbol_id, a, b, array_to_string(string_split(text, chr(10))[a:b], chr(10)) AS w FROM s UNION ALL SELECT path, NULL, 1, min(a) - 1, array_to_string(string_split(any_value(text), chr(10))[1:min(a) - 1], chr(10)) FROM s GROUP BY path HAVING min(a) > 1
      UNION ALL SELECT path, NULL, i * 120 + 1, least(i * 120 + 120, len(l)), array_to_string(l[i * 120 + 1:i * 120 + 120], chr(10)) FROM (SELECT path, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS l, unnest(range(0, (len(string_split(regexp_replace(text, '\n\z', ''), chr(10))) - 1) // 120 + 1)) AS i FROM q)),
    t AS (SELECT path, symbol_id, a, b, CASE WHEN length(w) > 6000 THEN substr(w, 1, 6000) || chr(10) || '… truncated …' ELSE w END AS body FROM c WHERE length(regexp_replace(w, '^\s+|\s+$', '', 'g')) >= 40)
    SELECT path, symbol_id, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line, sha256(path || ':' || body) AS content_hash, greatest(1, length(body) // 4) AS token_estimate FROM t""",
)
def source_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk per top-level symbol and for what stands before the first, windows of files without symbols."""
    files = source_files(spark, sf_dir)
    k = F.regexp_extract("path", "m(\\d+)\\.", 1).try_cast("long")
    long = files.filter((k % 50 == 0) & k.isNotNull()).select(F.concat("path", F.lit(".md")).alias("path"), F.repeat("text", F.lit(60)).alias("text"))
    every = files.unionByName(long)
    return S.chunks(every, S.extract(every)).drop("body")


@query("neighbour_index", "SELECT count(*) AS queries, true AS recall_90, true AS inserted FROM embeddings WHERE vec_id % 20 = 0")
def neighbour_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, SK7: the ten nearest of each twentieth vector by the index, a third of it inserted later, held against the exact ones."""
    v = vectors(spark, sf_dir)
    asked = v.filter("key % 20 = 0")
    model = V.fit(v)
    at = shared_dir(spark, "neighbours")
    V.build(v.filter("key % 3 > 0"), model, at)
    index = V.insert(v.filter("key % 3 = 0"), model, at)
    near = V.search(asked, index, model, 10).select("key", "neighbour", F.lit(1).alias("found"))
    true = M.knn(asked, v, 10).select("key", "neighbour").join(near, ["key", "neighbour"], "left")
    held = index.agg(F.count(F.lit(1)).alias("held"))
    every = v.agg(F.count(F.lit(1)).alias("every"))
    recall = true.agg(F.count_distinct("key").alias("queries"), (F.count("found") >= F.lit(0.9) * F.count(F.lit(1))).alias("recall_90"))
    return recall.join(held).join(every).select("queries", "recall_90", (F.col("held") == F.col("every")).alias("inserted"))  # one row each
