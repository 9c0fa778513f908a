"""Graph queries: `lineitem` as call edges between parts and suppliers, `events` as byte ranges, `part` as symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query
from tallyforge.operators import graph as G
from tallyforge.operators import index as I
from tallyforge.sources.tables import table

EDGES = "e AS (SELECT l_partkey AS src, CASE WHEN l_suppkey % 10 <> 7 THEN 1000000 + l_suppkey END AS dst, l_linenumber AS line FROM lineitem)"
SYMBOLS = "s AS (SELECT p_partkey AS symbol_id, p_name AS name FROM part UNION ALL SELECT 1000000 + s_suppkey, s_name FROM supplier)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("src"), F.when(F.col("l_suppkey") % 10 != 7, F.lit(1000000) + F.col("l_suppkey")).alias("dst"), F.col("l_linenumber").alias("line"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"))
    return p.unionByName(table(spark, sf_dir, "supplier").select((F.lit(1000000) + F.col("s_suppkey")).alias("symbol_id"), F.col("s_name").alias("name")))


def ids(df: DataFrame, condition: str) -> DataFrame:
    return df.select("symbol_id").filter(condition)


@query("callers", f"WITH {EDGES}, {SYMBOLS} SELECT src, dst, line, name AS src_name FROM e JOIN s ON src = symbol_id WHERE dst % 20 = 0")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir)
    return G.callers(edges(spark, sf_dir), s, ids(s, "symbol_id % 20 = 0"))


@query("callees_left", f"WITH {EDGES}, {SYMBOLS} SELECT src, dst, line, name AS dst_resolved FROM e LEFT JOIN s ON dst = symbol_id WHERE src % 20 = 0")
def callees_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir)
    return G.callees(edges(spark, sf_dir), s, ids(s, "symbol_id % 20 = 0"))


@query(
    "one_hop_neighbours",
    f"WITH {EDGES} SELECT * FROM (SELECT DISTINCT dst AS symbol_id, 'callee' AS relation FROM e WHERE src % 20 = 0 AND dst IS NOT NULL UNION SELECT DISTINCT src, 'caller' FROM e WHERE dst % 20 = 0) WHERE symbol_id % 20 <> 0",
)
def one_hop_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.one_hop(edges(spark, sf_dir), ids(symbols(spark, sf_dir), "symbol_id % 20 = 0"))


@query(
    "blast_radius_depth2",
    f"""WITH {EDGES}, {SYMBOLS}, f0 AS (SELECT DISTINCT symbol_id FROM s WHERE symbol_id % 20 = 0),
    f1 AS (SELECT src AS x FROM e WHERE dst IN (SELECT * FROM f0) UNION SELECT dst FROM e WHERE dst IS NOT NULL AND src IN (SELECT * FROM f0) EXCEPT SELECT * FROM f0)
    SELECT CAST(1 AS INT) AS round, count(*) AS reached FROM e WHERE dst IN (SELECT * FROM f0) UNION ALL SELECT CAST(2 AS INT), count(*) FROM e WHERE dst IN (SELECT x FROM f1)""",
)
def blast_radius_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reach(edges(spark, sf_dir), ids(symbols(spark, sf_dir), "symbol_id % 20 = 0"))


RANGES = "r AS (SELECT event_id AS symbol_id, CAST(user_id AS VARCHAR) AS path, CAST(event_id % 1000 AS INT) AS start_byte, CAST(event_id % 1000 + 50 + event_id % 400 AS INT) AS end_byte FROM events)"


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("symbol_id"), F.col("user_id").cast("string").alias("path"), (i % 1000).cast("int").alias("start_byte"), (i % 1000 + 50 + i % 400).cast("int").alias("end_byte")
    )


@query("overlap_join", f"WITH {RANGES}, h AS (SELECT CAST(u AS VARCHAR) AS path, CAST(u % 900 AS INT) AS lo, CAST(u % 900 + 20 AS INT) AS hi FROM (SELECT DISTINCT user_id AS u FROM events)) SELECT symbol_id, path, start_byte AS start_line, end_byte AS end_line, lo, hi FROM r JOIN h USING (path) WHERE start_byte <= hi AND end_byte >= lo")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct()
    spans = u.select(F.col("u").cast("string").alias("path"), (F.col("u") % 900).cast("int").alias("lo"), (F.col("u") % 900 + 20).cast("int").alias("hi"))
    return G.overlaps(ranges(spark, sf_dir).withColumnsRenamed({"start_byte": "start_line", "end_byte": "end_line"}), spans)


@query("innermost_containing", f"WITH {RANGES}, o AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS path, CAST(event_id % 700 AS INT) AS off FROM events WHERE event_id % 20 = 0) SELECT path, off AS \"offset\", arg_max(symbol_id, CAST(start_byte AS BIGINT) * 1000000000 + symbol_id) AS symbol_id FROM o JOIN r USING (path) WHERE start_byte <= off AND off < end_byte GROUP BY path, off")
def innermost_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_id % 20 = 0")
    points = e.select(F.col("user_id").cast("string").alias("path"), (F.col("event_id") % 700).cast("int").alias("offset")).distinct()
    return G.innermost(ranges(spark, sf_dir), points)


@query(
    "nesting_parents",
    f"""WITH {RANGES}, q AS (SELECT * FROM r),
    h AS (SELECT c.symbol_id, arg_max(p.symbol_id, (CAST(p.start_byte AS BIGINT) * 10000 - p.end_byte) * 1000000000 + p.symbol_id) AS parent_id FROM q c JOIN q p ON c.path = p.path AND p.symbol_id <> c.symbol_id
      AND p.start_byte <= c.start_byte AND c.end_byte <= p.end_byte AND (p.start_byte < c.start_byte OR c.end_byte < p.end_byte) GROUP BY c.symbol_id)
    SELECT q.symbol_id, parent_id FROM q LEFT JOIN h ON q.symbol_id = h.symbol_id""",
)
def nesting_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.nesting(ranges(spark, sf_dir)).select("symbol_id", "parent_id")


#: Parts as symbols: brand is the file, the last word of the name the symbol's name.
PARTS = "y AS (SELECT p_partkey AS symbol_id, p_brand AS path, p_size || '-' || (p_partkey % 37) AS name, p_partkey AS start_byte FROM part), c AS (SELECT c_custkey AS call_id, 'Brand#' || (c_custkey % 60) AS path, (c_custkey % 55) || '-' || (c_custkey % 41) AS name FROM customer)"


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_partkey") % 37).cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("path"), name.alias("name"), F.col("p_partkey").alias("start_byte"))


def part_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col("c_custkey"), "string"
    return table(spark, sf_dir, "customer").select(c.alias("call_id"), F.concat(F.lit("Brand#"), (c % 60).cast(s)).alias("path"), F.concat((c % 55).cast(s), F.lit("-"), (c % 41).cast(s)).alias("name"))


@query(
    "resolution_ladder",
    f"""WITH {PARTS}, i AS (SELECT DISTINCT c.path, 'Brand#' || (CAST(substr(c.path, 7) AS INT) % 55 + 1) AS target FROM c),
    l AS (SELECT path, name, max(symbol_id) AS local FROM y GROUP BY ALL), o AS (SELECT name, min(symbol_id) AS single FROM y GROUP BY name HAVING count(*) = 1),
    t AS (SELECT i.path, y.name, min(symbol_id) AS imported FROM i JOIN y ON i.target = y.path GROUP BY ALL HAVING count(*) = 1)
    SELECT call_id, c.path, c.name, coalesce(local, imported, single) AS dst, CASE WHEN local IS NOT NULL THEN 'local' WHEN imported IS NOT NULL THEN 'import' WHEN single IS NOT NULL THEN 'global' ELSE 'text' END AS resolution
    FROM c LEFT JOIN l ON c.path = l.path AND c.name = l.name LEFT JOIN t ON c.path = t.path AND c.name = t.name LEFT JOIN o ON c.name = o.name""",
)
def resolution_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = part_calls(spark, sf_dir)
    target = F.concat(F.lit("Brand#"), (F.substring("path", 7, 9).cast("int") % 55 + 1).cast("string"))
    return G.resolve_calls(calls, part_symbols(spark, sf_dir), calls.select("path", target.alias("target")).distinct())


@query(
    "unique_name_repair",
    f"WITH {PARTS}, o AS (SELECT name, min(symbol_id) AS single FROM y GROUP BY name HAVING count(*) = 1) SELECT call_id, c.name AS dst_name, coalesce(CASE WHEN call_id % 4 = 0 THEN call_id END, single) AS dst, CASE WHEN call_id % 4 = 0 THEN 'local' WHEN single IS NOT NULL THEN 'global' ELSE 'text' END AS resolution FROM c LEFT JOIN o ON c.name = o.name",
)
def unique_name_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("call_id") % 4 == 0
    e = part_calls(spark, sf_dir).select("call_id", F.col("name").alias("dst_name"), F.when(known, F.col("call_id")).alias("dst"), F.when(known, "local").otherwise("text").alias("resolution"))
    return G.repair(e, part_symbols(spark, sf_dir))


@query("top_symbol_per_name", f"WITH {PARTS}, a AS (SELECT DISTINCT name FROM c) SELECT asked, symbol_id FROM (SELECT a.name AS asked, symbol_id, row_number() OVER (PARTITION BY a.name ORDER BY path, symbol_id) AS k FROM a JOIN y ON a.name = y.name) WHERE k = 1")
def top_symbol_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = part_symbols(spark, sf_dir).withColumn("qualified_name", F.concat("path", F.lit("."), "name")).withColumn("start_line", F.col("symbol_id"))
    return G.top_symbol_per_name(s, part_calls(spark, sf_dir).select("name")).select("asked", "symbol_id")


#: Imports of every kind by customers, and files that some of their candidates name.
IMPORT_FILES = """f AS (SELECT CASE p_partkey % 9 WHEN 0 THEN 'src/m' || p_partkey || '.py' WHEN 1 THEN 'src/m' || p_partkey || '/__init__.py' WHEN 2 THEN 'm' || p_partkey || '.vue' WHEN 3 THEN 'lib/m' || p_partkey || '/index.tsx'
      WHEN 4 THEN 'src/sub/m' || p_partkey || '.js' WHEN 5 THEN 'src/sub/m' || p_partkey || '.py' WHEN 6 THEN 'm' || p_partkey || '.go' WHEN 7 THEN 'src/app.' || p_partkey || '.css' ELSE 'pkg/m' || p_partkey || '/__init__.py' END AS path FROM part),
    i AS (SELECT DISTINCT 'src/sub/c' || c_custkey % 50 || '.ts' AS path, c_custkey % 1000 AS k, c_custkey // 1000 AS o FROM customer),
    j AS (SELECT path, CASE (k * 7 + o) % 8 WHEN 0 THEN '../m' || k WHEN 1 THEN './m' || k WHEN 2 THEN '.m' || k WHEN 3 THEN '@/m' || k WHEN 4 THEN 'pkg.m' || k WHEN 5 THEN 'host/repo/m' || k WHEN 6 THEN '../.././lib//m' || k ELSE '~/app.' || k || '.css' END AS module FROM i),"""


@query(
    "import_resolution",
    f"""WITH {IMPORT_FILES}
    d AS (SELECT DISTINCT path, module, regexp_extract(module, '([^/.]*)$', 1) AS m FROM j),
    s AS (SELECT unnest(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.vue']) AS x, unnest([1, 2, 3, 4, 5, 6]) AS xo),
    b AS (SELECT path, module, base, o FROM (
        SELECT path, module, 'src/' || m AS base, 0 AS o FROM d WHERE module LIKE '../m%' UNION ALL SELECT path, module, 'src/sub/' || m, 0 FROM d WHERE module LIKE './m%'
        UNION ALL SELECT path, module, 'src/' || m, 0 FROM d WHERE module LIKE '@/%' UNION ALL SELECT path, module, m, 100 FROM d WHERE module LIKE '@/%'
        UNION ALL SELECT path, module, module, 10 FROM d WHERE module LIKE 'pkg%' OR module LIKE 'host/%' UNION ALL SELECT path, module, 'lib/' || m, 0 FROM d WHERE module LIKE '../..%')),
    n AS (SELECT path, module, base || x AS candidate, o + xo AS o FROM b, s UNION ALL SELECT path, module, base || '/index' || x, o + 20 + xo FROM b, s
      UNION ALL SELECT path, module, 'src/sub/' || m || y, yo FROM d, (VALUES ('.py', 1), ('/__init__.py', 2)) y(y, yo) WHERE module LIKE '.m%'
      UNION ALL SELECT path, module, replace(module, '.', '/') || y, yo FROM d, (VALUES ('.py', 1), ('/__init__.py', 2)) y(y, yo) WHERE module LIKE 'pkg%' OR module LIKE 'host/%'
      UNION ALL SELECT path, module, regexp_extract(module, '([^/]*)$', 1) || '.go', 200 FROM d WHERE module LIKE 'pkg%' OR module LIKE 'host/%'
      UNION ALL SELECT path, module, replace(module, '~/', 'src/'), 0 FROM d WHERE module LIKE '~%')
    SELECT n.path, module, arg_min(candidate, o) AS target FROM n JOIN f ON candidate = f.path GROUP BY ALL""",
)
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative, aliased, dotted, Go and Python's relative imports against files that some of them name."""
    k, s = F.col("p_partkey"), "string"
    path = lambda a, b: F.concat(F.lit(a), k.cast(s), F.lit(b))
    shapes = [("src/m", ".py"), ("src/m", "/__init__.py"), ("m", ".vue"), ("lib/m", "/index.tsx"), ("src/sub/m", ".js"), ("src/sub/m", ".py"), ("m", ".go"), ("src/app.", ".css"), ("pkg/m", "/__init__.py")]
    files = table(spark, sf_dir, "part").select(F.element_at(F.array(*[path(a, b) for a, b in shapes]), (k % 9 + 1).cast("int")).alias("path"))
    c = F.col("c_custkey")
    i = table(spark, sf_dir, "customer").select(F.concat(F.lit("src/sub/c"), (c % 50).cast(s), F.lit(".ts")).alias("path"), (c % 1000).alias("k"), F.expr("c_custkey div 1000").alias("o"))
    named = [F.concat(F.lit(a), F.col("k").cast(s), F.lit(b)) for a, b in (("../m", ""), ("./m", ""), (".m", ""), ("@/m", ""), ("pkg.m", ""), ("host/repo/m", ""), ("../.././lib//m", ""), ("~/app.", ".css"))]
    imports = i.select("path", F.element_at(F.array(*named), ((F.col("k") * 7 + F.col("o")) % 8 + 1).cast("int")).alias("module"))
    return G.resolve_imports(imports, files)


@query(
    "symbol_hierarchy",
    """WITH t AS (SELECT 3000 + r_regionkey AS symbol_id, NULL::BIGINT AS parent_id, r_name AS name FROM region UNION ALL SELECT 2000 + n_nationkey, 3000 + n_regionkey, n_name FROM nation UNION ALL SELECT 10000 + s_suppkey, 2000 + s_nationkey, s_name FROM supplier)
    SELECT c.symbol_id, concat_ws('.', g.name, p.name, c.name) AS qualified_name FROM t c LEFT JOIN t p ON c.parent_id = p.symbol_id LEFT JOIN t g ON p.parent_id = g.symbol_id""",
)
def symbol_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as symbols within each other."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    one = lambda df, key, base, up, up_base, name: df.select((F.lit(base) + F.col(key)).cast("long").alias("symbol_id"), (F.lit(up_base) + F.col(up)).cast("long").alias("parent_id"), F.col(name).alias("name"))
    tree = one(s, "s_suppkey", 10000, "s_nationkey", 2000, "s_name").unionByName(one(n, "n_nationkey", 2000, "n_regionkey", 3000, "n_name"))
    tree = tree.unionByName(one(r.withColumn("up", F.lit(None).cast("long")), "r_regionkey", 3000, "up", 0, "r_name"))
    return G.qualified_names(tree).select("symbol_id", "qualified_name")


#: Documents as added lines of their source (the unit), with calls and definitions in them.
ADDED = """a AS (SELECT source AS unit, unnest(['async def helper' || (doc_id % 4) || '(x):', '  self._run' || (doc_id % 5) || '(x); build' || (n_chars % 6) || ' (y); helper' || (doc_id % 6) || '(z) + print(q) + ab(c)']) AS text FROM documents)"""


def added(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("doc_id"), "string"
    head = F.concat(F.lit("async def helper"), (i % 4).cast(s), F.lit("(x):"))
    body = F.concat(F.lit("  self._run"), (i % 5).cast(s), F.lit("(x); build"), (F.col("n_chars") % 6).cast(s), F.lit(" (y); helper"), (i % 6).cast(s), F.lit("(z) + print(q) + ab(c)"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("unit"), F.explode(F.array(head, body)).alias("text"))


@query(
    "ranked_calls",
    f"""WITH {ADDED}, c AS (SELECT DISTINCT unit, unnest(regexp_extract_all(text, '(?:self\\.)?([A-Za-z_]\\w{{3,}})\\s*\\(', 1)) AS name FROM a), d AS (SELECT unit, regexp_extract(text, '^\\s*(?:async\\s+)?(?:def|class)\\s+([A-Za-z_]\\w*)', 1) AS name FROM a),
    i AS (SELECT DISTINCT unit, unnest(regexp_extract_all(text, 'self\\.([A-Za-z_]\\w{{3,}})\\s*\\(', 1)) AS name FROM a), o AS (SELECT DISTINCT source AS unit, 'build' || (doc_id % 2) AS name FROM documents),
    k AS (SELECT unit, name, CAST(row_number() OVER (PARTITION BY unit ORDER BY NOT starts_with(name, '_'), (unit, name) NOT IN (SELECT unit, name FROM i), (unit, name) NOT IN (SELECT unit, name FROM o), name) AS INT) AS place
      FROM c WHERE name <> 'print' AND (unit, name) NOT IN (SELECT unit, name FROM d)) SELECT * FROM k WHERE place <= 16""",
)
def ranked_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select(F.col("source").alias("unit"), F.concat(F.lit("build"), (F.col("doc_id") % 2).cast("string")).alias("name"))
    return G.ranked_calls(added(spark, sf_dir), own)


#: Events as named symbols of their user's file, and as calls in it.
NAMED = f"{RANGES}, y AS (SELECT *, 'f' || (symbol_id % 211) AS name FROM r), p AS (SELECT CAST(user_id AS VARCHAR) AS path, 'f' || (event_id % 190) AS name, CAST(event_id % 1500 AS INT) AS off, CAST(event_id % 90 AS INT) AS line FROM events)"


@query(
    "call_edges",
    f"""WITH {NAMED}, s AS (SELECT path, off, arg_max(symbol_id, CAST(start_byte AS BIGINT) * 1000000000 + symbol_id) AS src FROM (SELECT DISTINCT path, off FROM p) JOIN r USING (path) WHERE start_byte <= off AND off < end_byte GROUP BY path, off),
    l AS (SELECT path, name, arg_max(symbol_id, CAST(start_byte AS BIGINT) * 1000000000 + symbol_id) AS local FROM y GROUP BY ALL), o AS (SELECT name, min(symbol_id) AS single FROM y GROUP BY name HAVING count(*) = 1),
    i AS (SELECT DISTINCT path, CAST(CAST(path AS INT) % 40 + 1 AS VARCHAR) AS target FROM p), t AS (SELECT i.path, y.name, min(symbol_id) AS imported FROM i JOIN y ON i.target = y.path GROUP BY ALL HAVING count(*) = 1)
    SELECT src, coalesce(local, imported, single) AS dst, p.name AS dst_name, 'call' AS kind, CASE WHEN local IS NOT NULL THEN 'local' WHEN imported IS NOT NULL THEN 'import' WHEN single IS NOT NULL THEN 'global' ELSE 'text' END AS resolution, line
    FROM p JOIN s USING (path, off) LEFT JOIN l ON p.path = l.path AND p.name = l.name LEFT JOIN t ON p.path = t.path AND p.name = t.name LEFT JOIN o ON p.name = o.name""",
)
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ranges(spark, sf_dir).withColumn("name", F.concat(F.lit("f"), (F.col("symbol_id") % 211).cast("string")))
    i = F.col("event_id")
    calls = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.concat(F.lit("f"), (i % 190).cast("string")).alias("name"), (i % 1500).cast("int").alias("offset"), (i % 90).cast("int").alias("line"))
    imports = calls.select("path", (F.col("path").cast("int") % 40 + 1).cast("string").alias("target")).distinct()
    return G.call_edges(calls, s, imports)


@query(
    "related_symbols",
    f"""WITH {EDGES}, s AS (SELECT p_partkey AS symbol_id, p_brand AS path, CAST(p_partkey % 500 AS INT) AS a, CAST(p_partkey % 500 + p_size AS INT) AS b FROM part UNION ALL SELECT 1000000 + s_suppkey, 'nation' || s_nationkey, CAST(1 AS INT), CAST(9 AS INT) FROM supplier),
    h AS (SELECT DISTINCT p_brand AS path, CAST(100 AS INT) AS lo, CAST(105 AS INT) AS hi FROM part WHERE p_partkey % 20 = 0), w AS (SELECT DISTINCT symbol_id, path FROM s JOIN h USING (path) WHERE a <= hi AND b >= lo),
    n AS (SELECT src AS symbol_id, 'caller' AS relation FROM e WHERE dst IN (SELECT symbol_id FROM w) UNION SELECT dst, 'callee' FROM e WHERE dst IS NOT NULL AND src IN (SELECT symbol_id FROM w))
    SELECT n.symbol_id, relation, path FROM n JOIN s USING (symbol_id) WHERE n.symbol_id NOT IN (SELECT symbol_id FROM w) AND path NOT IN (SELECT path FROM w)""",
)
def related_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    k = F.col("p_partkey")
    one = p.select(k.alias("symbol_id"), F.col("p_brand").alias("path"), (k % 500).cast("int").alias("start_line"), (k % 500 + F.col("p_size")).cast("int").alias("end_line"))
    two = s.select((F.lit(1000000) + F.col("s_suppkey")).alias("symbol_id"), F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("path"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))
    every = one.unionByName(two).withColumn("qualified_name", F.col("symbol_id").cast("string"))
    spans = p.filter("p_partkey % 20 = 0").select(F.col("p_brand").alias("path")).distinct().withColumns({"lo": F.lit(100), "hi": F.lit(105)})
    return G.related(edges(spark, sf_dir), every, spans).select("symbol_id", "relation", "path")


@query("blast_radius", f"WITH {EDGES}, {SYMBOLS} SELECT count(*) AS reached, count(*) >= 8 AS wide FROM e WHERE dst IN (SELECT symbol_id FROM s WHERE symbol_id % 20 = 0)")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.blast(G.reach(edges(spark, sf_dir), ids(symbols(spark, sf_dir), "symbol_id % 20 = 0"), 1))


@query("unresolved_after_removal", f"WITH {EDGES} SELECT src, CASE WHEN dst % 20 <> 0 THEN dst END AS dst, line, 'local' AS resolution FROM e WHERE src % 20 <> 0")
def unresolved_after_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.unresolve(edges(spark, sf_dir).withColumn("resolution", F.lit("local")), ids(symbols(spark, sf_dir), "symbol_id % 20 = 0"))
