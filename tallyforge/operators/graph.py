"""Symbols and call edges: neighbours, bounded reach, overlap, containment, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.intervals import innermost, overlaps, parents
from tallyforge.sources.store import materialise


def callers(edges: DataFrame, symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges into the targets with their sources; several edges between two symbols stay several rows."""
    hit = edges.join(targets.select(F.col("symbol_id").alias("dst")), "dst", "left_semi")
    return hit.join(symbols.select(F.col("symbol_id").alias("src"), F.col("name").alias("src_name")), "src")


def callees(edges: DataFrame, symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges out of the sources; unresolved targets stay, without a name."""
    hit = edges.join(sources.select(F.col("symbol_id").alias("src")), "src", "left_semi")
    return hit.join(symbols.select(F.col("symbol_id").alias("dst"), F.col("name").alias("dst_resolved")), "dst", "left")


def one_hop(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Symbols one edge away, outside the start set, with the relation; once each."""
    s = start.select("symbol_id").distinct()
    up = edges.join(s.withColumnRenamed("symbol_id", "dst"), "dst", "left_semi").select(F.col("src").alias("symbol_id"), F.lit("caller").alias("relation"))
    down = edges.filter("dst is not null").join(s.withColumnRenamed("symbol_id", "src"), "src", "left_semi").select(F.col("dst").alias("symbol_id"), F.lit("callee").alias("relation"))
    return up.unionByName(down).distinct().join(s, "symbol_id", "left_anti")


def reach(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """Caller edges traversed within `depth` rounds, repeats included. Callers and resolved callees that are new
    make the next round; rounds are sets, so the order of visits doesn't matter."""
    frontier = seen = start.select("symbol_id").distinct()
    counts = []
    for r in range(1, depth + 1):
        up = edges.join(frontier.withColumnRenamed("symbol_id", "dst"), "dst", "left_semi")
        counts.append(up.agg(F.lit(r).alias("round"), F.count(F.lit(1)).alias("reached")))
        down = edges.filter("dst is not null").join(frontier.withColumnRenamed("symbol_id", "src"), "src", "left_semi")
        new = up.select(F.col("src").alias("symbol_id")).union(down.select("dst")).distinct()
        frontier = new.join(seen, "symbol_id", "left_anti")
        seen = seen.union(frontier)
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


def nesting(symbols: DataFrame) -> DataFrame:
    """Each symbol with its parent, null at the top."""
    return symbols.join(parents(symbols), "symbol_id", "left")


def qualified_names(symbols: DataFrame) -> DataFrame:
    """Names joined from the outermost symbol down, over (symbol_id, parent_id, name), at any depth. Each round joins
    what is known of twice as many levels, so rounds are few; a written table ends each. Parents that lead in a circle raise."""
    up = symbols.select("symbol_id", F.col("name").alias("qualified_name"), F.col("parent_id").alias("next"))
    n = symbols.count()
    while True:
        above = up.select(F.col("symbol_id").alias("next"), F.col("qualified_name").alias("above"), F.col("next").alias("further"))
        joined = F.when(F.col("above").isNotNull(), F.concat("above", F.lit("."), "qualified_name")).otherwise(F.col("qualified_name"))
        up = materialise(up.join(above, "next", "left").select("symbol_id", joined.alias("qualified_name"), F.col("further").alias("next")), "names")
        if not up.filter("next IS NOT NULL").limit(1).count():
            return symbols.join(up.select("symbol_id", "qualified_name"), "symbol_id")
        if (n := n // 2) == 0:
            raise ValueError("symbols that are each other's parents")


def call_edges(references: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """G1: edges of calls: the innermost symbol around each reference (path, name, offset, line) is the source (a reference
    outside all of them makes no edge), the resolution ladder finds the target."""
    around = innermost(symbols, references.select("path", "offset").distinct()).withColumnRenamed("symbol_id", "src")
    inside = references.join(around, ["path", "offset"])
    return resolve_calls(inside, symbols, imports).select("src", "dst", F.col("name").alias("dst_name"), F.lit("call").alias("kind"), "resolution", "line")


def related(edges: DataFrame, symbols: DataFrame, spans: DataFrame) -> DataFrame:
    """What touches the changed lines: callers and callees, in other files, of the symbols that overlap them; each
    once with its relation. Names and places come along for the entries' texts."""
    own = overlaps(symbols, spans)
    paths = own.select(F.col("path")).distinct()
    near = one_hop(edges, own.select("symbol_id"))
    return near.join(symbols.select("symbol_id", "path", "qualified_name", "start_line"), "symbol_id").join(paths, "path", "left_anti")


def bodies(entries: DataFrame, chunks: DataFrame, files: DataFrame, most: int = 1800) -> DataFrame:
    """The text of each entry: its symbol's chunk, else its lines of the file; cut to `most` characters."""
    by_chunk = chunks.select("symbol_id", F.col("body").alias("chunk_body"))
    j = entries.join(by_chunk, "symbol_id", "left").join(files.select("path", F.col("text").alias("file_text")), "path", "left")
    cut = F.array_join(F.slice(F.split("file_text", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return j.withColumn("body", F.substring(F.coalesce("chunk_body", cut), 1, most)).drop("chunk_body", "file_text")


def blast(counts: DataFrame, least: int = 8) -> DataFrame:
    """A change whose rounds reached `least` caller edges or more has a wide blast radius."""
    return counts.agg(F.coalesce(F.sum("reached"), F.lit(0)).cast("long").alias("reached")).withColumn("wide", F.col("reached") >= least)


#: How a call looks, how a call on the object itself looks, how a definition starts, names that aren't calls.
CALL_SITE = r"(?:self\.)?([A-Za-z_]\w{3,})\s*\("
SELF_CALL = r"self\.([A-Za-z_]\w{3,})\s*\("
DEFINED = r"^\s*(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w*)"
NOT_CALLS = tuple("print super range len str int list dict set tuple bool float isinstance getattr setattr hasattr return assert raise yield await if for while with except self format join append get type".split())


def ranked_calls(lines: DataFrame, own: DataFrame, most: int = 16) -> DataFrame:
    """W10, S3, T11 over added lines (unit, text) and the unit's own names (unit, name): the names called and not defined,
    best first: private ones, those reached through the object itself, those of the unit, by alphabet; `most` a unit."""
    names = lambda pattern: lines.select("unit", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("name")).distinct()
    defined = lines.select("unit", F.regexp_extract("text", DEFINED, 1).alias("name")).filter("name <> ''").distinct()
    called = names(CALL_SITE).filter(~F.col("name").isin(*NOT_CALLS)).join(defined, ["unit", "name"], "left_anti")
    mark = lambda df, c: df.select("unit", "name").distinct().withColumn(c, F.lit(True))
    j = called.join(mark(names(SELF_CALL), "inner_"), ["unit", "name"], "left").join(mark(own, "own_"), ["unit", "name"], "left")
    w = Window.partitionBy("unit").orderBy(~F.col("name").startswith("_"), F.col("inner_").isNull(), F.col("own_").isNull(), "name")
    return j.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("unit", "name", "place")


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Target of each call (path, name): the file's last such symbol, else the only one among imported files, else
    the only one anywhere, else none. Counts are of symbols, so two definitions in one imported file defeat that rung.

    Distinct (path, name) pairs are resolved once and joined back, so a name called everywhere costs its pairs only."""
    asked = calls.select("path", "name").distinct()
    local = symbols.groupBy("path", "name").agg(F.max_by("symbol_id", F.struct("start_byte", "symbol_id")).alias("local"))
    once = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("id")).filter("n = 1").select("name", F.col("id").alias("only"))
    per_file = symbols.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("id")).withColumnRenamed("path", "target")
    through = asked.join(imports.select("path", "target").distinct(), "path").join(per_file, ["target", "name"])
    through = through.groupBy("path", "name").agg(F.sum("n").alias("n"), F.min("id").alias("id")).filter("n = 1").select("path", "name", F.col("id").alias("imported"))
    pairs = asked.join(local, ["path", "name"], "left").join(through, ["path", "name"], "left").join(once, "name", "left")
    how = F.when(F.col("local").isNotNull(), F.lit("local")).when(F.col("imported").isNotNull(), F.lit("import")).when(F.col("only").isNotNull(), F.lit("global")).otherwise(F.lit("text"))
    pairs = pairs.select("path", "name", F.coalesce("local", "imported", "only").alias("dst"), how.alias("resolution"))
    return calls.join(pairs, ["path", "name"], "left")


def repair(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Unresolved edges whose name is unique in the repository get their target."""
    once = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("only")).filter("n = 1").select(F.col("name").alias("dst_name"), "only")
    j = edges.join(once, "dst_name", "left")
    fixed = F.col("dst").isNull() & F.col("only").isNotNull()
    return j.select(*[c for c in edges.columns if c not in ("dst", "resolution")], F.coalesce("dst", "only").alias("dst"), F.when(fixed, F.lit("global")).otherwise(F.col("resolution")).alias("resolution"))


#: Suffixes that an import without one may stand for, in order.
SCRIPT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".vue")


def normal_path(path: Column) -> Column:
    """a path without empty and single-dot parts, double dots taken back as far as there are folders."""
    up = lambda acc: F.slice(acc, 1, F.size(acc) - 1)
    step = lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), up(acc)).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def _as_script(base: Column) -> Column:
    """The file itself if it has a suffix, then with each suffix, then as a folder with an index."""
    own = F.when(base.rlike("[^/]\\.[^./]+$"), F.array(base)).otherwise(F.array().cast("array<string>"))
    return F.concat(own, F.array(*[F.concat(base, F.lit(f"{index}{x}")) for index in ("", "/index") for x in SCRIPT_SUFFIXES]))


def module_candidates(imports: DataFrame) -> DataFrame:
    """F5 over (path, module): the files that an import may mean, in order.

    ./x and ../x are from the importing file's folder; .x is a sibling module of Python's, however many dots; @/x and ~/x
    are under src or the root; anything else is a dotted module, then a path, and last the Go file named by its tail."""
    m = F.col("module")
    folder = F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1)
    below = lambda x: F.when(folder == "", x).when(x == "", folder).otherwise(F.concat(folder, F.lit("/"), x))
    as_python = lambda base: F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    sibling = below(F.translate(F.ltrim(m, F.lit(".")), ".", "/"))
    stem = F.substring(m, 3, 1 << 20)
    plain = F.concat(as_python(F.translate(m, ".", "/")), _as_script(m), F.array(F.concat(F.regexp_extract(m, "([^/]*)$", 1), F.lit(".go"))))
    named = (
        F.when(m.rlike("^\\.\\.?/"), _as_script(normal_path(F.concat(folder, F.lit("/"), m))))
        .when(F.startswith(m, F.lit(".")), as_python(F.when(sibling == "", F.lit(".")).otherwise(sibling)))
        .when(m.rlike("^[@~]/"), F.concat(_as_script(F.concat(F.lit("src/"), stem)), _as_script(stem)))
        .otherwise(plain)
    )
    return imports.select("path", "module", F.posexplode(named).alias("ordinal", "candidate"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The first candidate that exists."""
    hit = module_candidates(imports.select("path", "module").distinct()).join(files.select(F.col("path").alias("candidate")), "candidate", "left_semi")
    return hit.groupBy("path", "module").agg(F.min_by("candidate", "ordinal").alias("target"))


def top_symbol_per_name(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """The first symbol by path and line whose name or qualified name is asked for: two equi-joins, not an OR."""
    a = names.select(F.col("name").alias("asked")).distinct()
    by = symbols.join(a, symbols["name"] == a["asked"]).unionByName(symbols.join(a, symbols["qualified_name"] == a["asked"])).distinct()
    w = Window.partitionBy("asked").orderBy("path", "start_line", "symbol_id")
    return by.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")
