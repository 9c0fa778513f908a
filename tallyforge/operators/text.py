"""Text operators: fingerprints, chunks, literal search, call sites, script blocks, secrets, risk tags, paths."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.patterns import first_hits
from tallyforge.sources.store import materialise

#: Lines of a window chunk, least and most characters of a chunk, characters per token, file size limit.
CHUNK_LINES, LEAST_CHARS, MOST_CHARS, TOKEN_CHARS, MOST_BYTES = 120, 40, 6000, 4, 512 * 1024
#: Fixed value: what a cut chunk ends in.
CUT = "\n… truncated …"
#: Hits kept per literal, names searched, and hits of earlier names after which no other is searched.
HITS_PER_NAME, MOST_NAMES, MOST_HITS = 6, 12, 30
#: Languages by suffix, and suffixes of binary files.
LANGUAGES = {".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".go": "go", ".vue": "vue"}
BINARY = tuple(
    ".png .jpg .jpeg .gif .bmp .ico .webp .svgz .pdf .zip .gz .bz2 .xz .7z .tar .jar .war .class .so .dylib .dll .exe .bin .wasm .o .a "
    ".woff .woff2 .ttf .otf .eot .mp3 .mp4 .mov .avi .pyc .pyd .db .sqlite .parquet .pkl .npy".split()
)
#: Our own secret rules: name and pattern; generic assignments must also be random enough (bits per character).
SECRET_RULES = {"assigned_hex": '(?:token|secret|password|api_key) = "([0-9a-f]{40})"', "aws_key_id": "(AKIA[0-9A-Z]{16})", "private_key": "(-----BEGIN [A-Z ]*PRIVATE KEY-----)"}
SECRET_ENTROPY = 3.0
#: Tags of what a change touches, and the patterns over paths and names that show them.
RISK_RULES = {
    "auth": r"auth|login|signin|permission|authoriz|access_control|rbac|\bacl\b|_acl",
    "session": r"session|cookie|jwt|refresh_token|bearer",
    "crypto": r"crypt|cipher|hmac|_hash\b|password|signature|nonce|salt|pbkdf|bcrypt|argon",
    "payments": r"payment|charge|refund|invoice|billing|subscription|stripe|checkout",
    "data_loss": r"\bdelete|\bdrop_|truncate|purge|wipe|destroy",
    "concurrency": r"thread|mutex|semaphore|goroutine|concurren|atomic|\block\b|_lock|lock_",
}
#: Globs of paths that aren't application code.
OTHER_GLOBS = tuple(
    "tests/** test/** **/tests/** **/test/** **/*_test.* **/test_*.py **/*.test.* **/*.spec.* **/*_spec.* fixtures/** **/fixtures/** testdata/** **/testdata/** "
    "scripts/** tools/** examples/** example/** **/examples/** docs/** doc/** **/docs/** benchmarks/** **/conftest.py".split()
)


def fingerprint(file: Column, category: Column, title: Column) -> Column:
    """32 hex digits of the sha256 of file, category and the title with case and white space evened out."""
    even = F.trim(F.regexp_replace(F.lower(title), "\\s+", " "))
    return F.substring(F.sha2(F.concat_ws("|", file, category, even), 256), 1, 32)


def token_estimate(text: Column) -> Column:
    """characters by four, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / TOKEN_CHARS)).cast("long")


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line, numbered from 1; a last line end makes no further line."""
    body = F.regexp_replace(F.col(text), "\n\\z", "")
    return df.select(key, F.posexplode(F.split(body, "\n")).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line")


def chunk_body(whole: Column) -> Column:
    """A chunk's text: cut after MOST_CHARS with a mark that says so; null if it is too short without the white space around it."""
    body = F.when(F.length(whole) > MOST_CHARS, F.concat(F.substring(whole, 1, MOST_CHARS), F.lit(CUT))).otherwise(whole)
    return F.when(F.length(F.regexp_replace(whole, "^\\s+|\\s+$", "")) >= LEAST_CHARS, body)


def window_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """U3 for files without symbols: windows of CHUNK_LINES lines, built within the row: no shuffle.

    Windows under LEAST_CHARS characters (trimmed) are dropped, those over MOST_CHARS are cut."""
    rows = F.split(F.regexp_replace(F.col(text), "\n\\z", ""), "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size("l") - 1) / CHUNK_LINES).cast("int"))
    df = df.select(key, rows.alias("l"))
    df = df.select(key, F.size("l").alias("n"), F.explode(F.transform(starts, lambda i: F.struct((i * CHUNK_LINES + 1).alias("start_line"), F.array_join(F.slice("l", i * CHUNK_LINES + 1, CHUNK_LINES), "\n").alias("body")))).alias("c"))
    df = df.select(key, F.col("c.start_line").alias("start_line"), F.least(F.col("c.start_line") + (CHUNK_LINES - 1), F.col("n")).alias("end_line"), F.col("c.body").alias("whole"))
    kept = df.withColumn("body", chunk_body(F.col("whole"))).filter("body IS NOT NULL")
    return kept.select(key, "start_line", "end_line", "body", F.sha2(F.concat(F.col(key).cast("string"), F.lit(":"), "body"), 256).alias("content_hash"), token_estimate(F.col("body")).alias("token_estimate"))


def literal_search(df: DataFrame, key: str, text: str, names: DataFrame, per_name: int = HITS_PER_NAME, own: DataFrame | None = None) -> DataFrame:
    """SC7, W9 over `names` (ordinal, name): the first `per_name` lines (by key and line) that hold each literal; a line counts
    once per name. Rows whose key is among those of `own` are left out. Any number of names: they are searched for at once,
    and a task hands on `per_name` lines a name (more only where its lines fill its memory)."""
    if own is not None:
        df = df.join(own.select(key).distinct(), key, "left_anti")
    hits = first_hits(df.select(F.col(key).alias("key"), F.col(text).alias("text")), names.select(F.col("name").alias("pattern")), per_name)
    rows = hits.join(names.select("ordinal", F.col("name").alias("pattern")), "pattern")
    w = Window.partitionBy("ordinal").orderBy("key", "line_no")
    rows = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_name)
    return rows.select(F.col("key").alias(key), "line_no", "line", "ordinal", F.col("pattern").alias("name"), "rank")


def cross_references(files: DataFrame, names: DataFrame, own: DataFrame) -> DataFrame:
    """W9 over files (path, text), names (ordinal, name) and the change's own paths: where the rest of the code has the first
    MOST_NAMES names, until MOST_HITS are found."""
    asked = names.orderBy("ordinal").limit(MOST_NAMES)
    return searched_names(literal_search(files, "path", "text", asked, own=own))


def searched_names(hits: DataFrame) -> DataFrame:
    """Hits of the names that are searched at all: those before which fewer than MOST_HITS were found."""
    found = hits.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # MOST_NAMES rows
    return hits.join(F.broadcast(found.filter("true").withColumn("before", before).filter(F.col("before") < MOST_HITS).select("ordinal")), "ordinal")


def call_sites(df: DataFrame, key: str, text: str) -> DataFrame:
    """F8: called names with their number per document, keywords apart."""
    names = F.explode(F.regexp_extract_all(F.col(text), F.lit("([A-Za-z_][A-Za-z0-9_]*)\\("), F.lit(1)))
    calls = df.select(key, names.alias("name")).filter(~F.col("name").isin("if", "for", "while", "switch", "return", "catch", "function"))
    return calls.groupBy(key, "name").agg(F.count(F.lit(1)).alias("n"))


def script_blocks(df: DataFrame, key: str, html: str) -> DataFrame:
    """script blocks in order with their place, language by attribute, and length."""
    blocks = F.regexp_extract_all(F.col(html), F.lit("(?is)<script\\b([^>]*)>(.*?)</script>"), F.lit(2))
    attrs = F.regexp_extract_all(F.col(html), F.lit("(?is)<script\\b([^>]*)>(.*?)</script>"), F.lit(1))
    rows = df.select(key, F.posexplode(F.arrays_zip(attrs.alias("a"), blocks.alias("b"))).alias("ordinal", "s"))
    lang = F.when(F.col("s.a").rlike('lang=["\']ts["\']'), F.lit("typescript")).otherwise(F.lit("javascript"))
    return rows.select(key, "ordinal", lang.alias("lang"), F.length("s.b").cast("long").alias("n_chars"), F.sha2("s.b", 256).alias("body_sha"))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character, within the row."""
    chars = F.split(text, "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars))
    return F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def secrets(df: DataFrame, key: str, text: str) -> DataFrame:
    """S-SECRET: matches of our rules with a redacted value, P0 and security; assignments that aren't random are left out."""
    def matches(rule: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(rule).alias("rule"), v.alias("value")))

    found = F.concat(*[matches(n, p) for n, p in SECRET_RULES.items()])
    rows = df.select(key, F.posexplode(found).alias("ordinal", "s")).select(key, "ordinal", "s.*")
    rows = rows.filter((F.col("rule") != "assigned_hex") | (entropy(F.col("value")) >= SECRET_ENTROPY))
    redacted = F.concat(F.substring("value", 1, 4), F.lit("***"))
    return rows.select(key, "ordinal", "rule", redacted.alias("redacted"), F.lit("P0").alias("severity"), F.lit("security").alias("category"), F.lit("secret_scan").alias("detector"))


def risk_tags(df: DataFrame, key: str, text: Column) -> DataFrame:
    """tags whose pattern occurs, with the first match as evidence."""
    hits = F.array(*[F.struct(F.lit(t).alias("tag"), F.lower(F.regexp_extract(text, f"(?i)({p})", 1)).alias("evidence")) for t, p in RISK_RULES.items()])
    return df.select(key, F.explode(hits).alias("h")).select(key, "h.*").filter("evidence <> ''")


def suffix(path: Column) -> Column:
    """The lower-cased last suffix of a path's last part; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(path, "[^/](\\.[^./]+)$", 1))


def language(path: Column) -> Column:
    """P5: by the lower-cased last suffix."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[suffix(path)]


def skip_reason(path: Column, size: Column) -> Column:
    """The first limit that a file meets; null if it is selected."""
    large = F.lit(f"larger than {MOST_BYTES // 1024} KB")
    return F.when(suffix(path).isin(*BINARY), F.lit("binary file")).when(size > MOST_BYTES, large).when(size == 0, F.lit("empty file"))


#: Ignore rules that are handed to every task at a time.
RULES_AT_ONCE = 10_000


def ignore_reasons(files: DataFrame, rules: DataFrame) -> DataFrame:
    """P3 over (path) and (ordinal, pattern, source): the last rule that matches a path decides; one that starts with ! takes
    it back. Patterns without a slash match in any folder, those that end in one match all below; [a-z] and [!a-z] are classes
    of characters. Rules are broadcast RULES_AT_ONCE (about) at a time."""
    bare = F.regexp_replace("pattern", "^!", "")
    below = F.regexp_replace(bare, "/$", "")
    body = F.regexp_replace(F.regexp_replace(below, "^/", ""), "([.+()\\[\\]{}^$|\\\\])", "\\\\$1")
    # folders of any depth, then anything, then within a name; the first two wait behind marks that no pattern has
    for glob, mark in (("\\*\\*/", "\u0001"), ("\\*\\*", "\u0002"), ("\\*", "[^/]*"), ("\\?", "[^/]"), ("\u0001", "(?:.*/)?"), ("\u0002", ".*")):
        body = F.regexp_replace(body, glob, mark)
    for found, made in (("\\\\\\[(?:!|\\\\\\^)([^\\]/]+?)\\\\\\]", "(?!/)[^$1]"), ("\\\\\\[([^\\]/!\\\\][^\\]/]*?)\\\\\\]", "(?!/)[$1]")):
        body = F.regexp_replace(body, found, made)
    start = F.when(F.contains(below, F.lit("/")), F.lit("^")).otherwise(F.lit("^(?:.*/)?"))
    tail = F.when(F.endswith(bare, F.lit("/")), F.lit("/.*$")).otherwise(F.lit("(?:/.*)?$"))
    made = rules.select("ordinal", "source", F.startswith("pattern", F.lit("!")).alias("keeps"), F.concat(start, body, tail).alias("regex"))
    n = max(1, -(-rules.count() // RULES_AT_ONCE))
    paths = files.select("path").distinct()
    blocks = [paths.join(F.broadcast(made.filter(F.pmod(F.xxhash64("ordinal"), F.lit(n)) == i)), F.expr("path rlike regex")).select("path", "ordinal", "keeps", "source") for i in range(n)]
    hits = blocks[0] if n == 1 else reduce(DataFrame.unionByName, [materialise(b, "ignored") for b in blocks])
    last = hits.groupBy("path").agg(F.max_by(F.struct("keeps", "source"), "ordinal").alias("r"))
    why = F.when(~F.col("r.keeps"), F.concat(F.lit("ignored by rule '"), F.col("r.source"), F.lit("'")))
    return files.join(last, "path", "left").withColumn("ignored", why).drop("r")


def select_files(files: DataFrame, rules: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Each file's reason to be skipped (null if selected): a rule, else a limit; of `wanted` paths, those that
    aren't there are skipped for that."""
    found = ignore_reasons(files, rules).withColumn("reason", F.coalesce("ignored", skip_reason(F.col("path"), F.col("size")))).drop("ignored")
    if wanted is None:
        return found
    here = wanted.select("path").distinct().join(found.withColumn("here", F.lit(True)), "path", "left")
    return here.withColumn("reason", F.when(F.col("here").isNull(), F.lit("not present at this revision")).otherwise(F.col("reason"))).drop("here")


def ranked_hits(hits: DataFrame, own_language: str, most: int = MOST_HITS) -> DataFrame:
    """T7 over (path, line_no): hits in other languages first, then by path and line."""
    w = Window.orderBy(language(F.col("path")).eqNullSafe(F.lit(own_language)), "path", "line_no")
    return hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)  # a bounded list of names' hits


def glob_pattern(globs: list[str]) -> str:
    """fnmatch globs as one anchored pattern: * crosses folders, so **/x asks for a folder before x."""
    one = lambda g: "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in g)
    return "^(?:" + "|".join(one(re.sub(r"\*+", "*", g)) for g in globs) + ")$"


def is_application(path: Column, globs: list[str]) -> Column:
    """A path is application code unless a glob of the others matches it."""
    return ~path.rlike(glob_pattern(globs))
