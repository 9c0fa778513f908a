"""Whole steps of a review, composed of the other operators, and what its answers and reports look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators import context as C
from tallyforge.operators import findings as O
from tallyforge.operators import memory as M
from tallyforge.operators import text as T

#: Least tokens of a unit's context, tokens that must be left for similar code.
LEAST_BUDGET, LEAST_FOR_SIMILAR = 4000, 500


def finalize(findings: DataFrame, matched: DataFrame, verdicts: DataFrame, stats: DataFrame, floor: int = 5, most: int = O.MAX_FINDINGS) -> DataFrame:
    """M7: merge, memory, calibration, verification, policy, in this order: every finding that the merge left, but for those
    under the policy's floors, with its status: kept, downranked, suppressed or rejected.

    matched: (finding_id, similarity, reason); verdicts as for verify_fold, which sees only findings that need a check."""
    merged = O.merge_findings(findings, floor, most)
    known = O.memory_ladder(merged.join(matched.select("finding_id", "similarity", "reason"), "finding_id", "left")).drop("similarity", "reason")
    suppressed = known.filter("status = 'suppressed'")
    kept = M.calibrate(known.filter("status <> 'suppressed'"), stats).drop("stated_conf").withColumnRenamed("status", "memory")
    asked = O.needs_check(kept.withColumn("detector", F.lit(None).cast("string"))).filter("needs_check").select("finding_id")
    folded = O.verify_fold(kept, verdicts.join(asked, "finding_id", "left_semi"))
    passed = O.demote_advice(O.policy_floor(folded.filter("status = 'kept'"), floor)).withColumn("status", F.col("memory"))
    return passed.unionByName(folded.filter("status = 'rejected'")).drop("memory").unionByName(suppressed)


def summary(final: DataFrame, coverage: DataFrame, fail_on: int = 1) -> DataFrame:
    """One row per review: verdict, score and confidence of what is open, and how many were suppressed."""
    open_ = final.filter("status in ('kept', 'downranked')")
    gone = final.filter("status = 'suppressed'").groupBy("review_id").agg(F.count(F.lit(1)).alias("suppressed"))
    found = open_.groupBy("review_id").agg(F.count(F.lit(1)).alias("findings"))
    out = O.verdict(open_, coverage, fail_on).join(O.score(open_, coverage), "review_id").join(O.overall_confidence(open_, coverage), "review_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.join(found, "review_id", "left").join(gone, "review_id", "left").select("review_id", "verdict", "score", "confidence", zero("findings"), zero("suppressed"))


def resolve_diff(posted: DataFrame, selected: DataFrame) -> DataFrame:
    """Files to review: of a posted diff those that are text and have hunks; of a diff of two snapshots those that the
    selection left. Both are (diff_id, path, binary, hunk); the result names each file once."""
    own = posted.filter("not binary and hunk is not null").select("diff_id", "path")
    return own.unionByName(selected.filter("reason is null").select("diff_id", "path")).distinct()


def unit_files(units: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of the files that are in a unit; a file of two units is in both."""
    return units.select("unit", "path").distinct().join(lines, "path")


def unit_budget(total: int, units: Column) -> Column:
    """Tokens of one unit's context."""
    return F.greatest(F.lit(LEAST_BUDGET), F.floor(F.lit(total) / units)).cast("long")


def build_context(parts: DataFrame, budget: int) -> DataFrame:
    """M10 over (unit, kind, place, name, text): what a unit's context holds, in the order diff, siblings, cross-language,
    call graph, similar code, and the names that didn't fit.

    The diff and cross-language hits always go in; siblings and the call graph as long as they fit, similar code only where
    enough is left. kind is one of those five; a row is marked `kept` or not."""
    order = F.when(F.col("kind") == "diff", 0).when(F.col("kind") == "sibling", 1).when(F.col("kind") == "xref", 2).when(F.col("kind") == "call", 3).otherwise(4)
    each = parts.withColumns({"tokens": F.floor(F.length("text") / T.TOKEN_CHARS).cast("long"), "step": order})
    free = F.col("step").isin(0, 2)
    fixed = each.filter(free).groupBy("unit").agg(F.sum("tokens").cast("long").alias("fixed"))
    j = each.join(fixed, "unit", "left").withColumn("fixed", F.coalesce("fixed", F.lit(0)))
    limited = j.filter(~free)
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("unit").orderBy("step", "place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = limited.withColumn("used", F.col("fixed") + before + F.col("tokens"))
    fits = (F.col("used") <= budget) & ((F.col("step") < 4) | (budget - F.col("used") + F.col("tokens") > LEAST_FOR_SIMILAR))
    cols = ["unit", "kind", "place", "name", "tokens"]
    return j.filter(free).select(*cols, F.lit(True).alias("kept")).unionByName(used.select(*cols, fits.alias("kept")))


def applicable(rules: DataFrame, paths: DataFrame) -> DataFrame:
    """Instruction files that hold for a path: those of the root for all, others for their own folder and below.

    A path meets a file by equality with one of its folders, not by comparing all with all."""
    folder = F.regexp_extract("file", "^(.*/)?[^/]*$", 1)
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))
    return paths.select("path", F.explode(above).alias("folder")).join(rules.withColumn("folder", folder), "folder").drop("folder")


def rebuilt(answers: DataFrame, originals: DataFrame) -> DataFrame:
    """R11 over merged answers (review_id, ordinal, title, ...) and the findings before: an answer's missing fields are those
    of the last original with the same title, case and white space apart; what the answer can't know is the original's."""
    even = lambda c: F.trim(F.regexp_replace(F.lower(F.trim(c)), "\\s+", " "))
    last = originals.groupBy("review_id", even("title").alias("key")).agg(F.max_by(F.struct("file", "category", "conf", "level"), "finding_id").alias("o"))
    j = answers.filter(F.length(F.coalesce("title", F.lit(""))) > 0).withColumn("key", even("title")).join(last, ["review_id", "key"], "left")
    level = F.coalesce(F.when(F.upper("severity").isin(*O.SEVERITIES), F.substring("severity", 2, 1).cast("int")), F.lit(3))
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return j.select(
        "review_id", "ordinal", F.trim("title").alias("title"), F.coalesce(blank("file"), "o.file", F.lit("unknown")).alias("file"), F.coalesce(blank("category"), "o.category", F.lit("bug")).alias("category"),
        level.alias("level"), F.coalesce("conf", "o.conf", F.lit(500)).cast("long").alias("conf"), F.coalesce("o.level", level).alias("model_level"),
    )


def read_locations(raw: Column, file: Column, start: Column, end: Column) -> Column:
    """An answer's locations that name a file; without any, the one place that the answer itself names."""
    kept = F.filter(raw, lambda x: F.length(F.coalesce(x["file"], F.lit(""))) > 0)
    return F.when(F.size(F.coalesce(kept, F.array().cast(kept_type()))) > 0, kept).otherwise(F.array(F.struct(file.alias("file"), start.alias("line_start"), end.alias("line_end"))))


def kept_type() -> str:
    return "array<struct<file: string, line_start: long, line_end: long>>"


def tool_result(blocks: DataFrame) -> DataFrame:
    """R19 over (call_id, ordinal, type, input, text): per call, the arguments of its last tool use (an object, or an object
    that came as a string; else an empty one) and all its texts put together."""
    inner = F.coalesce(F.get_json_object(F.concat(F.lit('{"x":'), F.col("input"), F.lit("}")), "$.x"), F.col("input"))
    good = F.when(inner.rlike("(?s)^\\s*\\{.*\\}\\s*$") & F.try_parse_json(inner).isNotNull(), F.trim(inner)).otherwise(F.lit("{}"))
    uses = blocks.filter("type = 'tool_use'").groupBy("call_id").agg(F.max_by(good, "ordinal").alias("arguments"))
    texts = F.array_sort(F.collect_list(F.when(F.col("type") == "text", F.struct("ordinal", F.coalesce("text", F.lit("")).alias("text")))))
    said = blocks.groupBy("call_id").agg(F.array_join(F.transform(texts, lambda x: x["text"]), "").alias("said"))
    return said.join(uses, "call_id", "left").withColumn("arguments", F.coalesce("arguments", F.lit("{}")))


def thread_finding(comments: DataFrame, found: DataFrame, tag: str) -> DataFrame:
    """The finding that a reply is about: the head of its thread carries the fingerprint, its pull request the review."""
    heads = comments.select(F.col("number"), F.col("comment_id").alias("head"), F.regexp_extract("body", f"<!-- {tag}:([0-9a-f]{{32}})", 1).alias("fingerprint")).filter("fingerprint <> ''")
    asked = comments.select("number", "comment_id", F.coalesce("in_reply_to", "comment_id").alias("head"))
    place = found.select("fingerprint", F.col("review_id"), "finding_id")
    j = asked.join(heads, ["number", "head"]).withColumn("review_id", F.concat(F.lit("pr-"), F.col("number").cast("string")))
    return j.join(place, ["fingerprint", "review_id"]).select("number", "comment_id", "finding_id")


def own_names(units: DataFrame, symbols: DataFrame) -> DataFrame:
    """What a unit itself is called: its paths, then the qualified names of their symbols."""
    paths = units.select("unit", "path", F.lit(0).alias("step"), F.col("path").alias("name"))
    named = units.select("unit", "path").join(symbols.select("path", "qualified_name"), "path").select("unit", "path", F.lit(1).alias("step"), F.col("qualified_name").alias("name"))
    return paths.unionByName(named).distinct()


def unit_risks(names: DataFrame, reached: DataFrame, rules: dict[str, str] | None = None, least: int = 8) -> DataFrame:
    """Each unit's tags with the first of its own names that shows them; and a wide blast radius."""
    rules = rules or T.RISK_RULES
    hits = F.filter(F.array(*[F.struct(F.lit(t).alias("tag"), F.col("name").rlike(f"(?i){p}").alias("hit")) for t, p in rules.items()]), lambda x: x["hit"])
    each = names.select("unit", "step", "path", "name", F.explode(hits).alias("h"))
    first = each.groupBy("unit", F.col("h.tag").alias("tag")).agg(F.min(F.struct("step", "path", "name")).alias("f")).select("unit", "tag", F.col("f.name").alias("evidence"))
    wide = reached.filter(F.col("reached") >= least).select("unit", F.lit("blast_radius").alias("tag"), F.concat(F.col("reached").cast("string"), F.lit(" symbols depend on this change")).alias("evidence"))
    return first.unionByName(wide)


def changed_paths(files: DataFrame) -> DataFrame:
    """A change's paths with those they had before."""
    return files.select("diff_id", "path").unionByName(files.filter("old_path is not null").select("diff_id", F.col("old_path").alias("path"))).distinct()


def digest_lines(files: DataFrame) -> DataFrame:
    """a line per changed file with its status and how much was added and removed."""
    line = F.concat("status", F.lit(" "), "path", F.lit(" (+"), F.col("added").cast("string"), F.lit(" -"), F.col("removed").cast("string"), F.lit(")"))
    return files.select("diff_id", "path", line.alias("line"))


def brief(found: DataFrame) -> DataFrame:
    """A line per finding, and whether it is a note on security outside the application."""
    line = F.concat(F.lit("- ["), "severity", F.lit("] "), "file", F.lit(": "), "title", F.lit(" (confidence "), F.format_string("%d.%02d", F.expr("(conf + 5) div 1000"), F.expr("(conf + 5) div 10 % 100")), F.lit(")"))
    return found.withColumns({"brief": line, "note": F.coalesce((F.col("category") == "security") & ~F.col("app_code"), F.lit(False))})


def finding_body(found: DataFrame) -> DataFrame:
    """The Markdown of one finding: its level and title, its body, and a suggested patch if it has one."""
    patch = F.when(F.length(F.coalesce("patch", F.lit(""))) > 0, F.concat(F.lit("\n\n```suggestion\n"), F.col("patch"), F.lit("\n```"))).otherwise(F.lit(""))
    return found.withColumn("markdown", F.concat(F.lit("**"), "severity", F.lit("** "), "title", F.lit("\n\n"), "body", patch))


def as_json(found: DataFrame, fields: list[str]) -> DataFrame:
    """A finding as JSON, nulls included, as events and the read interface give it."""
    return found.select("finding_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def rules_signature(rules: DataFrame) -> DataFrame:
    """F21 over active rules (a team's, so few): 16 hex digits of the sha256 of all ids and texts, in their order."""
    listed = F.array_sort(F.collect_list(F.struct(-F.col("hits"), "rule_id", F.concat("rule_id", F.lit(":"), "body").alias("t"))))
    return rules.filter("active").agg(F.substring(F.sha2(F.array_join(F.transform(listed, lambda x: x["t"]), "|"), 256), 1, 16).alias("signature"))


def conventions(rules: DataFrame, stored: DataFrame, heading: str = "TEAM CONVENTIONS:\n") -> DataFrame:
    """The block of conventions: the stored one while its signature is that of the rules, else the plain list."""
    listed = F.array_sort(F.collect_list(F.struct(-F.col("hits"), "rule_id", F.concat("rule_id", F.lit(": "), "body").alias("t"))))
    plain = rules.filter("active").agg(F.concat(F.lit(heading), F.array_join(F.transform(listed, lambda x: x["t"]), "\n")).alias("plain"))
    one = rules_signature(rules).join(plain)  # one row each
    j = one.join(stored.select("signature", F.col("block").alias("kept")), "signature", "left")
    return j.select("signature", F.coalesce("kept", "plain").alias("block"), F.col("kept").isNotNull().alias("reused"))


def flat_config(config: DataFrame) -> DataFrame:
    """R35, P25 over (section, key, value, source): dotted keys; what is secret shows only that it is set."""
    secret = F.col("key").rlike("(?i)key|token|secret|password")
    shown = F.when(secret, F.when(F.length(F.coalesce("value", F.lit(""))) > 0, F.lit("set")).otherwise(F.lit("unset"))).otherwise(F.col("value"))
    return config.select(F.concat_ws(".", "section", "key").alias("key"), shown.alias("value"), "source")


def question(found: DataFrame) -> DataFrame:
    """What a second check is asked about a finding."""
    places = F.array_join(F.transform("locations", lambda x: F.concat(x["file"], F.lit(":"), x["line"].cast("string"))), ", ")
    text = F.concat(F.lit("severity: "), "severity", F.lit("\ncategory: "), "category", F.lit("\nlocations: "), places, F.lit("\ntitle: "), "title")
    return found.select("finding_id", text.alias("question"))


def eval_report(cases: DataFrame) -> DataFrame:
    """A17 over (case_id, hit, missed, extra, notes): recall in thousandths (1000 without expectations), findings beyond
    those expected per case in thousandths, and the distinct notes in order."""
    notes = F.array_sort(F.array_distinct(F.flatten(F.collect_list("notes"))))
    return cases.agg(
        F.coalesce(F.expr("1000 * sum(hit) div nullif(sum(hit) + sum(missed), 0)"), F.lit(1000)).cast("long").alias("recall"),
        F.coalesce(F.expr("1000 * sum(extra) div count(1)"), F.lit(0)).cast("long").alias("noise"),
        notes.alias("degraded"),
    )


def instruction_sections(files: DataFrame, budget: int, most: int = 24_000) -> DataFrame:
    """Instruction files by score (higher first, then path), each cut to `most` characters, until the budget."""
    scored = files.withColumns({"rank": -C.instruction_score(F.col("path")), "text": F.substring("text", 1, most)}).filter("rank < 0")
    return C.truncating_budget(scored, "review_id", ["rank", "path"], "text", budget).drop("rank")


def in_order(found: DataFrame) -> DataFrame:
    """A review's findings by severity, then by id, numbered."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("review_id").orderBy("severity", "finding_id")))


def outline(symbols: DataFrame) -> DataFrame:
    """T4: a file's symbols by their first line (the longer one first), numbered."""
    return symbols.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("start_line", F.desc("end_line"), "symbol_id")))


def innermost_first(overlaps: DataFrame) -> DataFrame:
    """T5: symbols that overlap a span by their length, shortest first, numbered per span."""
    w = Window.partitionBy("path", "lo", "hi").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "symbol_id")
    return overlaps.withColumn("place", F.row_number().over(w))


def attention(points: DataFrame, most: int = 2) -> DataFrame:
    """The first points to watch of each review's summary."""
    return points.withColumn("place", F.row_number().over(Window.partitionBy("review_id").orderBy("ordinal"))).filter(F.col("place") <= most)


def kept_streams(streams: DataFrame, most: int = 64) -> DataFrame:
    """The newest streams by when they began; older ones go. A server's streams, not their events."""
    top = streams.orderBy(F.desc("started"), F.desc("stream_id")).limit(most)
    return streams.join(F.broadcast(top.select("stream_id")), "stream_id", "left_semi")


def with_spend(summaries: DataFrame, calls: DataFrame) -> DataFrame:
    """What each review cost: zeros for one without calls."""
    sums = calls.groupBy("review_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("cost_cents", "tokens_in", "tokens_out", "tokens_cached")])
    j = summaries.join(sums, "review_id", "left")
    return j.select(*summaries.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in sums.columns if c != "review_id"])


def embedding_usage(replies: DataFrame) -> DataFrame:
    """Tokens of an embedding call: those of the prompt, else all."""
    return replies.withColumn("tokens_in", F.coalesce(F.nullif("prompt_tokens", F.lit(0)), "total_tokens", F.lit(0)).cast("long"))


def redacted(calls: DataFrame, most_request: int = 200_000, most_response: int = 400_000) -> DataFrame:
    """What the call log keeps: bearer tokens and keys blotted out, payloads cut (so they may no longer be JSON)."""
    blot = lambda c: F.regexp_replace(c, "(?i)(bearer |api[_-]?key\\W{1,4})[A-Za-z0-9._-]{8,}", "$1***")
    return calls.withColumns({"request": F.substring(blot("request"), 1, most_request), "response": F.substring(blot("response"), 1, most_response)})


def state_of(state: DataFrame, prefix: str) -> DataFrame:
    """Entries of a key-value state under a prefix, without it."""
    return state.filter(F.startswith("key", F.lit(prefix))).withColumn("key", F.substring("key", len(prefix) + 1, 1 << 20))


def reaction_feedback(deltas: DataFrame, placed: DataFrame, weight10: int = 3) -> DataFrame:
    """Reactions that rose on a finding's comment as feedback on it: thumbs up accept, thumbs down say false positive."""
    said = F.when(F.col("kind") == "+1", F.lit("accept")).when(F.col("kind") == "-1", F.lit("false_positive"))
    j = deltas.withColumn("action", said).filter("action is not null").join(placed, "comment_id")
    return j.select("fingerprint", "action", (F.col("delta") * weight10).cast("long").alias("weight10"), F.lit("reaction").alias("reason"))


def rule_table(rules: DataFrame) -> DataFrame:
    """A line per active rule: id, text, author, hits."""
    line = F.concat("rule_id", F.lit(" | "), "body", F.lit(" | "), F.coalesce("author", F.lit("-")), F.lit(" | "), F.col("hits").cast("string"))
    return rules.filter("active").select("rule_id", line.alias("line"))


def retired(rules: DataFrame, gone: DataFrame) -> DataFrame:
    """Rules taken back stay, inactive."""
    mark = gone.select("rule_id").distinct().withColumn("gone", F.lit(True))
    return rules.join(mark, "rule_id", "left").withColumn("active", F.col("active") & F.col("gone").isNull()).drop("gone")


def exit_code(found: DataFrame, fail_on: int = 1) -> DataFrame:
    """1 if any finding is at fail_on or worse."""
    return found.agg(F.coalesce(F.max((F.col("level") <= fail_on).cast("int")), F.lit(0)).alias("code"))


def hash_embedding(text: Column, width: int = 16) -> Column:
    """U4: a stand-in for an embedding service: words hashed to signed places, normalised; a text without words is all zeros."""
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  a value that is used many times is made once
    sign = lambda h: F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1).otherwise(-1)
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))
    signed = F.transform(words, lambda w: once(F.xxhash64(w), lambda h: (F.pmod(h, F.lit(width)).cast("int") + 1) * sign(h)))
    count = lambda at, i: F.when(at.isNotNull(), F.size(at) - F.size(F.array_remove(at, i)))
    raw = once(signed, lambda at: F.array(*[(count(at, i) - count(at, -i)).cast("double") for i in range(1, width + 1)]))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return once(raw, lambda v: once(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))))


def normalised(vector: Column) -> Column:
    """a vector of length one; zeros stay as they are."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def intents(comments: DataFrame, answers: DataFrame, known: tuple[str, ...] = ("feedback", "rule", "explain", "review", "other")) -> DataFrame:
    """What a comment asks for, by the answer to its request; without an answer, or with an unknown one, other."""
    keyed = comments.withColumn("request_hash", F.sha2("body", 256))
    j = keyed.join(answers.select("request_hash", "intent"), "request_hash", "left")
    return j.withColumn("intent", F.when(F.col("intent").isin(*known), F.col("intent")).otherwise(F.lit("other"))).drop("request_hash")


def prompts(shipped: DataFrame, overrides: DataFrame) -> DataFrame:
    """U8 over (name, body, slots) and (name, mode, body): an override replaces a prompt or is added below; a prompt that
    then lacks a slot it must have is marked invalid."""
    o = overrides.select("name", "mode", F.col("body").alias("other"))
    j = shipped.join(o, "name", "left")
    body = F.when(F.col("mode") == "replace", F.col("other")).when(F.col("mode") == "append", F.concat("body", F.lit("\n\n"), "other")).otherwise(F.col("body"))
    j = j.withColumn("body", body)
    return j.select("name", "body", F.forall("slots", lambda s: F.contains(F.col("body"), F.concat(F.lit("{{"), s, F.lit("}}")))).alias("valid"))


def context_label(df: DataFrame) -> DataFrame:
    """What a finding's reviewer had: the diff, and what else was there."""
    part = lambda c, name: F.when(F.col(c), F.lit(name))
    return df.withColumn("label", F.concat_ws("+", F.lit("diff"), part("has_calls", "call graph"), part("has_similar", "retrieved code"), part("was_cut", "truncated")))
