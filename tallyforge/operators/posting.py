"""What a review posts: places in the patch, markers, what is new, what closes."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Columns of prose that a reader of a folded block sees without scrolling (fixed value).
WRAPPED = 88


def commentable(lines: DataFrame) -> DataFrame:
    """P20: new lines of a patch that a comment can stand on."""
    return lines.filter("new_line is not null").select("path", F.col("new_line").alias("line")).distinct()


def anchors(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Each finding's first location whose file can take comments, on the nearest such line (the smaller of two).

    Locations meet lines on the path; findings without any keep a null place."""
    at = findings.select("finding_id", F.posexplode("locations").alias("ordinal", "l")).select("finding_id", "ordinal", F.col("l.file").alias("path"), F.col("l.line").alias("wanted"))
    met = at.join(commentable(lines), "path")
    best = met.groupBy("finding_id").agg(F.min(F.struct("ordinal", F.abs(F.col("line") - F.col("wanted")).alias("away"), "line", "path")).alias("b"))
    return findings.join(best, "finding_id", "left").select("finding_id", F.col("b.path").alias("path"), F.col("b.line").alias("line"))


def markers(comments: DataFrame, tag: str) -> DataFrame:
    """Fingerprints that comments carry in a marker; the last comment of a fingerprint counts."""
    mark = F.regexp_extract("body", f"<!-- {tag}:([0-9a-f]{{32}})(:resolved)? -->", 1)
    done = F.regexp_extract("body", f"<!-- {tag}:([0-9a-f]{{32}})(:resolved)? -->", 2) != ""
    found = comments.select("comment_id", mark.alias("fingerprint"), done.alias("resolved")).filter("fingerprint <> ''")
    return found.groupBy("fingerprint").agg(F.max("comment_id").alias("comment_id"), F.bool_or("resolved").alias("resolved"))


def posting_plan(findings: DataFrame, posted: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Findings to post (fresh), and posted ones to close (withdrawn by feedback, or fixed)."""
    fresh = findings.join(posted.select("fingerprint"), "fingerprint", "left_anti").select("fingerprint", F.lit("post").alias("action"))
    gone = posted.filter("not resolved").join(findings.select("fingerprint"), "fingerprint", "left_anti")
    by_hand = withdrawn.select("fingerprint").distinct().withColumn("by_hand", F.lit(True))
    closing = gone.join(by_hand, "fingerprint", "left").select("fingerprint", F.when(F.col("by_hand"), F.lit("withdrawn")).otherwise(F.lit("fixed")).alias("action"))
    return fresh.unionByName(closing)


def location_label(file: Column, start: Column, end: Column) -> Column:
    """file, file:a or file:a-b."""
    return F.when(start.isNull(), file).when(end.isNull() | (start == end), F.concat(file, F.lit(":"), start.cast("string"))).otherwise(F.concat(file, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))


def suggestion_fits(patch: Column, start: Column, end: Column) -> Column:
    """A patch has as many lines as the range it replaces."""
    return F.size(F.split(F.regexp_replace(patch, "\n\\z", ""), "\n")) == end - start + 1


def report(findings: DataFrame) -> DataFrame:
    """SK9: a Markdown report per review; a review's findings are capped before they get here."""
    line = F.concat(F.lit("- **"), "severity", F.lit("** "), "title", F.lit(" ("), location_label(F.col("file"), F.col("line_start"), F.col("line_end")), F.lit(")"))
    listed = F.array_sort(F.collect_list(F.struct("level", "finding_id", line.alias("t"))))
    return findings.groupBy("review_id").agg(F.concat(F.lit("# Review\n\n"), F.array_join(F.transform(listed, lambda x: x["t"]), "\n")).alias("markdown"))


@F.pandas_udf(ArrayType(StringType()))
def wrapped(text: pd.Series) -> pd.Series:
    """Prose in lines of WRAPPED columns, its white space made one space first."""
    return text.map(lambda t: textwrap.wrap(" ".join((t or "").split()), width=WRAPPED))


def comment_bodies(findings: DataFrame, tag: str) -> DataFrame:
    """The Markdown of a finding's comment: (finding_id, markdown) of (finding_id, fingerprint, severity, category, title, body, patch,
    conf in thousandths, locations of file, line_start, line_end, inline).

    The patch is a suggestion where the comment is inline and the patch has the cited lines' number. An inline comment also has the
    finding as folded plain text. The percentage rounds halves to the even one. Nulls count as empty."""
    first = F.try_element_at("locations", F.lit(1))
    patch = F.regexp_replace(F.coalesce("patch", F.lit("")), "\\s+\\z", "")
    start, end = first["line_start"], F.coalesce(F.nullif(first["line_end"], F.lit(0)), first["line_start"])
    # the count is that of the patch as it came: only one line end at its end is none of its lines
    fits = F.coalesce((start > 0) & suggestion_fits(F.col("patch"), start, end), F.lit(False))
    fence = F.when(F.col("inline") & fits, F.lit("```suggestion\n")).otherwise(F.lit("```\n"))
    some = F.length(F.coalesce("patch", F.lit(""))) > 0
    block = F.when(some, F.concat(F.lit("\n\n"), fence, patch, F.lit("\n```"))).otherwise(F.lit(""))
    label = lambda x: location_label(x["file"], F.nullif(x["line_start"], F.lit(0)), F.nullif(x["line_end"], F.lit(0)))
    brief = F.concat(
        F.array(F.lit("Fix this in the repository. Change nothing else."), F.lit("")),
        F.coalesce(F.transform("locations", label), F.array().cast("array<string>")),
        F.array(F.concat(F.lit("["), "severity", F.lit(" "), "category", F.lit("] "), "title")),
        wrapped("body"),
        F.when(some, F.array(F.lit("suggested replacement:"), patch)).otherwise(F.array().cast("array<string>")),
    )
    folded = F.concat(F.lit("\n\n<details>\n<summary>For a coding agent</summary>\n\n```\n"), F.array_join(brief, "\n"), F.lit("\n```\n\n</details>"))
    over = F.col("conf") % 10
    percent = F.expr("conf div 10") + F.when((over > 5) | ((over == 5) & (F.expr("conf div 10") % 2 == 1)), 1).otherwise(0)
    note = F.concat(F.lit("\n\n<sub>"), "category", F.lit(" · confidence "), percent.cast("string"), F.lit("%"), F.when(F.col("inline"), F.lit(" · reply if this is wrong")).otherwise(F.lit("")), F.lit("</sub>"))
    place = F.when(F.col("inline"), F.lit("")).otherwise(F.concat(F.lit("`"), location_label(first["file"], F.nullif(start, F.lit(0)), F.lit(None)), F.lit("`\n")))
    head = F.concat(F.lit("**"), "severity", F.lit(" — "), "title", F.lit("**\n\n"), "body")
    mark = F.concat(F.lit(f"\n<!-- {tag}:"), "fingerprint", F.lit(" -->"))
    known = findings.na.fill("", ["severity", "category", "title", "body", "fingerprint"]).na.fill({"conf": 0, "inline": False})
    return known.select("finding_id", F.concat(F.coalesce(place, F.lit("")), head, block, F.when(F.col("inline"), folded).otherwise(F.lit("")), note, mark).alias("markdown"))


def comment_ranges(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """(finding_id, path, line, start_line) of findings with locations of file, line_start, line_end: the anchor is a location's
    end, and the comment spans its lines where both ends can take comments."""
    end = lambda x: F.coalesce(F.nullif(x["line_end"], F.lit(0)), x["line_start"], F.lit(0))
    ends = findings.select("finding_id", F.transform("locations", lambda x: F.struct(x["file"].alias("file"), end(x).alias("line"))).alias("locations"))
    at = anchors(ends, lines).join(findings.select("finding_id", "locations"), "finding_id")
    spot = F.try_element_at(F.filter("locations", lambda x: x["file"] == F.col("path")), F.lit(1))
    asked = at.withColumn("start_line", F.when((end(spot) == F.col("line")) & (spot["line_start"] > 0) & (spot["line_start"] < F.col("line")), spot["line_start"]))
    open_lines = commentable(lines).select("path", F.col("line").alias("start_line"), F.lit(True).alias("there"))
    return asked.join(open_lines, ["path", "start_line"], "left").select("finding_id", "path", "line", F.when(F.col("there"), F.col("start_line")).alias("start_line"))


def settled_lines(plan: DataFrame, comments: DataFrame, head: Column) -> DataFrame:
    """A line for each posted finding that closes: its comment's title, linked where the comment has an address, and whether it
    was withdrawn or fixed, at the commit `head` (a column of `plan`). Comments (fingerprint, body, url)."""
    found = F.regexp_extract(F.coalesce("body", F.lit("")), "\\*\\*P\\d — (.+?)\\*\\*", 1)
    title = F.when(found != "", found).otherwise(F.lit("a finding"))
    named = F.when(F.length("url") > 0, F.concat(F.lit("["), title, F.lit("]("), "url", F.lit(")"))).otherwise(title)
    closing = plan.filter("action <> 'post'").select("fingerprint", "action", head.alias("head"))
    state = F.when(F.col("action") == "withdrawn", F.col("action")).otherwise(F.concat(F.lit("fixed in `"), F.substring("head", 1, 7), F.lit("`")))
    return closing.join(comments.select("fingerprint", "body", "url"), "fingerprint").select("fingerprint", F.concat(F.lit("- "), named, F.lit(" — "), state).alias("line"))


def review_events(reviews: DataFrame) -> DataFrame:
    """What is posted for (review_id, verdict, last_verdict, comments): nothing without comments, unless the verdict has become
    request_changes since the last review."""
    asks = F.coalesce(F.col("verdict") == "request_changes", F.lit(False))
    blocking = asks & ~F.col("verdict").eqNullSafe(F.col("last_verdict"))
    posted = (F.coalesce("comments", F.lit(0)) > 0) | blocking
    event = F.when(posted, F.when(asks, F.lit("REQUEST_CHANGES")).otherwise(F.lit("COMMENT")))
    return reviews.select("review_id", blocking.alias("blocking"), posted.alias("posted"), event.alias("event"))
