"""Scalar expressions: digests, templates, embedding texts, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters of a finding's body that are embedded.
EMBEDDED_BODY = 1200


def request_hash(*parts: Column) -> Column:
    """Digest of a request's canonical JSON; fields are given in sorted order."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def review_id(base: Column, head: Column, diff: Column) -> Column:
    """the default id of a review, from what it reviews."""
    return F.concat(F.lit("rev-"), F.substring(F.sha2(F.to_json(F.array(base, head, diff)), 256), 1, 12))


def finding_id(review: Column, fingerprint: Column) -> Column:
    """a finding's id within its review."""
    return F.concat(review, F.lit(":"), F.substring(fingerprint, 1, 12))


def fill_template(template: Column, slots: dict[str, Column]) -> Column:
    """{{slot}} by its value; slots that aren't known are removed."""
    out = template
    for name, value in slots.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return F.regexp_replace(out, "\\{\\{[A-Za-z_]+\\}\\}", "")


def chunk_text(path: Column, start: Column, end: Column, body: Column) -> Column:
    """What is embedded of a chunk."""
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\n"), body)


def finding_text(category: Column, file: Column, title: Column, body: Column) -> Column:
    """What is embedded of a finding; no line numbers, so that it survives moves."""
    return F.concat(category, F.lit(" in "), file, F.lit(": "), title, F.lit("\n"), F.substring(body, 1, EMBEDDED_BODY))


def repository(url: Column) -> Column:
    """host/owner/name of an address in any of its forms, lower-cased."""
    bare = F.regexp_replace(F.lower(F.trim(url)), "^(?:[a-z+]+://)?(?:[^@/]*@)?", "")
    return F.regexp_replace(F.regexp_replace(bare, ":(?:[0-9]+/)?", "/"), "(?:\\.git)?/*$", "")


def diff_path(header: Column) -> Column:
    """The path of a file header, without its a/ or b/; null for no file."""
    name = F.trim(F.regexp_extract(header, "^(?:---|\\+\\+\\+) ([^\\t]*)", 1))
    return F.nullif(F.nullif(F.regexp_replace(name, "^[ab]/", ""), F.lit("/dev/null")), F.lit(""))


def suffix_language_group(path: Column) -> Column:
    """languages that see each other's names; by the suffix as it is written."""
    s = F.regexp_extract(path, "(\\.[^./]+)$", 1)
    return F.when(s.isin(".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".vue"), "web").when(s == ".py", "python").when(s == ".go", "go")


def dotted_module(path: Column) -> Column:
    """a path as a module name."""
    return F.regexp_replace(F.regexp_replace(path, "\\.[^./]+$", ""), "/", ".")


def context_label(parts: dict[str, Column]) -> Column:
    """The names of the parts that a context has, joined by +."""
    return F.concat_ws("+", *[F.when(has, F.lit(name)) for name, has in parts.items()])
