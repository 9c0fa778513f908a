"""Budgets over ordered items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def break_at_first_miss(df: DataFrame, unit: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Items of each unit until the first that doesn't fit. Costs aren't negative, so a running sum says the same."""
    w = Window.partitionBy(unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(cost).over(w).cast("long")).filter(F.col("used") <= budget)


def skip_and_continue(df: DataFrame, unit: str, order: str, cost: str, budget: int) -> DataFrame:
    """Items of each unit that fit when those that don't are skipped: an ordered fold, not a running sum.

    A unit's items are one review's candidates (bounded by the context's own limits), folded within the row."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{dict(df.dtypes)[order]}>").alias("kept"))
    fold = F.aggregate(
        items,
        start,
        lambda s, x: F.when(s["used"] + x["c"] <= budget, F.struct((s["used"] + x["c"]).alias("used"), F.concat(s["kept"], F.array(x["o"])).alias("kept"))).otherwise(s),
    )
    return df.groupBy(unit).agg(fold.alias("f")).select(unit, F.col("f.used").alias("used"), F.explode_outer("f.kept").alias(order))


def truncating_budget(df: DataFrame, unit: str, order: list[str], text: str, budget: int, least: int = 400) -> DataFrame:
    """Texts until the budget; the one that crosses it is cut if `least` characters remain, the rest go."""
    w = Window.partitionBy(unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    out = df.withColumn("left", left.cast("long"))
    fits = F.length(text) <= F.col("left")
    return out.filter(fits | (F.col("left") >= least)).withColumn(text, F.when(fits, F.col(text)).otherwise(F.substring(F.col(text), F.lit(1), F.col("left").cast("int")))).drop("left")


#: Scores of names that teams give their instructions, of terms in other names, folders that hold none, suffixes of texts.
STRONG_NAMES = {
    "claude.md": 10, "agents.md": 10, "agent.md": 9, ".cursorrules": 9, "copilot-instructions.md": 9, "conventions.md": 8, "contributing.md": 8, "contributing": 7, "style.md": 8, "styleguide.md": 8,
    "style-guide.md": 8, "architecture.md": 7, "spec.md": 7, "code_review.md": 8, "code-review.md": 8, "engineering.md": 6, "standards.md": 7,
}
FUZZY_TERMS = {"convention": 6, "guideline": 6, "style": 5, "standard": 5, "handbook": 5, "contributing": 6, "architecture": 4, "spec": 4, "review": 4, "instruction": 6}
SKIPPED_FOLDERS, TEXT_SUFFIXES = ("node_modules/", "vendor/", "third_party/", ".github/workflows/"), (".md", ".markdown", ".txt", ".rst", "")
#: Fixed value: the least score of a pinned file.
PINNED = 12


def instruction_score(path: Column, pinned: Column | None = None) -> Column:
    """F11 in halves: a name's own score, else the best of the terms in it; the root and documentation folders count for it,
    depth against it; no score for other names, suffixes and folders. A pinned file has PINNED at least."""
    name = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    suffix = F.regexp_extract(name, "^.+(\\.[^.]+)$", 1)
    stem = F.regexp_replace(F.regexp_replace(name, "(?<=.)\\.[^.]+$", ""), "[^a-z]+", " ")
    strong = F.coalesce(*[F.when(name == k, F.lit(2 * v)) for k, v in STRONG_NAMES.items()], F.lit(0))
    fuzzy = F.greatest(*[F.when(F.contains(stem, F.lit(k)), F.lit(2 * v)).otherwise(0) for k, v in FUZZY_TERMS.items()])
    named = F.when(strong > 0, strong).otherwise(fuzzy)
    depth = F.size(F.split(path, "/")) - 1
    score = named + F.when(depth == 0, 6).otherwise(0) + F.when(path.rlike("^(docs|\\.github)/"), 2).otherwise(0) - F.least(depth, F.lit(4))
    skipped = path.rlike("|".join(x.replace(".", "\\.") for x in SKIPPED_FOLDERS)) | ~suffix.isin(*TEXT_SUFFIXES) | (named == 0)
    out = F.when(skipped, 0).otherwise(score).cast("long")
    return out if pinned is None else F.when(pinned, F.greatest(out, F.lit(2 * PINNED))).otherwise(out)
