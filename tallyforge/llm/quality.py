"""Quality rules: robust multivariate outliers per language and source, by minimum covariance determinant, regularised:
the determinant is that of the innermost documents' covariance (made consistent) plus a fixed diagonal of squared floors.

Every step is a DataFrame expression; nothing runs in Python on the executors."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import materialise

#: Characters that count as symbols, and the white space that ends a word.
SYMBOLS = "[#*$%&|<>]"
SPACES = "[\\x20\\x09-\\x0D]+"
#: Features are kept in whole steps of 1/4096, so that their sums don't depend on the order of rows.
STEP = 4096
#: Standard deviations added to each estimate (log words, log word length, log of 1 + the shares of symbols, repeated
#: lines and repeated words): what differs by less is no outlier, however alike the other documents are. Small enough that
#: each statistic can reject alone: at no scatter, shares of 0.32 (symbols) and 0.4 (lines, words) lie beyond CUT.
FLOORS = (0.1, 0.06, 0.05, 0.06, 0.06)
DIM = len(FLOORS)
#: Share of a group's documents that an estimate is made from, the fall of the log determinant that calls for another
#: concentration step, and the tail that is rejected.
SUPPORT = 0.75
TOLERANCE = 1e-2
TAIL = 1e-5
#: Models (under 400 bytes each) up to which they are broadcast; slices of each group's rows beyond.
BROADCAST_MODELS = 10_000
SALTS = 32
GROUP = ["lang_key", "source_key"]


def _chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution, by the series of the lower incomplete gamma function."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def _chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, k) < p else (lo, mid)
    return hi


#: Makes the covariance of the innermost SUPPORT of normal data that of all.
CONSISTENCY = SUPPORT / _chi2_cdf(_chi2_quantile(SUPPORT, DIM), DIM + 2)
CUT = _chi2_quantile(1 - TAIL, DIM)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (with a word) of each document.

    Arrays of one document at a time, without a shuffle. Hashes only tell texts without a repeated window of three words;
    the windows of all others are sorted as words to find which words the repeats cover."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col("lang_key"), F.col("source_key"), text.alias("body"))
    df = df.select(
        "doc_id",
        *GROUP,
        F.array_remove(F.split("body", SPACES), "").alias("words"),
        F.filter(F.split("body", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    last = F.size("words") - 3
    at = F.sequence(F.lit(0), last)
    window = lambda f: lambda i: f(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    hashes = F.transform(at, window(F.xxhash64))
    repeats = F.when(last >= 0, F.size(F.array_distinct(hashes)) <= last)
    df = df.withColumn("repeats", repeats)
    # words hold no spaces, so joined windows are equal where their words are
    joined = F.transform(at, lambda i: F.struct(window(lambda *w: F.concat_ws(" ", *w))(i).alias("h"), i.alias("i")))
    df = df.select(
        "doc_id",
        *GROUP,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("repeats"), F.sort_array(joined)).alias("placed"),
    )
    kept = ["doc_id", *GROUP, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    same = lambda p, j: (p["h"] == F.get("placed", j - 1)["h"]) | (p["h"] == F.get("placed", j + 1)["h"])
    again = F.filter("placed", lambda p, j: F.coalesce(same(p, j), (j > 0) & (p["h"] == F.get("placed", j - 1)["h"]), F.lit(False)))
    df = df.select(*kept, F.sort_array(F.transform(again, lambda p: p["i"])).alias("at"))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("before")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["before"])).alias("n"), i.alias("before")),
        lambda s: s["n"].cast("long"),
    )
    return df.select(*kept, F.coalesce(covered, F.lit(0)).alias("n_repeat_words"))


def _features(df: DataFrame) -> DataFrame:
    share = lambda a, b: F.log1p(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    words = F.greatest(F.col("n_words"), F.lit(1))
    all_five = (F.log(words), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"))
    return df.withColumns({f"x{i}": F.round(f * STEP).cast("long") for i, f in enumerate(all_five)})


def _quantiles(df: DataFrame, keys: list[str], bin_col: str, probs: list[float]) -> DataFrame:
    """Bins at which each group's count reaches a share, from partial counts; a group has few bins, whatever its size."""
    counts = df.groupBy(*keys, bin_col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumn("upto", F.sum("n").over(w.orderBy(bin_col))).withColumn("all", F.sum("n").over(w))
    return counts.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= p * F.col("all"), F.col(bin_col))).alias(f"q{k}") for k, p in enumerate(probs)])


def _cholesky(df: DataFrame) -> DataFrame:
    """From c{i}{j} (floors included): the factor l{i}{j} and the log determinant."""
    for i in range(DIM):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))  # noqa: B023
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    det = reduce(lambda a, b: a + b, [2 * F.log(F.col(f"l{i}{i}")) for i in range(DIM)])
    return df.withColumn("log_det", det).drop(*[f"c{i}{j}" for i in range(DIM) for j in range(i + 1)])


def _distance(df: DataFrame) -> DataFrame:
    """Add d2, the squared Mahalanobis distance, by forward substitution; drops the model's columns."""
    for i in range(DIM):
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), F.col(f"x{i}") / STEP - F.col(f"m{i}"))  # noqa: B023
        df = df.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    df = df.withColumn("d2", reduce(lambda a, b: a + b, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(DIM)]))
    return df.drop("log_det", *[f"y{i}" for i in range(DIM)], *[f"m{i}" for i in range(DIM)], *[f"l{i}{j}" for i in range(DIM) for j in range(i + 1)])


def _moments(df: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Means and covariances (times `scale`, floors added) from exact sums."""
    whole = lambda c: F.sum(c.cast("decimal(19,0)")).cast("double")
    sums = [whole(F.col(f"x{i}")).alias(f"s{i}") for i in range(DIM)]
    sums += [whole(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i in range(DIM) for j in range(i + 1)]
    df = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    mean = lambda i: F.col(f"s{i}") / F.col("n") / STEP

    def cov(i: int, j: int) -> Column:
        c = (F.col(f"p{i}{j}") / F.col("n") / STEP / STEP - mean(i) * mean(j)) * scale
        return c + FLOORS[i] ** 2 if i == j else c

    return df.select(*keys, *[mean(i).alias(f"m{i}") for i in range(DIM)], *[cov(i, j).alias(f"c{i}{j}") for i in range(DIM) for j in range(i + 1)])


def _with_model(x: DataFrame, model: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Join each row with its group's model. Few models are broadcast; many are copied to SALTS slices, over which a group's
    rows are spread, so that no group's rows meet in one task."""
    if few:
        return x.join(F.broadcast(model), GROUP, how)
    spread = x.withColumn("salt", F.pmod(F.xxhash64(*[f"x{i}" for i in range(DIM)]), F.lit(SALTS)).cast("int"))
    copies = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(copies, [*GROUP, "salt"], how).drop("salt")


def fit(stats: DataFrame) -> DataFrame:
    """A model per group: m0.., l00.., log_det, from all its rows x0...

    Two deterministic starts (medians with quartile scales, medians with the floors alone) each go through concentration
    steps: the SUPPORT of the rows nearest by the present estimate make the next, until the determinant falls no more. A
    step is only for the groups and starts whose determinant still fell; each keeps its smallest, and the start with the
    smaller one wins."""
    x = stats.select(*GROUP, *[f"x{i}" for i in range(DIM)])
    each = x.select(*GROUP, F.posexplode(F.array(*[F.floor(F.col(f"x{i}") / 16).cast("long") for i in range(DIM)])).alias("j", "bin"))
    q = _quantiles(each, [*GROUP, "j"], "bin", [0.25, 0.5, 0.75])
    at = lambda c, i: F.max(F.when(F.col("j") == i, F.col(c))) * 16 / STEP
    q = q.groupBy(*GROUP).agg(*[at("q1", i).alias(f"m{i}") for i in range(DIM)], *[(at("q2", i) - at("q0", i)).alias(f"w{i}") for i in range(DIM)])
    var = lambda i: F.pow(F.col(f"w{i}") / 1.349, F.lit(2)) * (1 - F.col("start")) + FLOORS[i] ** 2
    q = q.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    diagonal = [(var(i) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(DIM) for j in range(i + 1)]
    keys = [*GROUP, "start"]
    model = materialise(_cholesky(q.select(*keys, *[f"m{i}" for i in range(DIM)], *diagonal)), "model")
    few = model.count() <= BROADCAST_MODELS
    models: list[DataFrame] = []
    while True:
        near = _distance(_with_model(x, model, few)).withColumn("bin", F.floor(F.log1p("d2") * 512).cast("long")).drop("d2")
        inner = materialise(_quantiles(near, keys, "bin", [SUPPORT]), "support")
        inside = near.join(F.broadcast(inner) if few else inner, keys).filter(F.col("bin") <= F.col("q0"))
        # written before it is compared: else the comparison's condition is pushed down as one expression of the whole factor
        new = materialise(_cholesky(_moments(inside, keys, CONSISTENCY)), "model")
        if models:  # a later model of a group and start is there only if it is better than the one before
            before = model.select(*keys, F.col("log_det").alias("least"))
            better = new.join(F.broadcast(before) if few else before, keys).filter(F.col("log_det") < F.col("least") - TOLERANCE)
            new = materialise(better.drop("least"), "better")
        model = new
        # each turn lowers some group's determinant by TOLERANCE at least, and the floors bound it from below
        if model.isEmpty():
            break
        models.append(model)
    if not models:
        return model.drop("start")
    winner = F.min_by(F.struct(*[c for c in model.columns if c not in GROUP]), F.struct("log_det", "start"))
    return reduce(DataFrame.unionByName, models).groupBy(*GROUP).agg(winner.alias("b")).select(*GROUP, "b.*").drop("start")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    base_failed: under 50 words, or over half of the words lie in three-word windows found twice. Of the others, each
    language and source has its own robust centre and covariance of the logarithmic statistics; a document beyond the
    1 - TAIL quantile of the squared Mahalanobis distance isn't kept. distance is null where base_failed.

    Null and empty texts have no words and fail the base rules. Null languages or sources are one group. A group of one
    document is at its own centre and is kept. Ids may be null or repeated: rows stand for themselves (equal rows fare
    alike). A very long text is one array of words. Other columns are ignored; an empty table gives an empty result."""
    named = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("")).alias("lang_key"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source_key"),
    )
    stats = statistics(named)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = materialise(_features(stats.withColumn("base_failed", failed)), "statistics")
    model = materialise(fit(stats.filter("not base_failed")), "model")
    judged = _distance(_with_model(stats, model, model.count() <= BROADCAST_MODELS, "left"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUT, F.lit(False))
    distance = F.when(~F.col("base_failed"), F.sqrt("d2"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), distance.alias("distance"))
