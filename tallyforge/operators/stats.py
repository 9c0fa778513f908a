"""Operational analytics over the call log, jobs and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tally(df: DataFrame, by: str) -> DataFrame:
    """A2, A3: rows per value, nulls apart."""
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A1: rows of several tables in one result."""
    return reduce(DataFrame.union, [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n")) for name, df in tables.items()])


def spend(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, cost in cents and tokens, per key or in all (one row, zeros on an empty log)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), total("cost_cents"), total("tokens_in"), total("tokens_out"), total("tokens_cached"))


def spend_order(calls: DataFrame) -> DataFrame:
    """Prompts with a name by cost, dearest first; a row per prompt."""
    w = Window.orderBy(F.desc("cost_cents"), "prompt")
    return spend(calls.filter("prompt is not null"), ["prompt"]).withColumn("place", F.row_number().over(w))


def suppressed_count(found: DataFrame) -> DataFrame:
    """A4: findings in all and suppressed ones, one row."""
    return found.agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("status") == "suppressed").alias("suppressed"))


def cache_rate(calls: DataFrame) -> DataFrame:
    """Cached share of input tokens in thousandths, zero without any; embedding calls and those without a
    prompt don't count, a call without a cached number counts as read in full."""
    used = calls.filter("prompt is not null and prompt <> 'embeddings'")
    rate = F.when(F.sum("tokens_in") > 0, F.floor(1000 * F.coalesce(F.sum("tokens_cached"), F.lit(0)) / F.sum("tokens_in"))).otherwise(0)
    return used.agg(F.coalesce(rate, F.lit(0)).cast("long").alias("cache_rate"))


def latest_answer(calls: DataFrame) -> DataFrame:
    """The newest good answer per request, version and review; null keys are equal to each other."""
    good = calls.filter("ok and response is not null")
    w = Window.partitionBy("request_hash", "version", "review_id").orderBy(F.desc("call_id"), F.desc("response"))
    return good.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def reuse(requests: DataFrame, calls: DataFrame) -> DataFrame:
    """M9: each request with the answer it may reuse, if any; reused answers cost nothing."""
    a = latest_answer(calls).select(*[F.col(c).alias(f"a_{c}") for c in ("request_hash", "version", "review_id", "call_id", "response")])
    on = (F.col("request_hash") == F.col("a_request_hash")) & F.col("version").eqNullSafe(F.col("a_version")) & F.col("review_id").eqNullSafe(F.col("a_review_id"))
    return requests.join(a, on, "left").select(*requests.columns, F.col("a_call_id").alias("reused"), F.col("a_response").alias("response"))


def budget_prefix(calls: DataFrame, limit_cents: int, limit_tokens: int | None = None, deadline: int | None = None) -> DataFrame:
    """M8: calls of each review that still run: those before which less than the limit was spent, so one may overshoot; of money, and
    where asked for of tokens (read and written) and of seconds since the review's first call (`at`). Calls that share an id
    run cheapest first."""
    w = Window.partitionBy("review_id").orderBy("call_id", "cost_cents").rowsBetween(Window.unboundedPreceding, -1)
    out = calls.withColumn("spent_before", F.coalesce(F.sum("cost_cents").over(w), F.lit(0)).cast("long"))
    runs = F.col("spent_before") < limit_cents
    if limit_tokens is not None:
        out = out.withColumn("tokens_before", F.coalesce(F.sum(F.col("tokens_in") + F.col("tokens_out")).over(w), F.lit(0)).cast("long"))
        runs &= F.col("tokens_before") < limit_tokens
    if deadline is not None:
        out = out.withColumn("elapsed", F.col("at") - F.min("at").over(Window.partitionBy("review_id")))
        runs &= F.col("elapsed") < deadline
    return out.filter(runs)


def retention(df: DataFrame, ts: str, cutoff: str) -> DataFrame:
    """SK10: rows at or after the cutoff; the comparison reaches the scan."""
    return df.filter(F.col(ts) >= F.lit(cutoff).cast("timestamp_ntz"))


def prompt_digest(prompts: DataFrame) -> DataFrame:
    """sha256 over the prompts' own digests in order of name; prompts are a handful."""
    digests = F.array_sort(F.collect_list(F.struct("name", F.sha2("body", 256).alias("d"))))
    return prompts.agg(F.sha2(F.array_join(F.transform(digests, lambda x: x["d"]), ""), 256).alias("digest"))
