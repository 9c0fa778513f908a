"""Queries over answers landed from lists: followed pages, a polled stream, open threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query
from tallyforge.sources import landing as L
from tallyforge.sources.commits import Tables
from tallyforge.sources.store import shared_dir
from tallyforge.sources.tables import table

API = "https://api.h"


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def order_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a list with one order a page; every eleventh customer's first link leaves the host, every thirteenth's
    second page fails."""
    c, n = F.col("o_custkey"), F.col("n")
    base = _text(f"{API}/customers/", c, "/orders")
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n", "count(*) OVER (PARTITION BY o_custkey) AS m")
    away = F.when((c % 11 == 0) & (n == 0), F.lit("https://other.h")).otherwise(F.lit(API))
    link = F.when(n + 1 < F.col("m"), _text("<", away, "/customers/", c, "/orders?page=", n + 2, '>; rel="next"'))
    return o.select(
        F.lit(1).cast("long").alias("fetch"), F.col("o_orderkey").alias("no"), (n == 0).alias("begins"), F.when(n == 0, base).otherwise(_text(base, "?page=", n + 1)).alias("url"),
        F.when((c % 13 == 0) & (n == 1), 500).otherwise(200).alias("status"), link.alias("link"), F.lit(None).cast("string").alias("etag"), F.to_json(F.array("o_orderkey")).alias("body"),
    )


@query(
    "paged_lists",
    f"""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders)
    SELECT '{API}/customers/' || c || '/orders' AS list, CAST(n AS INT) AS page, k AS o_orderkey, CASE WHEN m > 20 AND c % 11 <> 0 THEN 'cut' ELSE 'whole' END AS state
    FROM o WHERE n < 20 AND (c % 11 <> 0 OR n = 0) AND (c % 13 <> 0 OR m = 1 OR c % 11 = 0)""",
)
def paged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC10: the orders of each customer's list, at most twenty pages of it."""
    got = L.items(L.follow(order_answers(spark, sf_dir)))
    return got.select("list", "page", F.col("item").cast("long").alias("o_orderkey"), "state")


@query(
    "polled_lists",
    f"""WITH c AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n FROM customer WHERE c_nationkey % 3 = 2 OR c_acctbal >= 0)
    SELECT '{API}/nations/' || k || '/customers' AS list, CAST(CASE WHEN k % 3 = 2 THEN 2 ELSE 1 END AS BIGINT) AS fetch, CAST(n // 10 AS INT) AS page, CAST(n % 10 AS INT) AS item_no, c_custkey FROM c WHERE n < 200""",
)
def polled_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC10: lists of the nations' customers, polled twice as a stream. The second time a third of the lists is unchanged by status, a
    third by ETag."""
    k, n = F.col("c_nationkey"), F.col("n")
    base = _text(f"{API}/nations/", k, "/customers")

    def fetch(number: int, where: str) -> DataFrame:
        c = table(spark, sf_dir, "customer").filter(where).selectExpr("c_nationkey", "c_custkey", "row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i")
        page = c.groupBy("c_nationkey", F.expr("CAST(i div 10 AS INT) AS n")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("i", "c_custkey"))), lambda x: x["c_custkey"])).alias("body"), F.max("i").alias("i"))
        last = page.groupBy("c_nationkey").agg(F.max("n").alias("last"))
        old = (F.lit(number) == 2) & (k % 3 == 0)
        return page.join(last, "c_nationkey").select(
            F.lit(number).cast("long").alias("fetch"), n.cast("long").alias("no"), (n == 0).alias("begins"), F.when(n == 0, base).otherwise(_text(base, "?page=", n)).alias("url"), F.when(old, 304).otherwise(200).alias("status"),
            F.when(n < F.col("last"), _text("<", base, "?page=", n + 1, '>; rel="next"')).alias("link"), F.when(k % 3 == 2, _text("e", F.lit(number))).otherwise(F.lit("e1")).alias("etag"), "body",
        )

    at = shared_dir(spark, "landing")
    tables = Tables(spark, f"{at}/tables", L.POLLED)
    for number, where in ((1, "c_acctbal >= 0"), (2, "true")):
        # a list's answers are in one file, as poll() wants it
        fetch(number, where).repartition("fetch", F.regexp_extract("url", "nations/(\\d+)", 1)).write.mode("append").json(f"{at}/answers")
        L.poll(L.response_stream(spark, f"{at}/answers"), tables, f"{at}/checkpoint")
    return tables.read("items").select("list", "fetch", "page", "item_no", F.col("item").cast("long").alias("c_custkey"))


@query(
    "open_threads",
    f"SELECT DISTINCT '{API}/pulls/' || conv_id AS url, turn * 2 + 1 AS comment_id, 't' || conv_id || '-' || turn AS thread_id FROM conversations WHERE turn % 3 <> 1",
)
def open_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer per conversation, its turns as threads, every third of them resolved."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    node = F.struct(
        _text("t", F.col("conv_id"), "-", F.col("turn")).alias("id"), (F.col("turn") % 3 == 1).alias("isResolved"),
        F.struct(F.array(F.struct((F.col("turn") * 2 + 1).alias("databaseId"))).alias("nodes")).alias("comments"),
    )
    body = F.col("nodes")
    for name in ("nodes", "reviewThreads", "pullRequest", "repository", "data"):
        body = F.struct(body.alias(name))
    answers = t.groupBy("conv_id").agg(F.collect_list(node).alias("nodes"))  # the turns of one conversation
    return L.open_threads(answers.select(_text(f"{API}/pulls/", F.col("conv_id")).alias("url"), F.to_json(body).alias("body")))
