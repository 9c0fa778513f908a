"""Event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.catalog import query
from tallyforge.sources import commits as C
from tallyforge.sources.store import shared_dir
from tallyforge.sources.tables import table
from tallyforge.streaming import events as S


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("props_json_rollup", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY event_type")
def props_json_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")  # cut payloads may be invalid JSON
    return log(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"))


@query(
    "tumbling_window_events",
    "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL",
)
def tumbling_window_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tumbling(log(spark, sf_dir), "ts", ["event_type"], "6 hours")


@query(
    "session_window_events",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT min(ts) AS session_start, user_id, count(*) AS n FROM s GROUP BY user_id, k""",
)
def session_window_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessions(log(spark, sf_dir), "ts", ["user_id"], "2 hours")


@query("event_sequence", "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq FROM events")
def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence numbers within a stream by arrival."""
    return log(spark, sf_dir).select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"))


@query("latest_run_events", "SELECT event_id, user_id AS review_id, CAST(event_id % 3 AS INT) AS run_id FROM events WHERE (user_id, event_id % 3) IN (SELECT user_id, max(event_id % 3) FROM events GROUP BY user_id)")
def latest_run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_run(log(spark, sf_dir).select("event_id", F.col("user_id").alias("review_id"), (F.col("event_id") % 3).cast("int").alias("run_id")))


@query("event_ndjson", "SELECT '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS value FROM events")
def event_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ndjson(log(spark, sf_dir).select("event_id", "event_type"))


@query(
    "delivered_events",
    """WITH e AS (SELECT user_id AS review_id, event_id % 3 AS run_id, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id) AS seq, CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'done' ELSE event_type END AS name, props AS payload FROM events),
    g AS (SELECT * FROM e WHERE NOT (review_id % 4 = 0 AND seq = 9)), t AS (SELECT *, coalesce(bool_or(name IN ('done', 'error', 'superseded')) OVER w, false) AS over, row_number() OVER (PARTITION BY review_id, run_id ORDER BY seq) AS place FROM g
      WINDOW w AS (PARTITION BY review_id, run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), k AS (SELECT review_id, run_id, seq, name, payload FROM t WHERE place = seq AND NOT over),
    n AS (SELECT review_id, max(run_id) AS newest FROM g GROUP BY review_id)
    SELECT * FROM k UNION ALL SELECT review_id, run_id, max(seq) + 1, 'superseded', 'a newer review replaced this one' FROM k JOIN n USING (review_id) WHERE run_id < newest GROUP BY review_id, run_id, newest HAVING NOT bool_or(name IN ('done', 'error', 'superseded'))""",
)
def delivered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, ST2: users' events as runs of a review, some with a gap, every third one twice."""
    i = F.col("event_id")
    seq = F.row_number().over(Window.partitionBy("user_id", i % 3).orderBy("ts", "event_id")).cast("long")
    e = log(spark, sf_dir).select("event_id", F.col("user_id").alias("review_id"), (i % 3).alias("run_id"), seq.alias("seq"), F.when((F.col("event_type") == "signup") & (i % 5 == 0), "done").otherwise(F.col("event_type")).alias("name"), F.col("props").alias("payload"))
    e = e.filter("NOT (review_id % 4 = 0 AND seq = 9)")
    return S.delivered(e.unionByName(e.filter("event_id % 3 = 0")).drop("event_id"))


@query(
    "review_commits",
    """WITH f AS (SELECT o_orderkey AS review_id, l_linenumber AS n, l_quantity AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
    SELECT o_orderkey AS review_id, CASE WHEN o_orderkey % 3 = 0 THEN 'again' ELSE 'first' END AS status, CAST(1 AS BIGINT) AS created_at, (SELECT count(*) FROM f WHERE f.review_id = o_orderkey AND (o_orderkey % 3 <> 0 OR n <= 2)) AS findings FROM orders""",
)
def review_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK5, ST7: orders as reviews and their lines as findings in one commit; every third again, with fewer findings; that batch twice."""
    tables = C.Tables(spark, shared_dir(spark, "reviews"), {"reviews": "review_id long, status string, created_at long", "findings": "review_id long, n int"})
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("review_id"), F.col("l_linenumber").cast("int").alias("n")).join(o, "review_id", "left_semi")
    C.save_reviews(tables, o.select("review_id", F.lit("first").alias("status"), F.lit(1).cast("long").alias("created_at")), lines, "review", 0)
    again = o.filter("review_id % 3 = 0")
    for _ in range(2):
        C.save_reviews(tables, again.select("review_id", F.lit("again").alias("status"), F.lit(2).cast("long").alias("created_at")), lines.filter("review_id % 3 = 0 AND n <= 2"), "review", 1)
    state = tables.state()
    n = tables.read("findings", state).groupBy("review_id").agg(F.count(F.lit(1)).alias("findings"))
    return tables.read("reviews", state).join(n, "review_id", "left").fillna(0, ["findings"])
