"""Landed answers of a code host's lists: pages followed by their links, lists that changed by their ETag, open threads.

What fetches writes a row per answer: the number of the fetch, the answer's ordinal in it, whether it begins a list, the URL that
was asked, status, `link` and `etag` headers, body. Nothing here calls a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.sources.commits import Tables, commit_batches
from tallyforge.sources.store import materialise

RESPONSES = "fetch long, no long, begins boolean, url string, status int, link string, etag string, body string"
#: Pages of a list that are read.
MAX_PAGES = 20
#: A list's items as they stand in the tables that `poll` keeps.
POLLED = {"marks": "list string, fetch long, etag string", "items": "list string, fetch long, page int, item_no int, item string"}
THREADS = (
    "data struct<repository: struct<pullRequest: struct<reviewThreads: struct<nodes: array<struct<id: string, isResolved: boolean,"
    " comments: struct<nodes: array<struct<databaseId: long>>>>>>>>>, errors array<struct<message: string>>"
)


def next_url(link: Column, url: Column) -> Column:
    """The next page that a `link` header names; null where it names none or one at another scheme or host."""
    found = F.regexp_extract(link, '<([^>]+)>;\\s*rel="next"', 1)
    site = lambda u: F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    return F.when((found != "") & (site(found) == site(url)), found)


def _success(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def _answers(responses: DataFrame) -> DataFrame:
    """The answer that counts of each URL of a fetch, the last one, as a repeated request's is: (name, fetch, url, begins: whether any of
    them does, no, status, next, body). `name` is a hash, by which rows sort sooner than by URLs that begin alike."""
    rows = responses.filter("fetch IS NOT NULL AND url IS NOT NULL").withColumn("name", F.xxhash64("fetch", "url"))
    same = Window.partitionBy("name", "fetch", "url")
    numbered = rows.withColumns({"nth": F.row_number().over(same.orderBy(F.desc("no"))), "begins": F.coalesce(F.max("begins").over(same), F.lit(False))})
    told = lambda c: F.when(F.col("no").isNotNull(), c)
    following = F.when(_success(F.col("status")), next_url(F.col("link"), F.col("url")))
    return numbered.filter("nth = 1").select("name", "fetch", "url", "begins", "no", told(F.col("status")).alias("status"), told(following).alias("next"), told(F.col("body")).alias("body"))


def follow(responses: DataFrame, lists: DataFrame | None = None, limit: int = MAX_PAGES) -> DataFrame:
    """SC10: the pages of each list: (fetch, list, page from 0, url, status, body, state). `lists` (fetch, list) leaves out others.

    A list's state is 'cut' if it goes on beyond `limit` pages, 'broken' if a page is missing or isn't a success (a missing one has no
    status), else 'whole'. Links in a circle are read up to the limit. Answers are read and written once, with a number each; one join
    tells which number each link leads to (a missing page has the negative one of the answer that names it). Links of 2^k steps are then
    joined with themselves, so that twenty pages take five rounds whatever the number of lists; only numbers travel until the bodies
    join at the end."""
    known = materialise(_answers(responses).withColumn("id", F.monotonically_increasing_id()), "answers")
    heads = known.filter("begins").select("fetch", F.col("url").alias("list"), F.col("id").alias("head"), _success(F.col("status")).alias("ok"))
    if lists is not None:
        heads = heads.join(lists.select("fetch", "list"), ["fetch", "list"], "left_semi")
    links = known.filter("next IS NOT NULL").select(F.xxhash64("fetch", "next").alias("name"), "fetch", F.col("next").alias("url"), F.col("id").alias("at"))
    led = links.join(known.select("name", "fetch", "url", "id", _success(F.col("status")).alias("ok")), ["name", "fetch", "url"], "left")
    jump, step = materialise(led.select("at", F.coalesce("id", -1 - F.col("at")).alias("to"), F.coalesce("ok", F.lit(False)).alias("ok")), "jumps"), 1
    pages = heads.select("head", F.col("head").alias("at"), F.lit(0).alias("page"), "ok")
    while step <= limit:  # one page beyond the limit tells that a list is cut
        reached = pages.drop("ok").join(jump, "at").select("head", F.col("to").alias("at"), (F.col("page") + step).alias("page"), "ok")
        pages = materialise(pages.unionByName(reached.filter(F.col("page") <= limit)), "pages")
        step *= 2
        if step <= limit:
            jump = materialise(jump.select("at", F.col("to").alias("by")).join(jump.select(F.col("at").alias("by"), "to", "ok"), "by").select("at", "to", "ok"), "jumps")
    own = Window.partitionBy("head")
    bad = F.max((F.col("page") < limit) & ~F.col("ok")).over(own)
    state = F.when(bad, "broken").when(F.max("page").over(own) >= limit, "cut").otherwise("whole").alias("state")
    held = pages.select("head", "at", "page", state).filter(F.col("page") < limit).join(heads.drop("ok"), "head")
    missing = F.col("at") < 0
    held = held.select("fetch", "list", "page", "state", missing.alias("missing"), F.when(missing, -1 - F.col("at")).otherwise(F.col("at")).alias("id"))
    there = lambda c: F.when(~F.col("missing"), F.col(c)).alias(c)
    url = F.when(F.col("missing"), F.col("next")).otherwise(F.col("url")).alias("url")
    return held.join(known.select("id", "url", "next", "status", "body"), "id").select("fetch", "list", "page", url, there("status"), there("body"), "state")


def items(pages: DataFrame) -> DataFrame:
    """The items of lists that aren't broken: (fetch, list, page, item_no, item as JSON, state); a body that is no array has none."""
    listed = F.from_json("body", "array<string>")
    rows = pages.filter("state <> 'broken'").select("fetch", "list", "page", F.posexplode(listed).alias("item_no", "item"), "state")
    return rows.filter("item IS NOT NULL")


def fresh(responses: DataFrame, marks: DataFrame) -> DataFrame:
    """Beginnings of lists whose answer is new: (fetch, list, etag). It isn't where the host says so (304) or the ETag is that of the
    answer before it, which `marks` (list, fetch, etag) hold from earlier."""
    ok = F.col("status").between(200, 299)
    first = responses.filter("begins AND url IS NOT NULL").groupBy("fetch", F.col("url").alias("list")).agg(F.max_by(F.struct("status", "etag"), "no").alias("a"))
    now = first.select("fetch", "list", "a.status", F.when(F.col("a.status").between(200, 299), F.col("a.etag")).alias("etag"))
    old = marks.select(F.lit(-1).cast("long").alias("fetch"), "list", F.lit(304).alias("status"), "etag")
    before = F.last("etag", ignorenulls=True).over(Window.partitionBy("list").orderBy("fetch").rowsBetween(Window.unboundedPreceding, -1))
    rows = now.unionByName(old).withColumn("before", before)
    return rows.filter(ok & ~F.coalesce(F.col("etag") == F.col("before"), F.lit(False))).select("fetch", "list", "etag")


def poll(stream: DataFrame, tables: Tables, checkpoint: str, limit: int = MAX_PAGES) -> None:
    """What there is of a stream of answers, into `tables` of POLLED: each list's newest items and its ETag, in one commit per batch.

    A list that is broken leaves both as they are, so that the next fetch is read again. The answers of a list's fetch must come
    in one file, as only they are sure to be in one batch."""

    def change(batch: DataFrame, now: dict[str, DataFrame]) -> dict[str, DataFrame]:
        pages = materialise(follow(batch, limit=limit), "followed")
        whole = pages.filter("page = 0 AND state <> 'broken'").select("fetch", F.col("list").alias("url"))
        new = materialise(fresh(batch.join(whole, ["fetch", "url"], "left_semi"), now["marks"]), "fresh")
        done = new.groupBy("list").agg(F.max("fetch").alias("fetch"))
        mark = new.join(done, ["fetch", "list"]).select("list", "fetch", "etag")
        got = items(pages).join(done, ["fetch", "list"], "left_semi").select("list", "fetch", "page", "item_no", "item")
        kept = {t: now[t].join(done, "list", "left_anti") for t in POLLED}
        return {"marks": kept["marks"].unionByName(mark), "items": kept["items"].unionByName(got)}

    commit_batches(stream, tables, checkpoint, "poll", change)


def response_stream(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """Landed answers as a stream of JSON lines."""
    return spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", files).json(folder)


def open_threads(responses: DataFrame) -> DataFrame:
    """The unresolved threads of each answer, by the id of a comment: (url, comment_id, thread_id). A comment in two threads is
    the last one's; an answer with errors has none."""
    got = responses.select("url", F.from_json("body", THREADS).alias("r")).filter("r.errors IS NULL OR size(r.errors) = 0")
    nodes = got.select("url", F.posexplode("r.data.repository.pullRequest.reviewThreads.nodes").alias("n", "t")).filter("t IS NOT NULL AND NOT coalesce(t.isResolved, false)")
    comments = nodes.select("url", "n", F.col("t.id").alias("thread_id"), F.posexplode("t.comments.nodes").alias("m", "c"))
    named = comments.select("url", F.col("c.databaseId").alias("comment_id"), "thread_id", "n", "m").filter("comment_id <> 0")
    return named.groupBy("url", "comment_id").agg(F.max_by("thread_id", F.struct("n", "m")).alias("thread_id"))
