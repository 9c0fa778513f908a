"""Jobs, comments, polling marks and table upserts: state transitions as whole-table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Attempts allowed by kind of job.
ATTEMPTS = {"review": 1, "index": 3, "github_review": 1, "github_comment": 3}


def claim(jobs: DataFrame) -> DataFrame:
    """The oldest queued job starts."""
    first = jobs.filter("status = 'queued'").agg(F.min("job_id").alias("job_id"))
    return jobs.join(F.broadcast(first), "job_id", "left_semi").withColumn("status", F.lit("running")).withColumn("attempts", F.col("attempts") + 1)


def finish(jobs: DataFrame) -> DataFrame:
    """ST8, ST9: running jobs end: done without an error, queued again while attempts are left, else failed."""
    most = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in ATTEMPTS.items()], F.lit(1))
    ended = F.when(F.col("error").isNull(), F.lit("done")).when(F.col("attempts") < most, F.lit("queued")).otherwise(F.lit("failed"))
    return jobs.withColumn("status", F.when(F.col("status") == "running", ended).otherwise(F.col("status")))


def recover(jobs: DataFrame) -> DataFrame:
    """ST9: jobs that a crash left running are queued again while attempts are left, else failed with a reason."""
    most = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in ATTEMPTS.items()], F.lit(1))
    left = F.col("status") == "running"
    again = F.col("attempts") < most
    return jobs.withColumns({
        "status": F.when(left & again, F.lit("queued")).when(left, F.lit("failed")).otherwise(F.col("status")),
        "error": F.when(left & ~again, F.lit("interrupted by a restart; not repeated automatically")).otherwise(F.col("error")),
    })


def upsert_reviews(old: DataFrame, new: DataFrame) -> DataFrame:
    """SK5: a review's new row replaces the stored one, whose created_at survives."""
    born = old.select("review_id", F.col("created_at").alias("born"))
    j = new.join(born, "review_id", "left").withColumn("created_at", F.coalesce("born", "created_at")).drop("born")
    return old.join(new.select("review_id"), "review_id", "left_anti").unionByName(j.select(old.columns))


def allocate(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A22, SK7: new rows get the keys after the largest there is, in order, in slices: no task holds them all."""
    top = old.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("top"))
    parts = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = new.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranged = ranged.withColumns({"slice": F.shiftright("place", 33), "at": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = ranged.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("slice", before.alias("before"))
    j = ranged.join(F.broadcast(shift), "slice").join(F.broadcast(top))  # one row
    return j.withColumn(key, F.col("top") + F.col("before") + F.col("at") + 1).select(key, *[c for c in new.columns if c != key])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SK3: insert-or-ignore: the first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SK3 against a stored table."""
    return old.unionByName(keep_first(new, keys, order).join(old.select(keys), keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """SK4, SK7: latest version wins."""
    both = old.unionByName(new)
    cols = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), version).alias("r")).select(key, "r.*")


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SK1, R6: all rows of the keys that come anew are replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """SC4, J13, J14: added, modified, deleted and renamed paths between two snapshots (path, blob)."""
    a = before.select(F.col("path").alias("old_path"), F.col("blob").alias("old_blob"))
    j = a.join(after, F.col("old_path") == F.col("path"), "full")
    changed = j.filter("not (old_path is not null and path is not null and old_blob <=> blob)")
    gone = changed.filter("path is null").select("old_path", "old_blob")
    new = changed.filter("old_path is null").select("path", "blob")
    once = lambda df, p, b: df.withColumn("k", F.row_number().over(Window.partitionBy(b).orderBy(p)))
    g, n = once(gone, "old_path", "old_blob").withColumnRenamed("k", "gk"), once(new, "path", "blob").withColumnRenamed("k", "nk")
    moved = g.join(n, (F.col("old_blob") == F.col("blob")) & (F.col("gk") == F.col("nk"))).select("path", "old_path", F.lit("R").alias("status"))
    edited = changed.filter("path is not null and old_path is not null").select("path", F.lit(None).cast("string").alias("old_path"), F.lit("M").alias("status"))
    added = new.join(moved, "path", "left_anti").select("path", F.lit(None).cast("string").alias("old_path"), F.lit("A").alias("status"))
    removed = gone.join(moved.select("old_path"), "old_path", "left_anti").select(F.col("old_path").alias("path"), F.lit(None).cast("string").alias("old_path"), F.lit("D").alias("status"))
    return moved.unionByName(edited).unionByName(added).unionByName(removed)


def comment_marks(comments: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ST4, ST5, A20: comments above their thread's mark, and the new marks. A thread seen first only gets its mark."""
    j = comments.join(marks, "number", "left")
    fresh = j.filter(F.col("mark").isNotNull() & (F.col("id") > F.col("mark"))).drop("mark")
    top = comments.groupBy("number").agg(F.max("id").alias("top"))
    both = marks.join(top, "number", "full").select("number", F.greatest("mark", "top").alias("mark"))
    return fresh, both


def skip_review(pulls: DataFrame, forks: bool = False) -> DataFrame:
    """Why a pull request isn't reviewed: it is a draft, or comes from a fork (one whose repository is gone counts as
    such); null if it is reviewed."""
    fork = F.lit(not forks) & ~F.col("head_repo").eqNullSafe(F.col("base_repo"))
    return pulls.withColumn("skipped", F.when(F.col("draft"), F.lit("draft")).when(fork, F.lit("fork")))


def wants_review(pulls: DataFrame, state: DataFrame, events: tuple[str, ...] = ("opened", "synchronize")) -> DataFrame:
    """Pulls that aren't skipped, whose head hasn't been reviewed and whose event (opened at first sight, synchronize
    after a review) is asked for."""
    j = pulls.filter("skipped is null").join(state.select("number", "reviewed_sha"), "number", "left")
    event = F.when(F.col("reviewed_sha").isNull(), F.lit("opened")).otherwise(F.lit("synchronize"))
    return j.filter(~F.col("reviewed_sha").eqNullSafe(F.col("head_sha")) & event.isin(*events)).select(*pulls.columns, event.alias("event"))


def merged_counts(before: DataFrame, now: DataFrame) -> DataFrame:
    """ST6: the counts to remember: the present ones, and those of comments that weren't seen this time."""
    return before.join(now.select("comment_id", "kind"), ["comment_id", "kind"], "left_anti").unionByName(now)


def command(body: Column, name: str) -> Column:
    """What a comment asks of `name`: review, explain, other, or null without a mention."""
    after = F.trim(F.regexp_extract(body, f"(?is)@{name}(?:[^\\w-](.*))?$", 1))
    mentioned = body.rlike(f"(?i)@{name}([^\\w-]|$)")
    return F.when(~mentioned, F.lit(None)).when(after.rlike("(?i)^review\\b"), F.lit("review")).when(after.rlike("(?i)^explain\\b"), F.lit("explain")).otherwise(F.lit("other"))


def reaction_deltas(before: DataFrame, now: DataFrame) -> DataFrame:
    """Reactions that rose, per comment and kind; comments that weren't known count from zero."""
    j = now.join(before.withColumnRenamed("count", "was"), ["comment_id", "kind"], "left")
    return j.select("comment_id", "kind", (F.col("count") - F.coalesce("was", F.lit(0))).alias("delta")).filter("delta > 0")
