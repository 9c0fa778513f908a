"""Tables that change together: data goes to folders of its own, then one manifest names what each table is.

A manifest's number is taken by creating its file, which only one writer can do (the store must refuse to create a file that
exists, as HDFS does). Who finds the number taken reads the new state and does its change again. Readers see the last
manifest that is whole, so a writer that dies leaves nothing but folders that no manifest names."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How often a change is done again because another writer was first.
TRIES = 8


class Taken(Exception):
    """Another writer has that number."""


class Tables:
    """Tables under `root`, with given schemas."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]) -> None:
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at = self._path(f"{self.root}/manifests")
        if not self._store.exists(at):
            return []
        return sorted(int(m[1]) for s in self._store.listStatus(at) if (m := re.fullmatch(r"(\d{12})\.json", s.getPath().getName())))

    def _read(self, number: int) -> dict | None:
        """A manifest; none if its writer died over it."""
        rows = self.spark.read.option("wholetext", "true").text(f"{self.root}/manifests/{number:012d}.json").collect()
        try:
            return json.loads(rows[0].value)
        except (IndexError, ValueError):
            return None

    def state(self, number: int | None = None) -> dict:
        """The manifest `number`, or the last whole one: its number, the folder of each table, and the last batch of each writer."""
        for n in reversed(self._numbers() if number is None else [number]):
            if (found := self._read(n)) is not None:
                return found | {"number": n}
        return {"number": 0, "tables": {}, "batches": {}}

    def read(self, table: str, state: dict | None = None) -> DataFrame:
        """A table as of a state; empty before its first commit."""
        at = (state or self.state())["tables"].get(table)
        return self.spark.read.schema(self.schemas[table]).parquet(f"{self.root}/{at}") if at else self.spark.createDataFrame([], self.schemas[table])

    def _publish(self, number: int, manifest: dict) -> None:
        at = self._path(f"{self.root}/manifests/{number:012d}.json")
        try:
            out = self._store.create(at, False)
        except Exception as e:
            if self._store.exists(at):
                raise Taken(number) from e
            raise
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()

    def commit(self, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], writer: str | None = None, batch: int | None = None) -> int:
        """SK1, SK5, ST7: replace the tables that `change` returns, all at once; it gets every table as of one state, and is asked again
        on the new state if another writer was first. With a writer's name and batch number, a batch that is already in does
        nothing. Returns the number of the state that holds it."""
        for _ in range(TRIES):
            numbers, state = self._numbers(), self.state()
            if writer is not None and batch is not None and state["batches"].get(writer, -1) >= batch:
                return state["number"]
            folder, made = f"data/{uuid.uuid4().hex}", {}
            for name, df in change({t: self.read(t, state) for t in self.schemas}).items():
                df.write.parquet(f"{self.root}/{folder}/{name}")
                made[name] = f"{folder}/{name}"
            batches = state["batches"] | ({writer: batch} if writer is not None and batch is not None else {})
            number = max([0, *numbers]) + 1
            try:
                self._publish(number, {"tables": state["tables"] | made, "batches": batches, "after": state["number"]})
                return number
            except Taken:
                self._store.delete(self._path(f"{self.root}/{folder}"), True)
        raise Taken(f"{TRIES} times")

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders that none of the last `keep` states names, and return how many; not while a writer is at work."""
        named = {at.split("/")[1] for n in self._numbers()[-keep:] for at in (self._read(n) or {"tables": {}})["tables"].values()}
        top = self._path(f"{self.root}/data")
        gone = [s.getPath() for s in (self._store.listStatus(top) if self._store.exists(top) else []) if s.getPath().getName() not in named]
        for at in gone:
            self._store.delete(at, True)
        return len(gone)


def upserted(old: DataFrame, new: DataFrame, key: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """SK4: `new` rows over `old` ones of their key; columns of `kept` stay as they first were."""
    first = old.select(key, *[F.col(c).alias(f"first_{c}") for c in kept])
    j = new.join(first, key, "left") if kept else new
    cols = [F.coalesce(f"first_{c}", c).alias(c) if c in kept else F.col(c) for c in old.columns]
    return old.join(new.select(key), key, "left_anti").unionByName(j.select(*cols))


def save_reviews(tables: Tables, reviews: DataFrame, findings: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
    """SK5: reviews and their findings in one commit: a review that is there keeps its created_at, its findings are replaced as a
    whole. Reviews (review_id, ..., created_at), findings (review_id, ...)."""

    def change(now: dict[str, DataFrame]) -> dict[str, DataFrame]:
        others = now["findings"].join(reviews.select("review_id"), "review_id", "left_anti")
        return {"reviews": upserted(now["reviews"], reviews, "review_id", ("created_at",)), "findings": others.unionByName(findings)}

    return tables.commit(change, writer, batch)


def commit_batches(stream: DataFrame, tables: Tables, checkpoint: str, writer: str, change: Callable[[DataFrame, dict[str, DataFrame]], dict[str, DataFrame]]) -> None:
    """ST7: what there is of a stream, each batch in one commit; a batch that is delivered again after a crash is in already."""

    def one(df: DataFrame, batch: int) -> None:
        df = df.persist()
        tables.commit(lambda now: change(df, now), writer, batch)
        df.unpersist()

    q = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def history(tables: Tables, name: str) -> DataFrame:
    """Rows of a table at each state that changed it: (number, n)."""
    rows, last = [], None
    for n in tables._numbers():
        state = tables._read(n)
        if state and state["tables"].get(name) != last:
            last = state["tables"].get(name)
            rows.append(tables.read(name, state).agg(F.lit(n).alias("number"), F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, rows) if rows else tables.spark.createDataFrame([], "number int, n long")
