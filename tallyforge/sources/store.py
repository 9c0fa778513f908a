"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_swept: set[str] = set()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, one of our own, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='tallyforge-')}")
        base = _own[0]
    top = f"{base.rstrip('/')}/core-{spark.sparkContext.applicationId}"
    if top not in _swept:
        _swept.add(top)
        atexit.register(_sweep, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"


def _sweep(spark: SparkSession, top: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(top)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the JVM may have gone first
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` and read it again: cuts the lineage, survives lost executors."""
    at = shared_dir(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
